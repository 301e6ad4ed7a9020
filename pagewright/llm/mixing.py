"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share raised to an exponent, normalised. The exponent is bisected (in rounds that try many
values in one aggregation) until the mixture meets a target entropy or a limit on repetition. A weight times the budget
gives a source's tokens: so many whole epochs, and a rest that takes part of a further one. The order of an epoch is a
permutation of the source's blocks and, within a block, of its documents; the rest takes documents in that order while
they fit. A source is cut into many blocks by a hash, more of them the more tokens there are, so that a block holds about
BLOCK_TOKENS at most however large the source is; only sums of blocks meet in a source's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, text_or_empty

#: Least blocks a source, tokens a block, most repetitions of a source, seed of the permutations.
BLOCKS, BLOCK_TOKENS, REPEATS, SEED = 1024, 1 << 22, 4.0, 17
#: Values tried in a round of the bisection, and rounds: the exponent is found to 2**-30.
TRIED, ROUNDS = 64, 5


def words(text: Column) -> Column:
    """Tokens as white-space-separated words."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def shares(tokens: DataFrame) -> DataFrame:
    """tokens (source, n_tokens, any more) -> source, tokens, share: of the sources with tokens."""
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    total = sums.agg(F.sum("tokens").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("source", "tokens", (F.col("tokens") / F.col("total")).alias("share"))  # total: one row


def exponent(shared: DataFrame, target_entropy: float | None = None, repeats: float = REPEATS) -> float:
    """The largest exponent in 0..1 at which the weights' entropy (nats) is at least target_entropy or, without a target, the
    smallest at which no source is repeated over `repeats` times as often as the least repeated one. Out of reach: 0 or 1.

    Entropy and repetition fall as the exponent grows, so each round keeps the one step of its grid where the answer changes.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / TRIED for i in range(TRIED + 1)]
        at = shared.select("share", F.posexplode(F.array(*map(F.lit, grid))).alias("i", "a")).withColumn("q", F.pow("share", "a"))
        got = at.groupBy("i").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("l"), F.max(F.col("q") / F.col("share")).alias("most"), F.min(F.col("q") / F.col("share")).alias("least"))
        rows = {r["i"]: r for r in got.select("i", (F.log("z") - F.col("l") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("ratio")).collect()}
        if not rows:
            return 1.0
        if target_entropy is None:
            ok = next((i for i in range(TRIED + 1) if rows[i]["ratio"] <= repeats), TRIED)
            low, high = grid[max(0, ok - 1)], grid[ok]
        else:
            ok = next((i for i in reversed(range(TRIED + 1)) if rows[i]["entropy"] >= target_entropy), 0)
            low, high = grid[ok], grid[min(TRIED, ok + 1)]
        if low == high:
            break
    return high if target_entropy is None else low


def mix(docs: DataFrame, target_entropy: float | None = None, repeats: float = REPEATS, budget: int | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, any more) -> doc_id, source, n_tokens, weight, copies, block, block_rank, doc_rank_key.

    copies: how often the document is in the mixture. An epoch's order is block_rank, doc_rank_key, doc_id, n_tokens. blocks: the least
    number of blocks a source; there are more where blocks would hold over BLOCK_TOKENS tokens. budget: tokens of
    the mixture; by default the least at which every document is used once, so that nothing is lost. A null text counts as
    empty, a null source as the empty name. Documents without tokens take nothing from the budget and go with each whole
    epoch, once where a source has no tokens at all (its weight is 0). Rows that repeat a doc_id count each, the
    shorter text first; those of one length take the same place in either order. An empty table
    gives an empty result. Other columns are not read.
    """
    tokens = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), words(text_or_empty()).alias("n_tokens"))
    tokens = stash(tokens, "mix-tokens")
    blocks = max(blocks, -(-(tokens.agg(F.sum("n_tokens")).first()[0] or 0) // BLOCK_TOKENS))
    tokens = tokens.withColumn("block", F.pmod(F.xxhash64("doc_id", "source", F.lit(seed)), F.lit(blocks)).cast("int"))
    per_block = tokens.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    shared = shares(per_block.select("source", F.col("block_tokens").alias("n_tokens")))
    shared = stash(shared, "mix-shares")
    a = exponent(shared, target_entropy, repeats)
    powered = shared.withColumn("q", F.pow("share", F.lit(a)))
    z = powered.agg(F.sum("q").alias("z"), F.max(F.col("tokens") / F.col("q")).alias("most"))  # one row
    wanted = (F.lit(int(budget)) if budget is not None else F.col("most") * F.col("z")) * F.col("q") / F.col("z")
    # a nudge of 1e-9 keeps a source that is to be used exactly once from losing a token to rounding
    plan = powered.crossJoin(F.broadcast(z)).select("source", "tokens", (F.col("q") / F.col("z")).alias("weight"), F.floor(wanted * (1 + 1e-9)).alias("wanted"))
    plan = plan.select("source", "weight", F.floor(F.col("wanted") / F.col("tokens")).cast("long").alias("epochs"), F.col("wanted").alias("w"), "tokens")
    plan = plan.select("source", "weight", "epochs", (F.col("w") - F.col("epochs") * F.col("tokens")).cast("long").alias("rest"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed + 1)), "block")  # a row a block of the source
    ranked = per_block.withColumn("block_rank", F.row_number().over(order)).withColumn("before", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("block_tokens"))
    ranked = stash(ranked.join(plan, "source", "left").select("source", "block", "block_rank", "before", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("epochs", F.lit(1)).alias("epochs"), F.coalesce("rest", F.lit(0)).alias("rest"), "block_tokens"), "mix-blocks")
    placed = tokens.join(ranked, ["source", "block"]).withColumn("key", F.xxhash64("doc_id", F.lit(seed + 2)))
    within = Window.partitionBy("source", "block").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("n_tokens").over(within)
    extra = F.when((F.col("n_tokens") > 0) & (upto <= F.col("rest")), 1).otherwise(0)
    return placed.select("doc_id", "source", "n_tokens", "weight", (F.col("epochs") + extra).cast("long").alias("copies"), "block", "block_rank", F.col("key").alias("doc_rank_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
