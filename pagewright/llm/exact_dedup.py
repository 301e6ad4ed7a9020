"""Exact deduplication with an extendible-hash index on shared files, in DataFrame operations only.

A key is the 64-bit hash of a text after lower-casing A-Z, and a bucket holds the keys that begin with its bits: a key range.
1. One pass writes key and SHA-256 of every row; no text is shuffled for that.
2. The directory starts with one bucket. As long as a bucket holds more than `capacity` different keys it is split and, where
   its depth is the directory's, the directory doubled. How deep that can go follows from the number of keys. Buckets that
   even then are overfull chain further entries.
3. Only where a key repeats are bytes needed: a bitmap of those keys' prefixes, of bounded size, lets through the texts that
   may be concerned, and these are grouped by key and bytes. Copies combine on the map side first, so a text that a third of
   all rows hold reaches the next stage once per map task.
4. Entries are dealt to owner tasks by bucket, so that a task has whole buckets and its file covers their key ranges. The
   owner chains the entries of one key. Entries of one key that differ in bytes must differ in digest, or the job fails: from
   there on a digest stands for the bytes.
5. Rows probe by bucket, key and digest. Entries of very large groups, of which there can be only few, go to all rows
   instead, so that no task gets the rows of a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stash, text_or_empty

#: Different keys a bucket holds before it splits, and deepest directory (its rows go to all tasks).
CAPACITY, DEEPEST = 1 << 14, 20
#: Most bits of the bitmap's prefixes (2**26 bits are 2**20 rows of 64), and share of all rows from which a group is large.
BITS, LARGE = 26, 1000


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def depth_for(keys: int, capacity: int = CAPACITY, deepest: int = DEEPEST) -> int:
    """Bits after which buckets of so many evenly spread keys are well under the capacity."""
    return min(deepest, max(1, (max(keys, 1) // capacity).bit_length() + 3))


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int | None = None) -> DataFrame:
    """(prefix, bucket, depth): for each key prefix of max_depth bits the bucket it falls in and that bucket's depth.

    keys: column key, different ones. Only counts of the 2**max_depth prefixes reach the driver; by default max_depth follows
    from the number of keys and is DEEPEST at most.
    """
    spark = keys.sparkSession
    max_depth = depth_for(keys.count(), capacity) if max_depth is None else max_depth
    counts = [0] * (1 << max_depth)
    for row in keys.groupBy(_prefix(F.col("key"), max_depth).alias("prefix")).count().collect():
        counts[row["prefix"]] = row["count"]
    depth, split, rows = 0, [0], []
    while split:  # one round a doubling: the buckets of this depth that are overfull go on to the next
        width, later = max_depth - depth, []
        for b in split:
            lo, hi = b << width, (b + 1) << width
            if depth < max_depth and sum(counts[lo:hi]) > capacity:
                later += [2 * b, 2 * b + 1]
            else:
                rows += [(p, lo, depth) for p in range(lo, hi)]
        depth, split = depth + 1, later
    return spark.createDataFrame(rows, "prefix int, bucket int, depth int")


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """(word, marks): the first `bits` bits of each key as one bit, 64 of them a row; 2**(bits - 6) rows at most."""
    at = F.shiftrightunsigned("key", 64 - bits)
    mark = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), mark.alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, index), both on shared files. rows: doc_id, bucket, key, sha. index: bucket, depth, key, chain, sha, keep_id,
    group_size, in files of whole buckets."""
    texts = docs.select("doc_id", ascii_lower(text_or_empty()).alias("norm")).withColumn("key", F.xxhash64("norm"))
    rows = stash(texts.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-rows")
    one = F.struct(F.max("doc_id").alias("keep_id"), F.min("sha").alias("sha"))  # of use where n is 1
    keys = stash(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), one.alias("one")), "exact-keys")
    n = keys.count()
    max_depth = depth_for(n, capacity) if max_depth is None else max_depth
    entries = F.broadcast(directory(keys, capacity, max_depth))  # 2**max_depth rows

    bits = min(BITS, max(12, n.bit_length() + 4))
    repeated = F.broadcast(_bitmap(keys.where("n > 1"), bits))  # 2**(bits - 6) rows at most
    probed = texts.withColumn("at", F.shiftrightunsigned("key", 64 - bits)).withColumn("word", F.shiftright("at", 6))
    marked = probed.join(repeated, "word").where(F.expr("shiftrightunsigned(marks, cast(at & 63 as int)) & 1 = 1"))
    alike = marked.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = alike.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    single = keys.where("n = 1").select("key", "one.sha", "one.keep_id", F.lit(1).cast("long").alias("group_size"))
    # the bitmap lets some single keys through as well: their entries come from the bytes' side alone
    single = single.withColumn("at", F.shiftrightunsigned("key", 64 - bits)).withColumn("word", F.shiftright("at", 6)).join(repeated, "word", "left")
    single = single.where(F.expr("marks is null or shiftrightunsigned(marks, cast(at & 63 as int)) & 1 = 0")).select("key", "sha", "keep_id", "group_size")

    dealt = single.unionByName(several).withColumn("prefix", _prefix(F.col("key"), max_depth)).join(entries, "prefix").repartition("bucket")
    chain = Window.partitionBy("bucket", "key").orderBy("sha")
    same = F.lag("sha").over(chain) == F.col("sha")
    chained = dealt.withColumn("same", same).withColumn("chain", F.row_number().over(chain))
    sha = F.when(F.col("same"), F.raise_error(F.lit("different texts with one digest")).cast("binary")).otherwise(F.col("sha"))
    index = chained.select("bucket", "depth", "key", "chain", sha.alias("sha"), "keep_id", "group_size")
    rows = rows.withColumn("prefix", _prefix(F.col("key"), max_depth)).join(entries, "prefix").select("doc_id", "bucket", "key", "sha")
    return rows, stash(index.sortWithinPartitions("bucket", "key", "chain"), "exact-index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int | None = None) -> DataFrame:
    """docs (doc_id, text, any more) -> one row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty texts are equal. The largest doc_id of a group stays; a null doc_id never does
    (keep_id is null only if all ids of the group are). Rows that repeat a doc_id are answered alike, each by itself. An
    empty table gives an empty result. Columns beyond doc_id and text are not read, so their names can't clash.
    """
    rows, index = build_index(docs, capacity, max_depth)
    least = max(1, rows.count() // LARGE)
    large = F.broadcast(index.where(F.col("group_size") > least).select("bucket", "key", "sha", "keep_id", "group_size"))  # under LARGE rows
    small = index.where(F.col("group_size") <= least).select("bucket", "key", "sha", "keep_id", "group_size")
    at = ["bucket", "key", "sha"]
    found = rows.join(large, at).unionByName(rows.join(large.select(at), at, "left_anti").join(small, at))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
