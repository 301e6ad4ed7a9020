"""Near duplicates by SimHash, verified through pivot distance tables.

Equal fingerprints are one node. Two fingerprints that differ in at most RADIUS bits agree on all but RADIUS of the blocks
that the 64 bits are cut into, so they meet under one of the keys made of the other blocks. Whoever meets is compared by a
pivot table: the Hamming distances of each fingerprint to the same reference fingerprints. By the triangle inequality a
pair whose distances to some pivot differ by more than the radius can't be near; survivors are verified bit by bit. From a
key's members only a spanning forest of links goes on. Within a large key the pivot table finds each leader's members first,
so that not all pairs are listed; larger ones still are cut into chunks whose pairs are separate units of work. No link
between different fingerprints is lost, and components follow from the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stash
from .components import components

#: Words of a shingle, differing bits of a link, seed of the hash, reference fingerprints and their seed.
WORDS, RADIUS, HASH_SEED, PIVOTS, PIVOT_SEED = 4, 4, 42, 24, 99
#: Members of a key from which leaders are used, and from which it is cut into chunks.
LEADERS_FROM, CHUNK = 64, 20_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit integer; zero without words."""
    import xxhash

    split = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not split:
        return 0
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    n = max(1, len(split) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(words, len(split)) - 1 :].tolist()
    h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)], "<u8").view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, fp long."""
    return map_texts(docs.select("doc_id", "text"), lambda: lambda cols: {"doc_id": cols["doc_id"], "fp": [fingerprint(t, words) for t in cols["text"]]}, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """For so many fingerprints: the bits of each key, as signed masks. More fingerprints, longer keys; none loses a link."""
    blocks = radius + 2
    while n >> (64 * (blocks - radius) // blocks) > 64 and blocks < 2 * radius:
        blocks += 1
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    out = [sum(bits[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


class Forest:
    """Union by the smaller index; keeps the links that joined something."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


class PivotTable:
    """Distances of fingerprints to reference fingerprints."""

    def __init__(self, pivots: int = PIVOTS, radius: int = RADIUS):
        self.pivots, self.radius = np.random.default_rng(PIVOT_SEED).integers(0, 1 << 64, pivots, np.uint64), radius

    def coordinates(self, fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[:, None] ^ self.pivots[None, :]).astype(np.int8)

    def near(self, fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are links: discard by the largest difference of coordinates, then verify."""
        at = np.arange(len(i))
        for k in range(0, table.shape[1], 4):  # a few pivots at a time; most pairs go with the first
            at = at[np.abs(table[i[at], k : k + 4] - table[j[at], k : k + 4]).max(axis=1, initial=0) <= self.radius]
        return at[np.bitwise_count(fps[i[at]] ^ fps[j[at]]) <= self.radius]


def _led(fps: np.ndarray, forest: Forest, base: int, pivots: PivotTable) -> None:
    """Links within one large key: every member joins the first leader in reach, found through the pivot table; clusters are
    compared only as far as their leaders' distance allows and as long as they are apart, by the pivot table again."""
    radius, table = pivots.radius, pivots.coordinates(fps)
    free, members = np.arange(len(fps)), []
    leaders = []
    while len(free):
        lead = int(free[0])
        hit = pivots.near(fps, table, free, np.full(len(free), lead))
        own = free[hit]
        free = np.delete(free, hit)
        leaders.append(lead)
        members.append(own)
        for x in own[1:].tolist():
            forest.link(base + lead, base + x)
    wide = [c for c, m in enumerate(members) if len(m) > 1]  # leaders are over radius apart, so one of a pair must be wide
    heads = fps[leaders]
    for a in wide:
        for b in np.flatnonzero(np.bitwise_count(heads ^ heads[a]) <= 3 * radius).tolist():
            if b == a or (len(members[b]) > 1 and b < a):
                continue
            x, y = members[a], members[b]
            step = max(1, (1 << 18) // len(y))
            for at in range(0, len(x), step):
                if forest.root(base + leaders[a]) == forest.root(base + leaders[b]):
                    break
                some = x[at : at + step]
                i, j = np.repeat(some, len(y)), np.tile(y, len(some))
                hit = pivots.near(fps, table, i, j)
                if len(hit):
                    forest.link(base + int(i[hit[0]]), base + int(j[hit[0]]))


def links_within(fps: np.ndarray, bounds: np.ndarray, table: PivotTable) -> list[tuple[int, int]]:
    """A spanning forest of the links within each run bounds[k]..bounds[k+1] of fps, as pairs of positions."""
    forest, size = Forest(len(fps)), np.diff(bounds)
    left, right = [], []
    for m in np.unique(size[(size > 1) & (size <= LEADERS_FROM)]):
        i, j = np.triu_indices(m, 1)
        at = bounds[:-1][size == m]
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    if left:
        i, j, coordinates = np.concatenate(left), np.concatenate(right), table.coordinates(fps)
        for at in range(0, len(i), 1 << 20):
            x, y = i[at : at + (1 << 20)], j[at : at + (1 << 20)]
            for k in table.near(fps, coordinates, x, y).tolist():
                forest.link(int(x[k]), int(y[k]))
    for k in np.flatnonzero(size > LEADERS_FROM).tolist():
        _led(fps[bounds[k] : bounds[k + 1]], forest, int(bounds[k]), table)
    return forest.links


def near_links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """nodes (fp, node), fp distinct -> links (a, b) between nodes: enough to connect all within the radius."""
    keys = masks(nodes.count(), radius)
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(keys)]))
    met = nodes.select("fp", "node", spread.alias("m")).select("m.band", "m.key", "fp", "node")
    big = stash(met.groupBy("band", "key").count().where(F.col("count") > chunk), "simhash-big")
    met = met.withColumn("unit", F.lit(0))
    if not big.isEmpty():  # chunks of a large key: each pair of chunks is a unit of its own
        g = F.ceil(F.col("count") / chunk).cast("int")
        own = F.pmod(F.xxhash64("fp"), g).cast("int")
        units = F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), g - 1), lambda o: F.least(own, o) * g + F.greatest(own, o)))
        met = met.join(big, ["band", "key"], "left").select("band", "key", "fp", "node", F.explode(units).alias("unit"))
    dealt = met.select("band", "key", "unit", "fp", "node").repartition("band", "key", "unit").sortWithinPartitions("band", "key", "unit", "fp")

    def run(batches):
        import pyarrow as pa

        table, kept = PivotTable(radius=radius), None

        def found(x):
            change = np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(axis=0)) + 1
            bounds = np.concatenate([[0], change, [x.shape[1]]])
            pairs = links_within(x[3].view(np.uint64), bounds, table)
            node = x[4]
            return pa.RecordBatch.from_arrays([pa.array([int(node[i]) for i, _ in pairs], pa.int64()), pa.array([int(node[j]) for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            x = x if kept is None else np.concatenate([kept, x], axis=1)
            last = np.flatnonzero((x[:3] != x[:3, -1:]).any(axis=0))  # the last key may go on in the next batch
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield found(x[:, :cut])
            kept = x[:, cut:].copy()
        if kept is not None:
            yield found(kept)

    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, fingerprint, component_id, one row for each input row.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Texts of fewer than
    `words` words are one shingle. Rows that repeat a doc_id are answered each. A row whose doc_id is null keeps it and gets
    the component of its fingerprint, null if no row of the component has an id. An empty table gives an empty result.
    Columns beyond doc_id and text are not read. doc_id: an integer.
    """
    found = stash(fingerprints(docs, words), "simhash-fp")
    nodes = stash(found.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("node")).where("node is not null"), "simhash-nodes")
    joined = nodes.join(components(near_links(nodes, radius)), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = found.join(joined, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
