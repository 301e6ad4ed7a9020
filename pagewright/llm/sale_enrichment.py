"""Valid-time enrichment of sales by a stateful stream: each sale gets the version of its client that held when it was sold.

Sales and changes are one stream of rows. They are dealt by ranges of (client, time) into slices of about the square root of
all rows each, so a slice holds many small clients or a stretch of time of a large one, and neither a slice nor the number of
slices of one client grows faster than that root. A slice is a key of transformWithState; its state are two lists, the versions
sorted by client and time, and the sales that wait, both in blocks of rows by column. Each batch brings a slice a clock row with both watermarks: changes below
theirs are late, the others are put in order, sales below both watermarks are looked up by bisection and emitted, then versions
that no later sale may take are pruned. Where a client goes over several slices a second injected row tells each of them what
the others hold at that batch: the last version before the slice, how many unpruned versions lie outside it, and the client's
last version below the clock, under which its own are pruned.

Every batch is a start of the same query on one checkpoint; the last start also brings the clock that ends all waiting. All state is in RocksDB below the checkpoint and all output in a
file sink, so a lost executor costs its tasks and a lost driver the batch that ran.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .common import shared_dir, stash

#: Batches, first day (since 1970) and days of the sales' period, fewest rows of a slice, and rows that a task orders (about).
BATCHES, FIRST_DAY, DAYS, LEAST_SLICE, TASK_ROWS = 12, 19723, 152, 4096, 250_000

#: What stands for null in whole numbers, which pandas would turn into floats; lowest and highest watermark.
NONE, LOWEST, HIGHEST = -(1 << 63), -(1 << 63) + 1, (1 << 63) - 1

#: Kinds of rows; a client's versions come before its sales of the same time.
VERSION, SALE, CLOCK, BESIDE = range(4)

#: Columns of the stream. clock: t and id are the watermarks of sales and of changes. beside: t, id, cents, op are the last
#: version before the slice, n_out the unpruned versions outside it, floor_t and floor_id the version below which all are pruned.
ROW = "slice long, kind int, client long, t long, id long, cents long, op string, n_out long, floor_t long, floor_id long, batch int"
OUT = "rec string, id long, batch int, n_held long, change_id long, balance_cents long, op string"

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # each start opens stores of its own; else those before stay on the executors' disks
    # a start writes files for every partition: with a plain rename each, and without a second file of sums, which stores keep
    # themselves; a retried task finds the version that the first one wrote, of the same rows
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    # stores share one cache and one bound for what they have not yet written; else each has its own, and Spark leaves a
    # store's cache behind outside the heap when it closes the store, for each partition of each start
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


#: Columns of the blocks that state holds, and rows of a block.
VERSIONS = pa.schema([("client", pa.int64()), ("t", pa.int64()), ("id", pa.int64()), ("cents", pa.int64()), ("op", pa.string())])
WAITING = pa.schema([("client", pa.int64()), ("t", pa.int64()), ("id", pa.int64())])
BLOCK_ROWS = 8192


def ordered(client: np.ndarray, t: np.ndarray, id: np.ndarray, cents: np.ndarray, op: np.ndarray) -> np.ndarray:
    """Order by client, time and id; versions equal in all three by balance and op."""
    at = np.lexsort((cents, id, t, client))
    same = np.ones(max(0, len(at) - 1), bool)
    for c in (client, t, id, cents):
        same &= np.diff(c[at]) == 0
    if not same.any():
        return at
    return np.lexsort((np.unique(np.array(["" if x is None else x for x in op], str), return_inverse=True)[1], cents, id, t, client))


def from_blocks(state, schema: pa.Schema) -> list[np.ndarray]:
    """The columns of a list's blocks, put together."""
    blocks = [pa.ipc.read_record_batch(pa.py_buffer(b), schema) for (b,) in state.get()]
    if not blocks:
        return [np.zeros(0, object if pa.types.is_string(f.type) else np.int64) for f in schema]
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in blocks]) for i in range(len(schema))]


def to_blocks(state, columns: list[np.ndarray], schema: pa.Schema, had: bool) -> None:
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    if batch.num_rows:
        state.put([(batch.slice(at, BLOCK_ROWS).serialize().to_pybytes(),) for at in range(0, batch.num_rows, BLOCK_ROWS)])
    elif had:
        state.clear()


class Enrich(StatefulProcessor):
    """One slice: see the module."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions, self.waiting = (handle.getListState(name, "block binary") for name in ("versions", "waiting"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows), ignore_index=True)
        v, wait = from_blocks(self.versions, VERSIONS), from_blocks(self.waiting, WAITING)
        had, changed = (len(v[0]), len(wait[0])), [False, False]
        for batch in np.unique(x["batch"]):  # one, but the last start has the end after the last batch
            v, wait, told = self.step(x[x["batch"] == batch], int(batch), v, wait, changed)
            yield from told
        if changed[0]:
            to_blocks(self.versions, v, VERSIONS, had[0] > 0)
        if changed[1]:
            to_blocks(self.waiting, wait, WAITING, had[1] > 0)

    def step(self, x: pd.DataFrame, batch: int, held: list[np.ndarray], wait: list[np.ndarray], changed: list[bool]) -> tuple[list[np.ndarray], list[np.ndarray], list[pd.DataFrame]]:
        """A batch's rows -> versions and waiting sales afterwards, and what is told. changed: whether either is another now."""
        kind, new = x["kind"].to_numpy(), {c: x[c].to_numpy() for c in ("client", "t", "id", "cents", "op")}
        clock = np.flatnonzero(kind == CLOCK)[0]
        sales_mark, changes_mark = int(new["t"][clock]), int(new["id"][clock])
        low = min(sales_mark, changes_mark)

        late = (kind == VERSION) & (new["t"] < changes_mark)
        fresh = (kind == VERSION) & ~late
        v = {c: np.concatenate([old, new[c][fresh]]) for c, old in zip(new, held, strict=True)}
        if fresh.any():
            at = ordered(**v)
            v = {c: a[at] for c, a in v.items()}

        outside, before = {}, {}
        for i in np.flatnonzero(kind == BESIDE):
            c, floor = int(new["client"][i]), (int(x["floor_t"].iloc[i]), int(x["floor_id"].iloc[i]))
            outside[c] = int(x["n_out"].iloc[i])
            if new["t"][i] != NONE:
                before[c] = tuple(new[k][i] for k in ("id", "cents", "op"))
            below = (v["client"] == c) & ((v["t"] < floor[0]) | ((v["t"] == floor[0]) & (v["id"] < floor[1])))
            v = {k: a[~below] for k, a in v.items()}

        sold = [np.concatenate([old, new[c][kind == SALE]]) for c, old in zip(("client", "t", "id"), wait, strict=True)]
        due = (sold[1] == NONE) | (sold[1] < low) if low < HIGHEST else np.ones(len(sold[1]), bool)
        clients, times, ids = (s[due] for s in sold)
        first, last = np.searchsorted(v["client"], clients, "left"), np.searchsorted(v["client"], clients, "right")
        all_times = v["t"].tolist()
        at = np.array([bisect_right(all_times, t, lo, hi) - 1 for t, lo, hi in zip(times.tolist(), first.tolist(), last.tolist(), strict=True)], np.int64)
        known, dated = clients != NONE, times != NONE
        n_held, found = np.where(known, last - first, 0), known & dated & (at >= first)
        told = {c: np.full(len(ids), None if c == "op" else NONE, object if c == "op" else np.int64) for c in ("id", "cents", "op")}
        for c in told:
            told[c][found] = v[c][at[found]]
        for c, n in outside.items():
            here = clients == c
            n_held[here] += n
            if c in before:
                here &= dated & ~found
                for k, value in zip(told, before[c], strict=True):
                    told[k][here] = value

        under = v["t"] <= low
        gone = under.copy()
        gone[-1:] = False
        gone[:-1] &= under[1:] & (v["client"][1:] == v["client"][:-1])
        changed[0] |= bool(fresh.any() or gone.any() or len(v["t"]) != len(held[0]))
        changed[1] |= bool(len(sold[0]) != len(wait[0]) or due.any())
        out = []
        if late.any():
            n = int(late.sum())
            out.append(pd.DataFrame({"rec": "late", "id": new["id"][late], "batch": np.int32(batch), "n_held": np.full(n, NONE), "change_id": np.full(n, NONE), "balance_cents": np.full(n, NONE), "op": np.full(n, None)}))
        if len(ids):
            out.append(pd.DataFrame({"rec": "sale", "id": ids, "batch": np.int32(batch), "n_held": n_held, "change_id": told["id"], "balance_cents": told["cents"], "op": told["op"]}))
        return [v[c][~gone] for c in v], [s[~due] for s in sold], out

    def close(self) -> None:
        pass


def cut(spark: SparkSession, sales: DataFrame, changes: DataFrame, batches: int = BATCHES, first_day: int = FIRST_DAY, days: int = DAYS) -> DataFrame:
    """kind, client, t (microseconds), id, cents, op, batch: all sales, and the different changes that have a time. A row whose
    day of arrival isn't known comes with the last batch, one before the first day with the first."""
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    time = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp")), F.lit(NONE))
    number = lambda day: F.greatest(F.lit(0), F.coalesce(F.least(F.lit(batches - 1), F.floor((day - first_day) * batches / days)), F.lit(batches - 1))).cast("int")
    cents = F.expr("coalesce(try_cast(floor(100 * cast(balance as double) + 0.5D) as bigint), cast(-9223372036854775808 as bigint))")
    sold = sales.select(F.lit(SALE).alias("kind"), whole("client_id").alias("client"), time("sold_at").alias("t"), whole("sale_id").alias("id"), F.lit(NONE).alias("cents"), F.lit(None).cast("string").alias("op"), number(F.unix_date(F.to_date("arrived_at"))).alias("batch"))
    delay = F.crc32(F.col("change_id").cast("string").cast("binary")) % 4
    known = changes.distinct().where("valid_at is not null")
    versions = known.select(F.lit(VERSION).alias("kind"), whole("client_id").alias("client"), time("valid_at").alias("t"), whole("change_id").alias("id"), cents.alias("cents"), F.col("op").cast("string").alias("op"), number(F.unix_date(F.to_date("valid_at")) + delay).alias("batch"))
    return sold.union(versions)


def watermarks(rows: DataFrame, batches: int = BATCHES, hours: int = 0) -> list[tuple[int, int]]:
    """For each batch the watermarks of sales and of changes: the largest time of earlier batches, less some hours. Two numbers
    a batch are collected."""
    most = {(r["kind"], r["batch"]): r["t"] for r in rows.where(F.col("t") != NONE).groupBy("kind", "batch").agg(F.max("t").alias("t")).collect()}
    out, now = [], [LOWEST, LOWEST]
    for b in range(batches):
        out.append(tuple(now))
        now = [max(now[0], most.get((SALE, b), LOWEST)), max(now[1], most.get((VERSION, b), LOWEST))]
    back = hours * 3_600_000_000
    return [tuple(m if m == LOWEST else m - back for m in pair) for pair in out]


def sliced(rows: DataFrame, least: int = LEAST_SLICE) -> tuple[DataFrame, int]:
    """(rows, number of slices about). Adds slice: places in the order by client, time, kind and id, about max(least, root of all rows) to a slice. Ranges are
    sorted by task and told apart by their task, so numbers of slices ascend; written to shared files, so they stay."""
    n = rows.count()
    size = max(least, int(n**0.5))
    ranges = rows.repartitionByRange(max(1, -(-n // TASK_ROWS)), "client", "t", "kind", "id").sortWithinPartitions("client", "t", "kind", "id")
    place = F.monotonically_increasing_id()  # task * 2**33 + place within it
    return stash(ranges.withColumn("slice", F.floor(place / (1 << 33)) * (1 << 32) + F.floor(place % (1 << 33) / size)), "sale-slices"), -(-n // size)


def beside(rows: DataFrame, marks: list[tuple[int, int]]) -> DataFrame:
    """For each client that goes over several slices, each of these and each batch: what the other slices hold (ROW). The
    window over a client's slices sees one short row a slice and batch."""
    ends = rows.groupBy("slice").agg(F.min("client").alias("a"), F.max("client").alias("b"))
    ends = ends.select("slice", F.explode(F.array_distinct(F.array("a", "b"))).alias("client")).where(F.col("client") != NONE)
    several = ends.groupBy("client").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("client")
    parts = ends.join(several, "client", "left_semi")
    own = rows.where(F.col("kind") == VERSION).select("slice", "client", "t", "id", "cents", "op", "batch").join(parts, ["slice", "client"], "left_semi")
    own = own.unionByName(parts, allowMissingColumns=True)  # a row without batch stands for slices of sales alone
    lows = [min(m) for m in marks]

    def held(pdf: pd.DataFrame) -> pd.DataFrame:
        """What one slice has of one client, for each batch."""
        head, pdf = (pdf["slice"].iloc[0], pdf["client"].iloc[0]), pdf[pdf["batch"].notna()]
        v = {c: pdf[c].to_numpy(object if c == "op" else np.int64) for c in ("t", "id", "cents", "op", "batch")}
        on_time = v["t"] >= np.array([m[1] for m in marks], np.int64)[v["batch"]] if len(pdf) else np.zeros(0, bool)
        v = {c: a[on_time] for c, a in v.items()}
        at = ordered(np.zeros(len(v["t"]), np.int64), v["t"], v["id"], v["cents"], v["op"])
        v = {c: a[at] for c, a in v.items()}
        out = []
        for b in range(len(marks) + 1):
            there = np.flatnonzero(v["batch"] <= b)
            under = np.flatnonzero((v["batch"] < b) & (v["t"] <= lows[b - 1])) if b else there[:0]
            j, k = (there[-1] if len(there) else -1), (under[-1] if len(under) else -1)
            last = (v["t"][j], v["id"][j], v["cents"][j], v["op"][j]) if j >= 0 else (NONE, NONE, NONE, None)
            floor = (v["t"][k], v["id"][k]) if k >= 0 else (NONE, NONE)
            out.append((*head, b, len(there), int(np.sum(there >= k)), *floor, *last))
        return pd.DataFrame(out, columns=["slice", "client", "batch", "n", "n_above", "floor_t", "floor_id", "t", "id", "cents", "op"])

    known = own.select("slice", "client", *[F.coalesce(c, F.lit(NONE)).alias(c) for c in ("t", "id", "cents")], "op", "batch")
    told = known.groupBy("slice", "client").applyInPandas(held, "slice long, client long, batch int, n long, n_above long, floor_t long, floor_id long, t long, id long, cents long, op string")
    all_ = Window.partitionBy("client", "batch")
    prior = all_.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.when(F.col("floor_t") != NONE, F.struct("slice", "floor_t", "floor_id"))).over(all_)
    last = F.last(F.when(F.col("t") != NONE, F.struct("t", "id", "cents", "op")), ignorenulls=True).over(prior)
    out = told.withColumn("top", top).withColumn("last", last)
    mine = F.when(F.col("top").isNull() | (F.col("slice") > F.col("top.slice")), F.col("n")).when(F.col("slice") == F.col("top.slice"), F.col("n_above")).otherwise(F.lit(0))
    out = out.withColumn("mine", mine).withColumn("n_out", F.sum("mine").over(all_) - F.col("mine"))
    floor = [F.coalesce(F.col(f"top.{c}"), F.lit(NONE)).alias(c) for c in ("floor_t", "floor_id")]
    kept = F.col("top").isNull() | (F.struct("last.t", "last.id") >= F.struct("top.floor_t", "top.floor_id"))
    version = [F.when(kept, F.col(f"last.{c}")).alias(c) for c in ("t", "id", "cents", "op")]
    out = out.select("slice", F.lit(BESIDE).alias("kind"), "client", *version, "n_out", *floor, "batch")
    return out.select("slice", "kind", "client", *[F.coalesce(c, F.lit(NONE)).alias(c) for c in ("t", "id", "cents")], "op", "n_out", "floor_t", "floor_id", "batch")


def enrich_sales(sales: DataFrame, changes: DataFrame, batches: int = BATCHES, first_day: int = FIRST_DAY, days: int = DAYS, hours: int = 0, least_slice: int = LEAST_SLICE) -> DataFrame:
    """sales (sale_id, client_id, sold_at, arrived_at, any more) and changes (change_id, client_id, op, valid_at, balance, any
    more) -> rec, id, batch, n_held, change_id, balance_cents, op: a row for each sale, and one for each late change.

    Sales are rows: repeated ones are answered each. Changes count once if equal in all columns; those that share client, time
    and id but nothing else are put in order by balance and op. A sale without a time goes at once and without a version; one
    without a client has none held; changes without a client are held for nobody. A change without a time is left out. Empty
    tables give an empty result; sales alone go without versions. Other columns are not read, except that they tell changes
    apart. Rows, clocks, state, checkpoint and results are below spark.checkpoint.dir in a folder of this call.
    """
    spark = sales.sparkSession
    rows, n = sliced(cut(spark, sales, changes, batches, first_day, days), least_slice)
    if not n:
        return spark.createDataFrame([], OUT.replace("batch int", "batch long"))
    marks = watermarks(rows, batches, hours)
    clock = F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(s).alias("t"), F.lit(c).alias("id")) for b, (s, c) in enumerate([*marks, (HIGHEST, HIGHEST)])])
    clocks = rows.select("slice").distinct().select("slice", F.lit(CLOCK).alias("kind"), F.lit(NONE).alias("client"), F.inline(clock))
    none = {c: F.lit(NONE) for c in ("cents", "n_out", "floor_t", "floor_id")}
    plain = rows.withColumns({c: none[c] for c in ("n_out", "floor_t", "floor_id")})
    clocks = clocks.withColumns(none).withColumn("op", F.lit(None).cast("string"))
    names = [c.split()[0] for c in ROW.split(", ")]
    all_rows = plain.select(names).union(clocks.select(names)).union(beside(rows, marks).select(names))

    home = f"{shared_dir(spark)}/sale-stream-{uuid.uuid4().hex}"
    all_rows.withColumn("at", F.col("batch")).write.partitionBy("at").parquet(f"{home}/cut")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{home}/in"))
    # state is opened anew in each partition at each start, so there are no more of these than slices, nor over 64 slices in one
    parts = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 64)))
    settings = STATE | {"spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for b in range(batches):
            for at in (b, batches)[: 1 + (b == batches - 1)]:  # each has a clock row of every slice at least
                if not files.rename(path(f"{home}/cut/at={at}"), path(f"{home}/in/{at:04}")):
                    raise OSError(f"batch {at} could not be moved below {home}/in")
            stream = spark.readStream.schema(ROW).option("recursiveFileLookup", "true").parquet(f"{home}/in")
            told = stream.groupBy("slice").transformWithStateInPandas(Enrich(), OUT, "Append", "None")
            started = told.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{home}/out")
            started.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    null = lambda c: F.nullif(F.col(c), F.lit(NONE)).alias(c)
    return spark.read.schema(OUT).parquet(f"{home}/out").select("rec", null("id"), F.col("batch").cast("long").alias("batch"), null("n_held"), null("change_id"), null("balance_cents"), "op")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_sales(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


SQL = """
WITH RECURSIVE s AS (SELECT sale_id, client_id, epoch_us(sold_at) AS t, coalesce(greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) - 19723) * 12 / 152))), 11) AS a FROM sales),
 crc(i, c) AS (SELECT i, CAST(i AS BIGINT) FROM range(256) r(i)),
 crc8 AS (SELECT i, list_reduce(list_prepend(c, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM crc),
 tab AS (SELECT list(c ORDER BY i) AS tab FROM crc8),
 v0 AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
 v1 AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda x, y: xor(x >> 8, tab[CAST(xor(x & 255, y) AS BIGINT) + 1])) AS inv FROM v0, tab),
 v AS (SELECT change_id, client_id, op, epoch_us(valid_at) AS t, CAST(floor(100 * balance + 0.5) AS BIGINT) AS cents,
  coalesce(greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + (xor(inv, 4294967295) % 4) - 19723) * 12 / 152))), 11) AS a FROM v1),
 w AS (SELECT b, coalesce((SELECT max(t) FROM s WHERE s.a < b), -9223372036854775807) AS ws, coalesce((SELECT max(t) FROM v WHERE v.a < b), -9223372036854775807) AS wc FROM range(12) r(b)),
 late AS (SELECT v.change_id, v.a FROM v JOIN w ON w.b = v.a WHERE v.t < w.wc),
 k AS (SELECT v.* FROM v JOIN w ON w.b = v.a WHERE v.t >= w.wc),
 e AS (SELECT s.*, coalesce(CASE WHEN t IS NULL THEN a END, (SELECT min(b) FROM w WHERE b >= s.a AND s.t < least(ws, wc)), 12) AS e FROM s),
 f AS (SELECT k.client_id, w.b + 1 AS e, max(struct_pack(t := t, i := change_id)) AS f FROM k JOIN w ON k.a <= w.b AND k.t <= least(w.ws, w.wc) GROUP BY ALL),
 g AS (SELECT k.client_id, q.e, k.t, k.change_id, k.op, k.cents FROM k JOIN (SELECT unnest(range(13)) AS e) q ON k.a <= q.e LEFT JOIN f ON f.client_id = k.client_id AND f.e = q.e WHERE f.f IS NULL OR struct_pack(t := k.t, i := k.change_id) >= f.f),
 n AS (SELECT client_id, e, count(*) AS n FROM g GROUP BY ALL),
 m AS (SELECT client_id, e, t, unnest(max(struct_pack(change_id := change_id, op := op, cents := cents))) FROM g GROUP BY client_id, e, t)
SELECT 'sale' AS rec, e.sale_id AS id, CAST(e.e AS BIGINT) AS batch, coalesce(n.n, 0) AS n_held, m.change_id, m.cents AS balance_cents, m.op
FROM e ASOF LEFT JOIN m ON e.client_id = m.client_id AND e.e = m.e AND e.t >= m.t LEFT JOIN n ON n.client_id = e.client_id AND n.e = e.e
UNION ALL SELECT 'late', change_id, CAST(a AS BIGINT), NULL, NULL, NULL, NULL FROM late
"""
