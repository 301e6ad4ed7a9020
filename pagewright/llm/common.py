"""What the operators of this subpackage share: shared folders, text columns, batch-wise Python stages."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters that ASCII lower-casing maps.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Texts that a Python stage holds at a time.
SLICE = 256


#: Folders that stash has written in this process and discard has not removed.
_stashed: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run gets a temporary
    folder; a cluster gets an error, since its executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stashed.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes stashed folders from number `since` on, but for the last `keep`. What is lazily read from them is lost, so
    the caller must have written or collected its results. stashes() gives the number of the next one."""
    for path in _stashed[since : len(_stashed) - keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _stashed.remove(path)


def stashes() -> int:
    return len(_stashed)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. A text of as many bytes as characters is ASCII, where lower() does the same faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def map_texts(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Applies make()(columns as lists) to slices of at most SLICE rows; make runs once a task. schema: DDL of the result."""
    arrow = pa.schema([])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = apply({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _pruned(counts: Counter, n: int) -> Counter:
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n])) if len(counts) > n else counts


def frequent(docs: DataFrame, parts: Callable[[str], list[str]], table: int, longest: int) -> list[str]:
    """The commonest of parts(text) over docs (text, any more), at most `table` of at most `longest` characters, commonest
    first. Each task sends one summary of that size, and summaries are merged in a tree."""

    def run(batches):
        total = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for text in batch.slice(at, 2048).column(0).to_pylist():
                    if text:
                        total.update(parts(text))
                if len(total) > 8 * table:
                    total = _pruned(total, 4 * table)
        short = Counter({k: v for k, v in total.items() if len(k) <= longest and v > 1})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(_pruned(short, table)))], pa.binary())], ["summary"])

    def merge(a: bytes, b: bytes) -> bytes:
        return pickle.dumps(dict(_pruned(Counter(pickle.loads(a)) + Counter(pickle.loads(b)), table)))

    rows = docs.select("text").mapInArrow(run, "summary binary").rdd.map(lambda r: bytes(r[0]))
    if not rows.getNumPartitions():
        return []
    found = Counter(pickle.loads(rows.treeReduce(merge)))
    return sorted(found, key=lambda k: (-found[k], k))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
