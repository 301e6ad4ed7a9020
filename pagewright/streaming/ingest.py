"""Page XML from a folder that fills. Every operator stays within a document, so the stream carries no state; an extension,
as documents arrive one at a time elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.poppler import quarantine, scan_tokens


def stream_xml(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file as it arrives: path, doc_id (a hash of the path), xml."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).withColumn("path", F.col("_metadata.file_path"))
    return files.select("path", F.xxhash64("path").alias("doc_id"), F.col("value").alias("xml"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] = scan_tokens) -> StreamingQuery:
    """Parses what has arrived and appends then(documents) to out/rows, and what can't be parsed to out/quarantine. A batch
    that is repeated after a failure replaces its own folder."""

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        then(df).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        quarantine(df).write.mode("overwrite").parquet(f"{out}/quarantine/batch={n}")
        df.unpersist()

    return stream_xml(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
