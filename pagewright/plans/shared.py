"""Tables that jobs of the layout part share: written below spark.checkpoint.dir, so that lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def by_document(spark: SparkSession) -> None:
    """Tells Spark's planner that joins on document, page and more may use what is dealt by document already, and that what is
    sorted by page needs no hashing to be grouped. Without it each join on a token's place deals both of its sides anew."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def home(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir; where that is unset, a local run gets a temporary folder and a cluster an
    error, since its executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str | None = None) -> tuple[DataFrame, str]:
    """df as Parquet below the shared folder, read again, and where it is."""
    at = home(df.sparkSession)
    df.write.parquet(at, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def removed(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
