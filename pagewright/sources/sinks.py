"""Results as files, written by the executors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_markdown(docs: DataFrame, path: str) -> None:
    """docs (doc_id, md): one text file of Markdown a document, in folders doc_id=...; blank documents are left out."""
    docs.where("md <> ''").select("doc_id", F.col("md").alias("value")).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(path, lineSep="\n")


def write_json(docs: DataFrame, path: str) -> None:
    """docs (doc_id, json): a line each."""
    docs.select("json").write.mode("overwrite").text(path)


def archives(docs: DataFrame, include_markdown: bool = True) -> DataFrame:
    """docs (doc_id, json, md, images array<struct<filename: string, bytes: binary>>) -> doc_id, zip binary: document.json, and
    markdown.md and images/ where asked for and there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for r in x.itertuples(index=False):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("document.json", r.json or "{}")
                    if include_markdown and r.md is not None:
                        z.writestr("markdown.md", r.md)
                    for image in r.images if r.images is not None else ():
                        z.writestr(f"images/{image['filename']}", image["bytes"])
                out.append((r.doc_id, buffer.getvalue()))
            yield pd.DataFrame(out, columns=["doc_id", "zip"])

    return docs.select("doc_id", "json", "md", "images").mapInPandas(run, "doc_id long, zip binary")


def image_archives(images: DataFrame) -> DataFrame:
    """images (doc_id, filename, bytes) -> doc_id, zip; documents without images have none."""
    grouped = images.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("filename", "bytes"))).alias("images"))
    return archives(grouped.select("doc_id", F.lit(None).cast("string").alias("json"), F.lit(None).cast("string").alias("md"), "images"), include_markdown=False)


def write_features(features: DataFrame, path: str) -> None:
    """Feature rows and labels as Parquet, arrays and all."""
    features.write.mode("overwrite").parquet(path)


def write_mistakes(mistakes: DataFrame, path: str) -> None:
    """mistakes (doc_id, page_number, pos, mistake): JSON lines a document, and a status of `finished` where all is right."""
    mistakes.repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").json(f"{path}/mistakes")
    mistakes.groupBy("doc_id").agg(F.when(F.bool_and(F.col("mistake") == 0), "finished").otherwise("open").alias("status")).write.mode("overwrite").json(f"{path}/status")
