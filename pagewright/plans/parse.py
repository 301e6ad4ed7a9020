"""From page XML to Markdown and JSON in one call: the operators put together over a user's own documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators  # noqa: F401  registers the operators
from ..sources import poppler
from ..sources.archives import write_archives
from .dual import OPERATORS
from .fixtures import FX
from .shared import by_document, written


def relations(docs: DataFrame, emissions: DataFrame | None = None, regions: DataFrame | None = None, cells: DataFrame | None = None, images: DataFrame | None = None, structures: DataFrame | None = None, heights: DataFrame | None = None) -> dict[str, DataFrame]:
    """docs (doc_id, xml) -> the relations that operators take, all from the documents or given; none is invented.

    Without emissions every token is text; without regions, cells, images or structures there are none. regions, cells,
    images, structures, emissions: columns as the fixtures `reg`, `cell`, `img`, `tsr`, `emi`. heights (doc_id,
    common_height): the common height of a document's text; only with it are `styled` tokens there. A document with
    something wrong is left out (or what of it was recovered, kept): `quarantine` says which.
    """
    spark = docs.sparkSession
    by_document(spark)
    parsed = poppler.parse(docs).persist()  # read by several relations; lost blocks are parsed again
    found = poppler.scan_tokens(parsed)
    tok = found.drop("link", "link_text").withColumn("token_type", F.lit(6))
    none = lambda schema: spark.createDataFrame([], schema)
    reg = regions if regions is not None else none("doc_id long, page_number int, region_seq int, `left` int, top int, `right` int, bottom int, width int, height int, area int, region_type string, aspect_ratio double, fill_density double, edge_density double, color_variance double, h_lines int, v_lines int")
    cell = cells if cells is not None else none("doc_id long, page_number int, region_seq int, region_left int, region_top int, `row` int, col int, x double, y double, w double, h double")
    img = images if images is not None else none("doc_id long, page_number int, seq int, page_w double, page_h double, a double, b double, c double, d double, e double, f double, has_text boolean")
    tsr = structures if structures is not None else none("doc_id long, page_number int, `left` int, top int, `right` int, bottom int, region_seq int, tsr_seq int, num_cells int")
    text = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: (k == 6).cast("double"))
    emi = emissions if emissions is not None else tok.select("doc_id", "page_number", "pos", text.alias("p"))
    typed = tok.drop("token_type").join(emi, ["doc_id", "page_number", "pos"], "left").withColumn("token_type", F.when(F.col("p").isNull(), 6).otherwise(F.array_position("p", F.array_max("p")).cast("int") - 1)).drop("p") if emissions is not None else tok
    lines = OPERATORS["token_lines"](lineof=FX.frame(spark, "", "lineof", {"tok": typed}))
    frag = typed.join(lines.withColumnRenamed("line_id", "line_no"), ["doc_id", "page_number", "pos"])
    order = Window.partitionBy("doc_id", "page_number", "line_no").orderBy("left", "pos")
    frag = frag.select("doc_id", "page_number", "line_no", F.row_number().over(order).alias("frag_no"), "content", "left", "top", "right", "bottom", "token_type")
    known = {"tok": typed, "page": poppler.scan_pages(parsed), "font": poppler.scan_fonts(parsed), "reg": reg, "cell": cell, "img": img, "tsr": tsr, "emi": emi}
    known |= {"printed": typed, "pictured": img, "ord": typed, "listed": typed, "frag": frag, "linked": poppler.links(found), "quarantine": poppler.quarantine(parsed), "raw": reg, "cand": reg}
    if heights is not None:
        known["styled"] = typed.join(heights.select("doc_id", "common_height"), "doc_id")
    return known


def run(spark: SparkSession, key: str, known: dict[str, DataFrame]) -> DataFrame:
    """Any operator by key over given relations and what follows from them; a relation that does neither is an error."""
    known = dict(known)
    op = OPERATORS[key]
    return op(**{i: FX.frame(spark, "", i, known) for i in op.reads})


def to_markdown(docs: DataFrame, **given: DataFrame | None) -> DataFrame:
    """docs (doc_id, xml) -> doc_id, md."""
    return run(docs.sparkSession, "document_markdown", relations(docs, **given))


def to_json(docs: DataFrame, **given: DataFrame | None) -> DataFrame:
    """docs (doc_id, xml) -> doc_id, json."""
    return run(docs.sparkSession, "document_json", relations(docs, **given))


#: Resolutions that may be asked for, and characters of a preview.
LEAST_DPI, MOST_DPI, PREVIEW = 72, 600, 2000


def results(docs: DataFrame, crops: DataFrame | None = None, include_markdown: bool = True, include_images: bool = True, **given: DataFrame | None) -> DataFrame:
    """docs (doc_id, xml) and crops (doc_id, filename, bytes) -> doc_id, json, md, images: a row each document that was read. md
    is null where it isn't asked for, images empty where there are none or they aren't. JSON and Markdown are written in the
    shared folder first: both come from the same relations, and a plan of both joined is more than the analyser tells apart."""
    known = relations(docs, **given)
    spark = docs.sparkSession
    out, _ = written(run(spark, "document_json", known))
    md = written(run(spark, "document_markdown", known))[0] if include_markdown else None
    out = out.join(md, "doc_id", "left").withColumn("md", F.coalesce("md", F.lit(""))) if md is not None else out.withColumn("md", F.lit(None).cast("string"))
    none = F.lit(None).cast("array<struct<filename: string, bytes: binary>>")
    if include_images and crops is not None:
        own = crops.where("bytes is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("filename", "bytes"))).alias("images"))
        out = out.join(own, "doc_id", "left")
    else:
        out = out.withColumn("images", none)
    return out.select("doc_id", "json", "md", F.coalesce("images", F.array().cast("array<struct<filename: string, bytes: binary>>")).alias("images"))


def parse_to_archives(pdfs: DataFrame, path: str, dpi: int = 150, include_markdown: bool = True, include_images: bool = True, convert: Callable | None = None, crops: DataFrame | None = None, **given: DataFrame | None) -> DataFrame:
    """pdfs (doc_id, pdf) -> one archive a document below path, all or none; returns doc_id, error of PDFs that failed, which
    have no archive. convert: as for poppler.pdf_to_xml; crops and relations of rasters at this dpi may be given."""
    if not LEAST_DPI <= dpi <= MOST_DPI:
        raise ValueError(f"dpi must be {LEAST_DPI} to {MOST_DPI}, not {dpi}")
    made, _ = written(poppler.pdf_to_xml(pdfs, convert) if convert else poppler.pdf_to_xml(pdfs))  # PDFs are converted once
    write_archives(results(made.where("xml is not null").select("doc_id", "xml"), crops, include_markdown, include_images, **given), path, include_markdown)
    return made.where("error is not null").select("doc_id", "error")


def preview(md: DataFrame, characters: int = PREVIEW) -> DataFrame:
    """doc_id, md -> doc_id, the first characters of md, and whether there are more."""
    return md.select("doc_id", F.substring("md", 1, characters).alias("preview"), (F.length("md") > characters).alias("more"))


def health(spark: SparkSession, model_path: str) -> dict[str, object]:
    """Whether the session works and a model lies at the path, on any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(model_path)
    return {"status": "ok" if spark.range(1).count() == 1 else "failed", "model_available": bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))}
