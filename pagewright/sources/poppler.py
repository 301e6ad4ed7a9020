"""Page XML as pdftohtml writes it, and label JSON, as relations.

XML text is the engine's entry point: one row a document. Elements may hold mixed content, which a row schema would lose,
so a document is parsed with ElementTree, once, in a mapInPandas stage; a document with something wrong gives one row in the
quarantine instead of stopping the job. PDFs become XML and rasters through functions that a caller may replace.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .recovery import recovered

TOKENS = "doc_id long, page_number int, pos int, tag_id string, content string, font_id string, reading_order_no int, `left` int, top int, `right` int, bottom int, width int, height int, link string, link_text string"
PAGES = "doc_id long, page_number int, page_width int, page_height int"
FONTS = "doc_id long, font_id string, family string, font_size double, bold boolean, italics boolean, color string"
LABELS = "struct<pages: array<struct<number: int, labels: array<struct<top: int, left: int, width: int, height: int, label_type: int, metadata: string>>>>>"


def read_poppler(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files as (path, file_name, file_type, xml); the type is the name of the folder. Any store that Spark reads."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    parts = F.split("path", "/")
    return df.select("path", F.element_at(parts, -1).alias("file_name"), F.element_at(parts, -2).alias("file_type"), "xml")


def read_labeled(spark: SparkSession, root: str, filter_in: str | None = None, limit: int | None = None) -> DataFrame:
    """Labelled documents below root: XML and labels of one (dataset, name), for datasets whose name holds filter_in; a missing
    labels file gives null labels. limit: as many documents, in order of dataset and name."""
    names = labeled_names(spark, root, filter_in)
    if limit is not None:
        # the first names alone decide which files are opened; `limit` paths reach the driver
        chosen = [r["path"] for r in names.orderBy("dataset", "name").limit(limit).collect()]
        if not chosen:
            return spark.createDataFrame([], "name string, dataset string, labels string, xml string")
        sources = sorted({f"{root}/pdfs/{_escaped(path.split('/')[-2])}/etree.xml" for path in chosen})
        found, pages = spark.read.text([_escaped(p) for p in chosen], wholetext=True), read_poppler(spark, sources)
    else:
        found, pages = spark.read.text(_labels_glob(root, filter_in), wholetext=True), read_poppler(spark, f"{root}/pdfs/*/etree.xml")
    pages = pages.select(F.element_at(F.split("path", "/"), -2).alias("name"), "xml")
    found = found.select(F.split("_metadata.file_path", "/").alias("p"), F.col("value").alias("labels"))
    return found.select(F.element_at("p", -3).alias("dataset"), F.element_at("p", -2).alias("name"), "labels").join(pages, "name").select("name", "dataset", "labels", "xml")


def _escaped(path: str) -> str:
    """A path whose characters stand for themselves in a glob."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def _labels_glob(root: str, filter_in: str | None) -> str:
    return f"{root}/labeled_data/token_type/{f'*{_escaped(filter_in)}*' if filter_in else '*'}/*/labels.json"


def labeled_names(spark: SparkSession, root: str, filter_in: str | None = None) -> DataFrame:
    """(dataset, name, path) of labelled documents below root, by listing alone: no file is opened, and only folders whose name
    holds filter_in are listed."""
    listed = spark.read.format("binaryFile").load(_labels_glob(root, filter_in)).select("path")
    p = F.split("path", "/")
    return listed.select(F.element_at(p, -3).alias("dataset"), F.element_at(p, -2).alias("name"), "path")


def fixed(left: int, top: int, right: int, bottom: int) -> tuple[int, int, int, int]:
    """A box with sides of some length, the right way round."""
    if left == right:
        left, right = left - 1, right + 1
    if top == bottom:
        top, bottom = top - 1, bottom + 1
    return min(left, right), min(top, bottom), max(left, right), max(top, bottom)


def _root(text: str | None) -> tuple[ET.Element | None, str | None]:
    """The root and what is wrong with the XML; of broken XML all that can be read."""
    try:
        return ET.fromstring(text or ""), None
    except ET.ParseError as e:
        return recovered(text or ""), str(e)


def _tokens(root: ET.Element):
    fonts = {f.get("id") for f in root.iter("fontspec")}
    for page in root.iter("page"):
        number, pos = int(page.get("number")), 0
        for e in page.iter("text"):
            content = "".join(e.itertext()).strip()
            if not content:
                continue
            if e.get("font") not in fonts:
                raise KeyError(f"font {e.get('font')} is not declared")
            pos += 1
            left, top = int(e.get("left")), int(e.get("top"))
            x0, y0, x1, y1 = fixed(left, top, left + int(e.get("width")), top + int(e.get("height")))
            anchor = e.find(".//a")
            link = ("", "") if anchor is None else (anchor.get("href", ""), "".join(anchor.itertext()).strip())
            yield number, pos, e.get("id", "tag"), content, e.get("font"), int(e.get("reading_order_no", -1)), x0, y0, x1, y1, x1 - x0, y1 - y0, *link


def _pages(root: ET.Element):
    return [(int(p.get("number")), int(p.get("width")), int(p.get("height"))) for p in root.iter("page")]


def _fonts(root: ET.Element):
    return [(f.get("id"), f.get("family"), float(f.get("size")), "Bold" in f.get("family"), "Italic" in f.get("family"), f.get("color", "#000000")) for f in root.iter("fontspec")]


def _named(schema: str) -> str:
    """A schema's columns but doc_id, as fields of a struct."""
    return ", ".join(f"{n}: {t}" for n, t in (c.strip().split(" ") for c in schema.split(",")[1:]))


#: Tokens that a task holds as Python objects (a longer document alone).
TOGETHER = 4096


def parse(docs: DataFrame) -> DataFrame:
    """docs (doc_id, xml) -> doc_id, tokens, pages, fonts (arrays of structs), contains_text, error, recovered: one row a document
    and one reading of its XML, from which all scans follow; keep it where several are wanted.

    error says what is wrong with a document, else it is null: XML that doesn't parse (recovered: what could be had is there),
    a token's font that isn't declared, an attribute that is missing or no number. Then the document has no rows at all unless
    it was recovered; others go on. An empty text gives no rows and an error."""
    fields = [(_tokens, TOKENS, "tokens"), (_pages, PAGES, "pages"), (_fonts, FONTS, "fonts")]
    names = [[c.split(":")[0].strip("` ") for c in _named(schema).split(", ")] for _, schema, _ in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "tokens", "pages", "fonts", "contains_text", "error", "recovered"]
        for x in batches:
            out, held = [], 0
            for i, text in zip(x["doc_id"], x["xml"], strict=True):
                root, error = _root(text)
                found, some = [[], [], []], False
                if root is not None:
                    some = next(root.iter("text"), None) is not None
                    try:
                        found = [[dict(zip(n, r, strict=True)) for r in each(root)] for (each, _, _), n in zip(fields, names, strict=True)]
                    except (KeyError, TypeError, ValueError) as e:
                        found, error = [[], [], []], error or f"{type(e).__name__}: {e}"
                out.append((i, *found, some, error, error is not None and any(found)))
                held += 1 + len(found[0])
                if held >= TOGETHER:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    arrays = ", ".join(f"{name} array<struct<{_named(schema)}>>" for _, schema, name in fields)
    return docs.select("doc_id", "xml").mapInPandas(run, f"doc_id long, {arrays}, contains_text boolean, error string, recovered boolean")


def _scan(docs: DataFrame, name: str) -> DataFrame:
    """docs: as they are, or parsed."""
    parsed = docs if name in docs.columns else parse(docs)
    return parsed.select("doc_id", F.inline(name))


def scan_tokens(docs: DataFrame) -> DataFrame:
    """docs (doc_id, xml), or parsed -> TOKENS: text elements that aren't blank, all their descendants' text, with the target
    and the text of their first link."""
    return _scan(docs, "tokens")


def scan_pages(docs: DataFrame) -> DataFrame:
    return _scan(docs, "pages")


def scan_fonts(docs: DataFrame) -> DataFrame:
    return _scan(docs, "fonts")


def quarantine(docs: DataFrame) -> DataFrame:
    """doc_id, error, recovered of the documents with something wrong."""
    parsed = docs if "error" in docs.columns else parse(docs)
    return parsed.where("error is not null").select("doc_id", "error", "recovered")


def contains_text(docs: DataFrame) -> DataFrame:
    """doc_id, contains_text: whether any text element is there; false where nothing of the XML can be read."""
    parsed = docs if "contains_text" in docs.columns else parse(docs)
    return parsed.select("doc_id", "contains_text")


def links(tokens: DataFrame) -> DataFrame:
    """TOKENS -> doc_id, page_number, pos, content, link, link_text, link_type: a link without target is none; a web link whose
    text isn't part of the content, none; else a web link or a reference within the document."""
    web = F.col("link").startswith("http")
    none = (F.col("link") == "") | (web & ((F.col("link_text") == "") | ~F.contains("content", "link_text")))
    blank = lambda c: F.when(none, "").otherwise(F.col(c)).alias(c)
    return tokens.select("doc_id", "page_number", "pos", "content", blank("link"), blank("link_text"), F.when(none, "NO_LINK").when(web, "WEB_URL").otherwise("DOCUMENT_REFERENCE").alias("link_type"))


PDFTOHTML = ("pdftohtml", "-i", "-xml", "-zoom", "1.0")


def _pdftohtml(pdf: bytes, hidden: bool) -> str:
    """XML of one PDF by the command, which must be on the executors."""
    import os
    import subprocess
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # on the executor, for this call alone
        source, target = os.path.join(folder, "in.pdf"), os.path.join(folder, "out.xml")
        with open(source, "wb") as f:
            f.write(pdf)
        subprocess.run([*PDFTOHTML[:2], *(["-hidden"] if hidden else []), *PDFTOHTML[2:], source, target], check=True, capture_output=True)
        with open(target, errors="ignore") as f:
            return f.read()


def pdf_to_xml(pdfs: DataFrame, convert=_pdftohtml) -> DataFrame:
    """pdfs (doc_id, pdf binary) -> doc_id, xml, error. A PDF without visible text is converted again with its hidden text. What
    fails gives a null xml and the error. convert(bytes, hidden) -> XML; by default the pdftohtml command."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, pdf in zip(x["doc_id"], x["pdf"], strict=True):
                try:
                    xml = convert(pdf, False)
                    root = _root(xml)[0]
                    if root is None or next(root.iter("text"), None) is None:
                        xml = convert(pdf, True)
                    out.append((i, xml, None))
                except Exception as e:  # noqa: BLE001  whatever a converter raises concerns one document
                    out.append((i, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "xml", "error"])

    return pdfs.select("doc_id", "pdf").mapInPandas(run, "doc_id long, xml string, error string")


def page_rasters(pdfs: DataFrame, render, dpi: int = 150) -> DataFrame:
    """pdfs (doc_id, pdf binary) -> doc_id, page_number, img_w, img_h, gray binary, error. render(bytes, dpi) gives the pages as
    arrays, gray or with three colours, one after another, so that a task holds a page. A PDF that fails gives one row with
    the error, after the pages before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names = ["doc_id", "page_number", "img_w", "img_h", "gray", "error"]
        for x in batches:
            for i, pdf in zip(x["doc_id"], x["pdf"], strict=True):
                number = 0
                try:
                    for page in render(pdf, dpi):
                        number += 1
                        page = np.asarray(page, float)
                        gray = page if page.ndim == 2 else page[..., :3] @ np.array([0.299, 0.587, 0.114])
                        gray = np.rint(gray).astype(np.uint8)
                        yield pd.DataFrame([(i, number, gray.shape[1], gray.shape[0], gray.tobytes(), None)], columns=names)
                except Exception as e:  # noqa: BLE001  as above
                    yield pd.DataFrame([(i, number + 1, None, None, None, f"{type(e).__name__}: {e}")], columns=names).astype({"img_w": "Int32", "img_h": "Int32"})

    return pdfs.select("doc_id", "pdf").mapInPandas(run, "doc_id long, page_number int, img_w int, img_h int, gray binary, error string")


def scan_labels(docs: DataFrame) -> DataFrame:
    """docs (doc_id, labels JSON) -> doc_id, page_number, seq, left, top, width, height, label_type; null or broken JSON gives none."""
    pages = docs.select("doc_id", F.explode(F.from_json("labels", LABELS)["pages"]).alias("p"))
    return pages.select("doc_id", F.col("p.number").alias("page_number"), F.posexplode("p.labels").alias("seq", "l")).select("doc_id", "page_number", "seq", "l.left", "l.top", "l.width", "l.height", "l.label_type")


def first_anchor(xml: str | None) -> tuple[str, str]:
    """Target and text of an element's first anchor; one without a target leaves it to the next that is its parent's first."""
    if not xml:
        return "", ""
    root = ET.fromstring(xml)
    anchors = list(root.iter("a"))
    if not anchors:
        return "", ""
    href = anchors[0].get("href")
    if href is None and len(anchors) > 1:
        firsts = {id(p.find("a")) for p in root.iter()}
        href = next((a.get("href") for a in anchors if (a is root or id(a) in firsts) and "href" in a.attrib), None)
    return href or "", "".join(anchors[0].itertext())


@F.pandas_udf(StructType([StructField("link", StringType()), StructField("link_text", StringType())]))
def _anchor(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([first_anchor(x) for x in xml], columns=["link", "link_text"])


def hyperlinks(elements: DataFrame) -> DataFrame:
    """elements (doc_id, pos, xml of one text element, content) -> doc_id, pos, link, link_text, link_type.

    The first anchor counts: without target none; a web link whose text isn't part of the content, none; else a web link or
    a reference within the document."""
    found = elements.select("doc_id", "pos", "content", _anchor("xml").alias("a"))
    x = found.select("doc_id", "pos", "content", F.col("a.link").alias("link"), F.trim("a.link_text").alias("link_text"))
    return links(x.withColumn("page_number", F.lit(None))).select("doc_id", "pos", "link", "link_text", "link_type")
