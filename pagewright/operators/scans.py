"""Scans over XML and JSON that stand for the fixture relations, which serve as their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dual import operator
from ..plans.fixtures import FX
from ..sources import poppler


def _escaped(c) -> F.Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(content: str = "content"):
    """A text element whose content is partly bold now and then."""
    c = F.col(content)
    mixed = F.concat(F.lit("<b>"), _escaped(F.substring(c, 1, 2)), F.lit("</b>"), _escaped(F.substring(c, 3, 1 << 30)))
    body = F.when(F.col("pos") % 3 == 0, mixed).otherwise(_escaped(c))
    return F.concat(F.format_string('<text top="%d" left="%d" width="%d" height="%d" font="%d"> ', "top", "left", "width", "height", "font_id"), body, F.lit(" </text>"))


def _xml(tok: DataFrame, page: DataFrame, font: DataFrame) -> DataFrame:
    fonts = font.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string('<fontspec id="%d" size="%.0f" family="%s"/>', "font_id", "font_size", "family"))), "").alias("fonts"))
    body = tok.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", _element().alias("e")))).alias("es"))
    opened = F.format_string('<page number="%d" width="%d" height="%d">', "page_number", "page_width", "page_height")
    pages = page.join(body, ["doc_id", "page_number"]).select("doc_id", "page_number", F.concat(opened, F.array_join(F.transform("es", lambda e: e["e"]), ""), F.lit('<text top="1" left="1" width="0" height="0" font="0"> </text></page>')).alias("x"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "x"))).alias("ps"))
    return docs.join(fonts, "doc_id").select("doc_id", F.concat(F.lit("<pdf2xml>"), "fonts", F.array_join(F.transform("ps", lambda p: p["x"]), ""), F.lit("</pdf2xml>")).alias("xml"))


FX.invent("xml", "tok", "page", "font", spark=_xml)(lambda d: "select 1 as none")


@operator("xml", spark=lambda xml: poppler.scan_tokens(xml).select("doc_id", "page_number", "pos", "tag_id", "content", "font_id", "reading_order_no", "left", "top", "right", "bottom"))
def scan_tokens(d):
    """Tokens of page XML."""
    return """select doc_id, page_number, pos, 'tag' as tag_id, content, cast(font_id as varchar) as font_id, -1 as reading_order_no, "left", top, "right", bottom from tok"""


@operator("xml", spark=lambda xml: poppler.scan_pages(xml))
def scan_pages(d):
    return "select doc_id, page_number, page_width, page_height from page"


@operator("xml", spark=lambda xml: poppler.scan_fonts(xml))
def scan_fonts(d):
    return "select doc_id, cast(font_id as varchar) as font_id, family, font_size, bold, italics, color from font"


@operator("xml", spark=lambda xml: poppler.contains_text(xml))
def contains_text(d):
    return "select distinct doc_id, true as contains_text from page"


def _summary(xml: DataFrame) -> DataFrame:
    parsed = poppler.parse(xml)  # one reading of each document gives all
    some = lambda c: F.when(F.size(c) > 0, F.size(c).cast("long"))
    chars = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, t: n + F.length(t["content"]))
    return parsed.select("doc_id", some("pages").alias("n_pages"), some("tokens").alias("n_tokens"), F.when(F.size("tokens") > 0, chars).alias("n_chars"), F.col("error").isNull().alias("parsed"))


@operator("xml", spark=_summary)
def scan_poppler_xml(d):
    """Documents of page XML: pages, tokens, and whether they could be parsed."""
    return "select t.doc_id, count(distinct t.page_number) as n_pages, count(*) as n_tokens, cast(sum(length(t.content)) as bigint) as n_chars, true as parsed from tok t group by t.doc_id"


def _label_json(lab: DataFrame) -> DataFrame:
    label = F.struct("seq", "top", "left", "width", "height", "label_type", F.lit("").alias("metadata"))
    pages = lab.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(label)), lambda x: x.dropFields("seq")).alias("labels"))
    return pages.groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("page_number").alias("number"), "labels")).alias("pages"))).alias("labels"))


FX.invent("labeljson", "lab", spark=_label_json)(lambda d: "select 1 as none")


@operator("labeljson", spark=lambda labeljson: poppler.scan_labels(labeljson))
def scan_labels(d):
    """Labels of label JSON, in order."""
    return """select doc_id, page_number, cast(row_number() over (partition by doc_id, page_number order by seq) - 1 as int) as seq, "left", top, width, height, label_type from lab"""


def _links(tok: DataFrame) -> DataFrame:
    part = _escaped(F.substring("content", 1, 4))
    href = F.when(F.col("pos") % 4 == 0, F.lit("http://z.example/")).when(F.col("pos") % 4 == 1, F.lit("#p1")).otherwise(F.lit(""))
    inner = F.when(F.col("pos") % 8 == 4, F.lit("~elsewhere~")).otherwise(part)
    xml = F.when(F.col("pos") % 4 == 3, F.concat(F.lit("<text>"), part, F.lit("</text>"))).otherwise(F.concat(F.lit('<text>x<a href="'), href, F.lit('">'), inner, F.lit("</a></text>")))
    return poppler.hyperlinks(tok.select("doc_id", F.concat("page_number", F.lit("/"), "pos").alias("place"), "pos", "content", xml.alias("xml")).select("doc_id", F.col("place").alias("pos"), "content", "xml"))


@operator("tok", spark=_links)
def hyperlink_type(d):
    """Type and text of a token's first anchor."""
    none = "(pos % 4 >= 2 or pos % 8 = 4 or (pos % 4 = 0 and trim(substr(content, 1, 4)) = ''))"
    return f"""select doc_id, concat(page_number, '/', pos) as pos, case when {none} then '' when pos % 4 = 0 then 'http://z.example/' else '#p1' end as link, case when {none} then '' else trim(substr(content, 1, 4)) end as link_text,
 case when {none} then 'NO_LINK' when pos % 4 = 0 then 'WEB_URL' else 'DOCUMENT_REFERENCE' end as link_type from tok"""
