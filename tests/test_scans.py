"""XML is read once for a summary, a bounded number of tokens at a time, and anchors without an XPath engine."""

import pytest

from pagewright.operators import scans
from pagewright.sources import poppler


def page(n):
    return f"<pdf2xml><fontspec id='0' size='9' family='T'/><page number='1' width='9' height='9'>{'<text top="1" left="1" width="2" height="2" font="0">ab</text>' * n}</page></pdf2xml>"


def test_documents_are_held_a_few_at_a_time(spark, monkeypatch):
    sizes = []
    docs = spark.createDataFrame([(i, page(3)) for i in range(10)], "doc_id long, xml string")
    monkeypatch.setattr(poppler, "TOGETHER", 8)
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, run, schema: sizes.extend(len(x) for x in run(iter([self.toPandas()]))))
    poppler.parse(docs)
    assert sizes == [2] * 5


def test_summary_reads_a_document_once(spark):
    docs = spark.createDataFrame([(1, page(3)), (2, "<pdf2xml/>"), (3, "")], "doc_id long, xml string")
    out = scans._summary(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, 6, True), (2, None, None, None, True), (3, None, None, None, False)]


@pytest.mark.parametrize("xml, found", [("<text>x</text>", ("", "")), ("<text>x<a href='u'>b<b>c</b></a><a href='v'>d</a></text>", ("u", "bc")), ("<text><b><a>q</a></b><a href='v'>d</a></text>", ("v", "q")), ("<a href='&#10;'>w</a>", ("\n", "w")), (None, ("", ""))])
def test_first_anchor(spark, xml, found):
    assert poppler.first_anchor(xml) == found
    by_path = spark.createDataFrame([(xml,)], "xml string").selectExpr("coalesce(xpath_string(xml, '//a[1]/@href'), '')", "coalesce(xpath_string(xml, '//a[1]'), '')").first()
    assert tuple(by_path) == found
