"""Every layout operator against its DuckDB oracle on a few documents, and edge cases by hand."""

import datetime
import math

import duckdb
import numpy as np
import pytest

from pagewright.operators import features, sequence
from pagewright.plans import queries
from pagewright.plans.dual import OPERATORS
from pagewright.plans.fixtures import FX
from pagewright.sources import poppler

TEXTS = [
    "One two three. Four five\nSix. seven Eight. NINE TEN\n- item one\n• item two. three\n12. 3,4\nÉté à la mer; fin: oui.",
    "A. B. C. D\n" * 30 + "Tail (x) [y] {z} ~ end",
    "",
    "single",
    "Same line. same line. Same LINE;\n\n\nGap above: 42\n½ cup. x² plus\nǅ Title Case Words. lower",
    "\n".join(f"Row {i}. cell {i * 7}. value {i * i}. ŠĐ ß" for i in range(45)),
    "a\u2028b. c\u2029d. ². 10³\n٣٤. ①. x½y. tail",
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i * 5 + 1, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str | datetime.datetime):
        return v
    if isinstance(v, list):
        return tuple(map(plain, v))
    return round(float(v), 9)


@pytest.mark.parametrize("key", sorted(OPERATORS))
def test_operator(spark, sf, duck, key):
    df = queries.queries()[key](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    sql = queries.oracle_sql().get(key)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)
    right = sorted((tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in cols) for r in want.fetchall()), key=str)
    assert left == right


@pytest.mark.parametrize("key", ["line_blocks", "viterbi_labels", "document_markdown", "cell_text_md", "doc_modes"])
def test_row_order_does_not_matter(spark, sf, key):
    op = OPERATORS[key]
    frames = {i: FX.frame(spark, sf, i) for i in op.inputs}
    mixed = {k: v.repartition(7).sortWithinPartitions(*v.columns[::-1][:1]) if v.columns else v for k, v in frames.items()}
    assert sorted(map(str, op(**frames).collect())) == sorted(map(str, op(**mixed).collect()))


def test_feature_vector_is_501_wide(spark, sf):
    sizes = {len(r["features"]) for r in queries.queries()["feature_vector"](spark, sf).collect()}
    assert sizes == {501}


def test_categories():
    assert features.categories("") == [-1] * 8
    assert features.categories("aB1")[:4] == [features.CATEGORIES.index(c) for c in ("Ll", "Lu", "Nd")] + [-1]
    assert features.categories("abcd.efgh") == [features.CATEGORIES.index("Ll")] * 8


def test_fold_of_blocks():
    f = np.array
    blocks, types = sequence.fold_blocks(f([False, False, True, False, False, False]), f([6, 6, 3, 6, 5, 6]), f([0, 10, 30, 40, 55, 60]), f([9, 20, 38, 50, 59, 70]), f([True, False, False, False, False, False]))
    assert blocks == [1, 1, 2, 3, 4, 5] and types == [6, 6, 3, 6, 5, 6]


XML = """<pdf2xml><page number="1" width="612" height="792"><fontspec id="0" size="12" family="Times-Bold"/>
<text top="60" left="50" width="80" height="12" font="0">a <b>bold</b> tail</text><text top="60" left="140" width="0" height="12" font="0" id="t9" reading_order_no="4"><a href="http://z.example">z &amp; y</a></text>
<text top="1" left="1" width="1" height="1" font="0">  </text></page><page number="2" width="10" height="20"/></pdf2xml>"""


def test_poppler(spark):
    docs = spark.createDataFrame([(1, XML), (2, "<broken"), (3, None), (4, "<pdf2xml/>")], "doc_id long, xml string")
    tokens = [r.asDict() for r in poppler.scan_tokens(docs).orderBy("pos").collect()]
    assert [(t["content"], t["tag_id"], t["reading_order_no"], t["left"], t["right"]) for t in tokens] == [("a bold tail", "tag", -1, 50, 130), ("z & y", "t9", 4, 139, 141)]
    assert {r["doc_id"] for r in poppler.quarantine(docs).collect()} == {2, 3}
    assert {r["doc_id"]: r["contains_text"] for r in poppler.contains_text(docs).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert poppler.scan_pages(docs).count() == 2
    assert [r["color"] for r in poppler.scan_fonts(docs).collect()] == ["#000000"]


def test_read_labeled(spark, tmp_path):
    for dataset, name in (("d1", "a"), ("d2", "b")):
        (tmp_path / "pdfs" / name).mkdir(parents=True)
        (tmp_path / "pdfs" / name / "etree.xml").write_text(XML)
        (tmp_path / "labeled_data" / "token_type" / dataset / name).mkdir(parents=True)
        (tmp_path / "labeled_data" / "token_type" / dataset / name / "labels.json").write_text('{"pages":[{"number":1,"labels":[{"top":1,"left":2,"width":3,"height":4,"label_type":5,"metadata":""}]}]}')
    got = poppler.read_labeled(spark, str(tmp_path), "d")
    assert [(r["dataset"], r["name"]) for r in got.collect()] == [("d1", "a"), ("d2", "b")]
    assert poppler.read_labeled(spark, str(tmp_path), "2").count() == 1
    assert poppler.read_labeled(spark, str(tmp_path), limit=1).count() == 1
    labels = poppler.scan_labels(got.selectExpr("1L as doc_id", "labels"))
    assert labels.count() == 2


def test_label_json_may_be_missing(spark):
    df = spark.createDataFrame([(1, None), (2, "{}")], "doc_id long, labels string")
    assert poppler.scan_labels(df).count() == 0


def test_entry_point_works_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'document_markdown' in e.queries() and not any(k.startswith('op1') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
