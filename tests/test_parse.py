import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import model
from pagewright.plans import parse
from pagewright.plans.dual import OPERATORS
from pagewright.sources import poppler, sinks
from pagewright.sources.archives import write_archives
from pagewright.streaming.ingest import ingest
from tests.test_layout import XML


def docs(spark):
    return spark.createDataFrame([(1, XML)], "doc_id long, xml string")


def test_markdown_and_json(spark, tmp_path):
    md = parse.to_markdown(docs(spark))
    assert [r["md"] for r in md.collect()] == ["a bold tail z & y"]
    body = json.loads(parse.to_json(docs(spark)).first()["json"])
    assert (body["num_pages"], body["num_tokens"], body["num_regions"]) == (2, 2, 0)
    sinks.write_markdown(md, f"{tmp_path}/md")
    assert spark.read.text(f"{tmp_path}/md").count() == 1


def test_archives(spark):
    df = spark.createDataFrame([(1, '{"a": 1}', "# t", [("i.png", b"png")]), (2, "{}", None, None)], "doc_id long, json string, md string, images array<struct<filename: string, bytes: binary>>")
    names = {r["doc_id"]: sorted(zipfile.ZipFile(io.BytesIO(r["zip"])).namelist()) for r in sinks.archives(df).collect()}
    assert names == {1: ["document.json", "images/i.png", "markdown.md"], 2: ["document.json"]}
    images = spark.createDataFrame([(1, "i.png", b"png")], "doc_id long, filename string, bytes binary")
    assert sinks.image_archives(images).count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(XML)
    (tmp_path / "in" / "b.xml").write_text("<broken")
    ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/quarantine").count() == 1


def test_model(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(1, 1, i, [float(i % 3), float(r.random())], i % 3) for i in range(60)]
    x = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, features array<float>, label int")
    m = model.train(x)
    model.save(m, spark.createDataFrame([(0, 0, 1.0)], "prev int, curr int, p double"), str(tmp_path))
    again, trans = model.load(spark, str(tmp_path))
    got = model.score(x, again).select("label", (F.array_position("p", F.array_max("p")) - 1).alias("best"), F.size("p").alias("n")).collect()
    assert all(g["label"] == g["best"] and g["n"] == 11 for g in got) and trans.count() == 1
    assert model.score_with(x, lambda a: np.eye(11)[a[:, 0].astype(int)]).count() == 60


BAD_FONT = XML.replace('font="0" id="t9"', 'font="5" id="t9"')
BAD_NUMBER = XML.replace('left="140"', 'left="far"')


def test_one_bad_document_does_not_stop_the_others(spark):
    texts = [XML, BAD_FONT, BAD_NUMBER, "<broken", XML.replace("z &amp; y", "z & y"), XML[: XML.index("<text top=\"1\"")], None]
    known = parse.relations(spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string"))
    md = {r["doc_id"]: r["md"] for r in parse.run(spark, "document_markdown", known).collect()}
    assert md == {0: "a bold tail z & y", 4: "a bold tail z & y", 5: "a bold tail z & y"}
    assert {r["doc_id"]: r["recovered"] for r in known["quarantine"].collect()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_relations_of_a_document_are_its_own(spark):
    known = parse.relations(docs(spark))
    assert [tuple(r) for r in parse.run(spark, "token_font", known).select("pos", "bold", "font_size").orderBy("pos").collect()] == [(1, True, 12.0), (2, True, 12.0)]
    assert [r["font_size_mode"] for r in parse.run(spark, "font_mode", known).collect()] == [12.0]
    assert parse.run(spark, "text_features", known).count() == 2
    assert parse.run(spark, "embedded_image_regions", known).count() == 0
    assert [r["txt"] for r in parse.run(spark, "merge_tokens", known).collect()] == ["a bold tail z & y"]
    assert [(r["pos"], r["md"]) for r in parse.run(spark, "link_markdown", known).orderBy("pos").collect()] == [(1, "a bold tail"), (2, "[z & y](http://z.example)")]
    assert {r["level"] for r in parse.run(spark, "list_levels", known).collect()} == {-1}
    assert [r["page_number"] for r in parse.run(spark, "scanned_pages", known).collect()] == [2]
    heights = spark.createDataFrame([(1, 5)], "doc_id long, common_height int")
    assert parse.run(spark, "title_level", parse.relations(docs(spark), heights=heights)).count() == 2
    for key in ("title_level", "label_assign", "mistake_type", "tsr_rows"):
        with pytest.raises(KeyError, match="must be given"):
            parse.run(spark, key, known)


def test_every_operator_runs_or_says_what_it_lacks(spark):
    known = parse.relations(docs(spark), heights=spark.createDataFrame([(1, 5)], "doc_id long, common_height int"))
    ran = 0
    for key in OPERATORS:
        try:
            frame = parse.run(spark, key, known)
        except KeyError as e:
            assert "must be given" in str(e)
            continue
        assert frame.columns
        ran += 1
    assert ran >= 60


def test_pdfs(spark):
    pdfs = spark.createDataFrame([(1, b"text"), (2, b"hidden"), (3, b"bad")], "doc_id long, pdf binary")

    def convert(pdf, hidden):
        if pdf == b"bad":
            raise ValueError("no PDF")
        return XML if pdf == b"text" or hidden else "<pdf2xml><page number='1' width='1' height='1'/></pdf2xml>"

    got = {r["doc_id"]: (r["xml"], r["error"]) for r in poppler.pdf_to_xml(pdfs, convert).collect()}
    assert got == {1: (XML, None), 2: (XML, None), 3: (None, "ValueError: no PDF")}

    def render(pdf, dpi):
        yield np.full((2, 3), 7)
        if pdf == b"bad":
            raise ValueError("no page")
        yield np.full((2, 3, 3), [255, 0, 0])

    pages = sorted((r["doc_id"], r["page_number"], bytes(r["gray"] or b""), r["error"]) for r in poppler.page_rasters(pdfs, render, 72).collect())
    assert pages[:2] == [(1, 1, bytes([7] * 6), None), (1, 2, bytes([76] * 6), None)]
    assert pages[-2:] == [(3, 1, bytes([7] * 6), None), (3, 2, b"", "ValueError: no page")]


def labelled(root, names):
    for dataset, name in names:
        (root / "pdfs" / name).mkdir(parents=True, exist_ok=True)
        (root / "pdfs" / name / "etree.xml").write_text(XML)
        (root / "labeled_data" / "token_type" / dataset / name).mkdir(parents=True)
        (root / "labeled_data" / "token_type" / dataset / name / "labels.json").write_text('{"pages":[]}')


def test_a_limit_opens_only_as_many_documents(spark, tmp_path):
    """Files beyond the limit are no input of the plan, and the filter leaves folders out of the listing."""
    labelled(tmp_path, [(f"d{k % 3}", f"n{k}") for k in range(12)])
    (tmp_path / "labeled_data" / "token_type" / "d0[x]" / "odd").mkdir(parents=True)
    got = poppler.read_labeled(spark, str(tmp_path), limit=3)
    opened = got.select("name").inputFiles()
    assert sorted(r["name"] for r in got.collect()) == ["n0", "n3", "n6"] and len(opened) == 6
    assert all(any(f"/n{k}/" in f for k in (0, 3, 6)) for f in opened)
    names = poppler.labeled_names(spark, str(tmp_path), "1")
    assert sorted((r["dataset"], r["name"]) for r in names.collect()) == [("d1", f"n{k}") for k in (1, 10, 4, 7)]
    assert poppler.read_labeled(spark, str(tmp_path), limit=0).count() == 0
    assert poppler.read_labeled(spark, str(tmp_path), "d0").count() == 4


ARCHIVE = "doc_id long, json string, md string, images array<struct<filename: string, bytes: binary>>"


def test_archives_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(1, '{"a":1}', "# x", [("p.png", b"1" * 3_000_000), ("../q.png", b"2")]), (2, None, None, None), (3, "{}", "", [])]
    target = tmp_path / "out"
    write_archives(spark.createDataFrame(rows, ARCHIVE).repartition(3), str(target))
    assert sorted(p.name for p in target.iterdir()) == ["1.zip", "2.zip", "3.zip"]
    with zipfile.ZipFile(target / "1.zip") as z:
        assert z.namelist() == ["document.json", "markdown.md", "images/p.png", "images/q.png"] and z.read("images/p.png") == b"1" * 3_000_000
    with zipfile.ZipFile(target / "2.zip") as z:
        assert z.namelist() == ["document.json"] and z.read("document.json") == b"{}"
    for bad in ([*rows, (1, "{}", None, None)], [(9, "{}", None, [("x", None)]), *rows]):
        with pytest.raises(Exception):  # noqa: B017, PT011  of one document twice, and of a part without bytes
            write_archives(spark.createDataFrame(bad, ARCHIVE).repartition(4), str(target))
        assert sorted(p.name for p in target.iterdir()) == ["1.zip", "2.zip", "3.zip"]
        with zipfile.ZipFile(target / "1.zip") as z:
            assert "images/p.png" in z.namelist()
    write_archives(spark.createDataFrame(rows[1:2], ARCHIVE), str(target), markdown=False)
    assert [p.name for p in target.iterdir()] == ["2.zip"]
    spark.createDataFrame(rows[:1], ARCHIVE).write.format("archives").mode("append").save(f"file://{target}")
    assert sorted(p.name for p in target.iterdir()) == ["1.zip", "2.zip"]


def test_overlaps_are_joined_by_tiles(spark):
    """A page of many tokens: as counted in numpy, no nested loop in the plan, and the page is shared among tasks."""
    r = np.random.default_rng(2)
    n, m = 20_000, 200
    box = lambda k, size: [(int(x), int(y), int(w), int(h)) for x, y, w, h in zip(r.integers(-300, 3000, k), r.integers(-300, 20_000, k), r.integers(1, size, k), r.integers(1, size, k), strict=True)]
    t, g = box(n, 40), box(m, 900)
    tok = spark.createDataFrame([(1, 1, i, "x", x, y, x + w, y + h, w, h) for i, (x, y, w, h) in enumerate(t)], "doc_id long, page_number int, pos int, content string, `left` int, top int, `right` int, bottom int, width int, height int")
    reg = spark.createDataFrame([(1, 1, i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(g)], "doc_id long, page_number int, region_seq int, `left` int, top int, `right` int, bottom int")
    a, b = np.array(t), np.array(g)
    want = (a[:, None, 0] + a[:, None, 2] > b[:, 0]) & (a[:, None, 0] < b[:, 0] + b[:, 2]) & (a[:, None, 1] + a[:, None, 3] > b[:, 1]) & (a[:, None, 1] < b[:, 1] + b[:, 3])
    df = OPERATORS["rect_overlap_open"](tok=tok, reg=reg)
    got = {x["pos"]: x["n"] for x in df.collect()}
    assert [got[i] for i in range(n)] == want.sum(1).tolist() and want.sum() > 1000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "tile_x" in plan


def test_from_pdfs_to_archives(spark, tmp_path):
    """PDFs that fail have no archive; parts are there as asked for."""
    pdfs = spark.createDataFrame([(1, b"good"), (2, b"bad")], "doc_id long, pdf binary")

    def convert(pdf, hidden):
        if pdf == b"bad":
            raise ValueError("no PDF")
        return XML

    crops = spark.createDataFrame([(1, "image_page1_1_2.png", b"png"), (1, "image_page1_3_4.png", None)], "doc_id long, filename string, bytes binary")
    failed = parse.parse_to_archives(pdfs, f"{tmp_path}/a", convert=convert, crops=crops)
    assert [(r["doc_id"], r["error"]) for r in failed.collect()] == [(2, "ValueError: no PDF")]
    with zipfile.ZipFile(tmp_path / "a" / "1.zip") as z:
        assert z.namelist() == ["document.json", "markdown.md", "images/image_page1_1_2.png"]
        document, md = json.loads(z.read("document.json")), z.read("markdown.md").decode()
    assert document["num_pages"] == 2 and md
    parse.parse_to_archives(pdfs, f"{tmp_path}/b", 72, False, False, convert, crops)
    with zipfile.ZipFile(tmp_path / "b" / "1.zip") as z:
        assert z.namelist() == ["document.json"]
    with pytest.raises(ValueError, match="dpi"):
        parse.parse_to_archives(pdfs, f"{tmp_path}/c", 601)
    (r,) = parse.preview(spark.createDataFrame([(1, md)], "doc_id long, md string"), 3).collect()
    assert (r["preview"], r["more"]) == (md[:3], True)
    assert parse.health(spark, f"{tmp_path}/a") == {"status": "ok", "model_available": True} and not parse.health(spark, f"{tmp_path}/none")["model_available"]
