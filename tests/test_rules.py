"""Rows worked out by hand from the rules, for layout operators: independent of the SQL that both engines share."""

import json

import numpy as np
import pytest

from pagewright.functions import raster
import pagewright.operators  # noqa: F401  registers the operators
from pagewright.plans.dual import OPERATORS
from pagewright.sources import sinks

TOK = "doc_id long, page_number int, pos int, content string, `left` int, top int, `right` int, bottom int, width int, height int, font_id int, token_type int"
REG = "doc_id long, page_number int, region_seq int, `left` int, top int, `right` int, bottom int, width int, height int, area int, region_type string, aspect_ratio double, fill_density double, edge_density double, color_variance double, h_lines int, v_lines int"


def tok(*rows):
    """(pos, content, left, top, right, bottom[, type[, page[, font]]])"""
    out = []
    for pos, content, x0, y0, x1, y1, *more in rows:
        kind, page, font = [*more, *(6, 1, 0)[len(more) :]]
        out.append((1, page, pos, content, x0, y0, x1, y1, x1 - x0, y1 - y0, font, kind))
    return out, TOK


def reg(*rows, **statistics):
    """(seq, type, left, top, right, bottom[, fill, edge, variance, aspect, h_lines, v_lines])"""
    out = []
    for seq, kind, x0, y0, x1, y1, *more in rows:
        fill, edge, variance, aspect, h, v = [*more, *(0.5, 0.05, 100.0, None, 0, 0)[len(more) :]]
        w, hh = x1 - x0, y1 - y0
        out.append((1, 1, seq, x0, y0, x1, y1, w, hh, w * hh, kind, aspect if aspect is not None else w / hh, fill, edge, variance, h, v))
    return out, REG


PAGES = ([(1, 1, 600, 800), (1, 2, 600, 800)], "doc_id long, page_number int, page_width int, page_height int")
FONTS = ([(1, 0, "Times", 12.0, False, False, "#000000"), (1, 1, "Times-Bold", 14.0, True, False, "#ff0000"), (2, 0, "Other", 99.0, False, True, "#0000ff")], "doc_id long, font_id int, family string, font_size double, bold boolean, italics boolean, color string")


@pytest.fixture
def rows(spark):
    def run(key, columns, **frames):
        op = OPERATORS[key]
        made = {k: spark.createDataFrame(*frames[k]) for k in op.inputs}
        got = [tuple(r[c] for c in columns.split()) for r in op(**made).collect()]
        return sorted(got, key=lambda r: tuple((x is not None, x) for x in r))

    return run


def test_list_levels(rows):
    marks = ["- a", "plain", "  • b", "- c", " d", "‣ e", "⁃ f", "⦿ g", "T x", "* y", "", "   "]
    frame = [(1, 1, i + 1, c) for i, c in enumerate(marks)] + [(2, 1, 1, "• first here")]
    got = rows("list_levels", "doc_id pos level", listed=(frame, "doc_id long, page_number int, pos int, content string"))
    assert got == [(1, 1, 0), (1, 2, -1), (1, 3, 1), (1, 4, 0), (1, 5, 2), (1, 6, 3), (1, 7, 3), (1, 8, 3), (1, 9, -1), (1, 10, -1), (1, 11, -1), (1, 12, -1), (2, 1, 0)]


def test_list_markdown(rows):
    frame = ([(1, 1, 1, "- a", 0), (1, 1, 2, "• b", 2), (1, 1, 3, "c", -1)], "doc_id long, page_number int, pos int, content string, level int")
    assert rows("list_markdown", "pos md html", leveled=frame) == [(1, "-  a", "- a"), (2, "    -  b", "<ul><li><ul><li>• b</li></ul></li></ul>"), (3, "c", "c")]


STYLED = TOK + ", common_height int"


def test_title_level(rows):
    sizes = [(1, 5, 20), (2, 5, 19), (3, 8, 14), (4, 8, 13), (5, 5, 12), (6, 8, 11), (7, 6, 40)]
    frame = [(1, 1, pos, " t ", 0, 0, 10, h, 10, h, 0, kind, 10) for pos, kind, h in sizes]
    got = rows("title_level", "pos level md html", styled=(frame, STYLED))
    assert [(p, lv) for p, lv, *_ in got] == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 4), (7, 0)]
    assert got[0][2:] == ("# t", "<h1>t</h1>") and got[6][2:] == (" t ", " t ")


def test_script_type(rows):
    line = [(1, "word", 100, 100, 200, 120, 6), (2, "2", 200, 98, 206, 106, 6), (3, "3", 206, 114, 212, 122, 6), (4, "12", 300, 400, 310, 408, 6), (5, "7", 206, 98, 212, 106, 3), (6, "x", 212, 98, 218, 106, 6), (7, "88", 218, 100, 240, 120, 6)]
    frame = [(1, 1, p, c, x0, y0, x1, y1, x1 - x0, y1 - y0, 0, k, 20) for p, c, x0, y0, x1, y1, k in line]
    got = dict(rows("script_type", "pos styled", styled=(frame, STYLED)))
    # above the middle, below it; alone on its line; in a table; no number; too high
    assert got == {1: "word", 2: "<sup>2</sup>", 3: "<sub>3</sub>", 4: "12", 5: "7", 6: "x", 7: "88"}


def test_link_markdown(rows):
    frame = ([(1, 1, 1, "see z and z", "z", "http://z", "WEB_URL"), (1, 1, 2, "see p", "p", "#p", "DOCUMENT_REFERENCE"), (1, 1, 3, "none", "", "", "NO_LINK")], "doc_id long, page_number int, pos int, content string, link_text string, link string, link_type string")
    assert rows("link_markdown", "pos md html", linked=frame) == [(1, "see [z](http://z) and [z](http://z)", 'see <a href="http://z">z</a> and <a href="http://z">z</a>'), (2, "see p", "see p"), (3, "none", "none")]


def test_style_markdown_and_token_font(rows):
    frame = tok((1, "a", 0, 0, 9, 9), (2, "b", 0, 0, 9, 9, 6, 1, 1), (3, "c", 0, 0, 9, 9, 6, 1, 7))
    assert rows("style_markdown", "pos md html", tok=frame, font=FONTS) == [(1, "a", "a"), (2, "**b**", "<b>b</b>"), (3, "c", "c")]
    assert rows("token_font", "pos bold font_size color", tok=frame, font=FONTS) == [(1, False, 12.0, "#000000"), (2, True, 14.0, "#ff0000"), (3, None, None, None)]


def test_rect_fix(rows):
    frame = ([(1, 1, 0, 5, 5, 5, 5), (1, 1, 1, 9, 8, 2, 3), (1, 1, 2, 1, 2, 3, 4)], "doc_id long, page_number int, region_seq int, `left` int, top int, `right` int, bottom int")
    assert rows("rect_fix", "region_seq left top right bottom width height", raw=frame) == [(0, 4, 4, 6, 6, 2, 2), (1, 2, 3, 9, 8, 7, 5), (2, 1, 2, 3, 4, 2, 2)]


def test_token_type_lookup(rows):
    frame = ([(1, 1, 1, 3, "table"), (1, 1, 2, -1, "Table"), (1, 1, 3, 11, "nothing"), (1, 1, 4, -12, "List item")], "doc_id long, page_number int, pos int, k int, n string")
    assert rows("token_type_lookup", "pos by_index by_name by_value", names=frame) == [(1, "Table", 3, 6), (2, "Page footer", 3, 3), (3, "Text", 6, 6), (4, "Text", 6, 2)]


def test_overlaps(rows):
    t, r = tok((1, "a", 10, 10, 20, 20)), reg((0, "Table", 20, 10, 30, 20), (1, "Figure", 15, 15, 40, 40), (2, "Logo", 50, 50, 60, 60))
    assert rows("rect_overlap_open", "pos n", tok=t, reg=r) == [(1, 1)] and rows("rect_overlap_closed", "pos n", tok=t, reg=r) == [(1, 2)]
    assert rows("intersection_pct", "region_seq pct", tok=t, reg=r) == [(0, 0.0), (1, 25.0), (2, 0.0)]
    assert rows("token_region_overlap", "left top touches", tok=t, reg=reg((0, "ScannedPage", 0, 0, 99, 99))) == [(10, 10, False)]


def test_region_filters(rows):
    r = reg((0, "Figure", 0, 0, 40, 34), (1, "Figure", 0, 0, 39, 40), (2, "Figure", 0, 0, 60, 22), (3, "Figure", 0, 0, 60, 25))
    assert rows("region_size_filter", "region_seq", reg=r) == [(0,)]  # at 100 dpi: 1333 cells, 40 wide, 26 high
    r = reg((0, "Figure", 0, 0, 9, 9, 0.1, 0.5), (1, "Figure", 0, 0, 9, 9, 0.95, 0.02), (2, "Figure", 0, 0, 9, 9, 0.95, 0.01), (3, "Figure", 0, 0, 9, 9, 0.5, 0.5, 0.0, 21.0))
    assert rows("region_shape_filter", "region_seq grayscale morphological", reg=r) == [(0, False, True), (1, True, False)]
    cand = ([(1, 1, 0, 0, 0, 0, 0, 336_000), (1, 1, 1, 0, 0, 0, 0, 240_000)], "doc_id long, page_number int, region_seq int, `left` int, top int, `right` int, bottom int, area int")
    assert rows("region_page_fraction", "region_seq fraction", cand=cand, page=PAGES) == [(1, 0.5)]


def test_crop_box(rows):
    cand = ([(1, 1, 0, -5, 10, 100, 900, 1), (1, 1, 1, 600, 10, 700, 20, 1), (1, 1, 2, -50, 10, -5, 20, 1), (1, 1, 3, 10, 10, 10, 20, 1)], "doc_id long, page_number int, region_seq int, `left` int, top int, `right` int, bottom int, area int")
    assert rows("crop_box", "x0 y0 x1 y1", cand=cand, page=PAGES) == [(0, 20, 208, 1666)]


def test_pages(rows):
    t, image = tok((1, "a", 0, 0, 9, 9)), ([(1, 1)], "doc_id long, page_number int")
    none = ([], "doc_id long, page_number int")
    assert rows("scanned_pages", "page_number", page=PAGES, printed=t) == [(2,)]
    assert rows("pages_needing_detection", "page_number", page=PAGES, printed=t, pictured=image) == [(1,), (2,)]
    assert rows("pages_needing_detection", "page_number", page=PAGES, printed=t, pictured=none) == [(2,)]
    assert rows("table_pages", "page_number", page=PAGES, reg=reg((0, "Table", 0, 0, 5, 5), (1, "Table", 0, 0, 5, 5))) == [(1,)]


def test_mistakes(rows):
    frame = ([(1, 1, i, 0, t, p) for i, (t, p) in enumerate([(1, 0.5), (1, 1.5), (2, 2.5), (0, 1.0), (1, 0.0)])], "doc_id long, page_number int, pos int, seq int, truth int, prediction double")
    assert rows("mistake_type", "pos mistake", judged=frame) == [(0, 2), (1, 1), (2, 0), (3, 1), (4, 2)]
    guess = ([(1, 1, 1, 0, 3, 3), (1, 1, 2, 0, 4, 4), (2, 1, 1, 0, 4, 5)], "doc_id long, page_number int, pos int, seq int, token_type int, predicted_type int")
    assert rows("all_correct", "doc_id correct", guess=guess) == [(1, True), (2, False)]


def test_merges(rows):
    frame = ([(1, 1, 0, 1, "b", 20, 5, 30, 15, 2), (1, 1, 0, 0, "a", 10, 6, 18, 14, 5), (1, 2, 0, 0, "c", 0, 0, 1, 1, 6)], "doc_id long, page_number int, line_no int, frag_no int, content string, `left` int, top int, `right` int, bottom int, token_type int")
    assert rows("merge_tokens", "page_number txt left top right bottom token_type", frag=frame) == [(1, "a b", 10, 5, 30, 15, 5), (2, "c", 0, 0, 1, 1, 6)]
    assert rows("merge_rectangles", "page_number width height", frag=frame) == [(1, 20, 10), (2, 1, 1)]


def test_modes_and_sizes(rows):
    frame = tok((1, "a", 0, 0, 50, 10), (2, "b", 0, 14, 70, 24), (3, "c", 0, 28, 70, 38, 6, 1, 1), (4, "d", 0, 44, 60, 54, 6, 1, 1))
    assert rows("doc_modes", "lines_space_mode right_space_mode", tok=frame, page=PAGES) == [(4, 530)]
    assert rows("font_mode", "font_id font_size_mode", tok=frame, font=FONTS) == [(0, 12.0)]  # a tie: the first seen
    assert rows("body_font_size", "body_font_size", tok=frame, font=FONTS) == [(14.0,)]  # upper median of 12, 12, 14, 14


def test_contexts(rows):
    frame = tok((1, "a", 10, 0, 20, 10), (2, "b", 30, 1, 40, 11), (3, "c", 50, 2, 60, 12), (4, "d", 10, 40, 20, 50))
    got = rows("token_context", "pos right_of_token_on_the_left left_of_token_on_the_left left_of_token_on_the_right right_of_token_on_the_right", tok=frame)
    assert got == [(1, 0, 0, 30, 60), (2, 20, 10, 50, 60), (3, 40, 10, 0, 0), (4, 0, 0, 0, 0)]
    assert rows("same_line_pairs", "pos n first_pos last_pos", tok=frame) == [(1, 3, 1, 3), (2, 3, 1, 3), (3, 3, 1, 3), (4, 1, 4, 4)]
    assert rows("closest_below", "pos gap", tok=frame) == [(1, 30), (2, 29), (3, 28)]
    assert rows("context_window", "pos gaps", tok=frame)[0] == (1, "-2,-2,-2,9,10,10,-50,-21")  # padding is a box of no size, made two wide


def test_transitions(rows):
    got = {(a, b): p for a, b, p in rows("transition_matrix", "prev curr p", tok=tok((1, "a", 0, 0, 1, 1, 5), (2, "b", 0, 0, 1, 1, 6), (3, "c", 0, 0, 1, 1, 6), (1, "d", 0, 0, 1, 1, 6, 2)))}
    assert len(got) == 121 and got[5, 6] == 2 / 12 and got[5, 5] == 1 / 12 and got[6, 6] == 2 / 12 and got[0, 3] == 1 / 11


def test_label_assign(rows):
    labels = ([(1, 1, 1, 0, 0, 100, 100, 3), (1, 1, 2, 0, 0, 20, 10, 5), (1, 1, 3, 30, 0, 100, 100, 4)], "doc_id long, page_number int, seq int, `left` int, top int, width int, height int, label_type int")
    frame = tok((1, "a", 0, 0, 20, 10), (2, "b", 25, 0, 35, 10), (3, "c", 500, 500, 510, 510))
    # fills label 2; partly in 1 and 3, of which 1 has the larger share of itself; none
    assert rows("label_assign", "pos label_type", tok=frame, lab=labels) == [(1, 5), (2, 3), (3, 6)]


def test_classification(rows):
    r = reg((0, "Figure", 0, 0, 9, 9), (1, "x", 0, 0, 9, 9, 0.9, 0.5, 0.0, 1.0, 3, 3), (2, "x", 0, 0, 9, 9, 0.95, 0.04, 501.0), (3, "x", 0, 0, 9, 9, 0.3, 0.04), (4, "x", 0, 0, 9, 9, 0.8, 0.11), (5, "x", 0, 0, 9, 9, 0.8, 0.03, 500.0, 1.1), (6, "x", 0, 0, 9, 9, 0.8, 0.05, 10.0, 0.7), (7, "x", 0, 0, 9, 9, 0.8, 0.05, 10.0, 0.8))
    assert [k for _, k in rows("classify_regions", "region_seq region_type", reg=r)] == ["Figure", "Table", "Photo", "Chart", "Chart", "Logo", "Formula", "Figure"]


def test_type_override(rows):
    t = tok(*[(i, "x", i, 0, i + 1, 1, k) for i, k in enumerate([3, 3, 6, 6, 6, 6, 6])], *[(20 + i, "x", 50 + i, 0, 51 + i, 1, 4) for i in range(3)])
    r = reg((0, "Figure", 0, 0, 10, 5), (1, "Formula", 0, 0, 10, 5), (2, "Logo", 45, 0, 60, 5), (3, "Photo", 45, 0, 60, 5), (4, "Chart", 90, 90, 99, 99))
    assert rows("region_type_override", "region_seq region_type", reg=r, tok=t) == [(0, "Table"), (1, "Formula"), (2, "Figure"), (3, "Photo"), (4, "Chart")]


def test_dedup_regions(rows):
    r = reg((0, "Photo", 0, 0, 100, 100), (1, "Figure", 10, 10, 20, 20), (2, "Table", 10, 10, 20, 20), (3, "Chart", 0, 0, 100, 100), (4, "Logo", 90, 90, 110, 110))
    assert rows("dedup_regions", "region_seq", reg=r) == [(0,), (2,), (4,)]


STRUCTURE = "doc_id long, page_number int, `left` int, top int, tsr_seq int, num_cells int, xml string, readable boolean"
XML_CELLS = """<table>
  <cell row="0" column="0"><boundingbox x="0" y="0" w="20.5" h="10"/></cell><cell column="2"><boundingbox x="40" y="0" w="20" h="10"/></cell>
  <cell row="3" column="9"/>
  <cell row="2" column="1"><boundingbox w="20" h="10" y="20" x="20"/></cell>
</table>"""


def structures(spark, frame):
    """The relations that table_fallback and xml_table_md take."""
    made = spark.createDataFrame(frame, STRUCTURE)
    return {"structure": made, "xmlcell": OPERATORS["xml_cells"](structure=made)}


def test_table_fallback(spark):
    r = spark.createDataFrame(*reg(*[(k, "Table", 10 * k, 0, 10 * k + 5, 5) for k in range(7)], (9, "Photo", 0, 0, 5, 5)))
    frame = [(1, 1, 10, 0, 0, 9, None, False), (1, 1, 20, 0, 0, 0, None, False), (1, 1, 30, 0, 0, 0, "<broken", False), (1, 1, 40, 0, 0, 0, "", False), (1, 1, 40, 0, 1, 0, "<t/>", True), (1, 1, 50, 0, 0, 0, XML_CELLS, True), (1, 1, 60, 0, 0, 0, '<table><cell row="0"/></table>', True)]
    got = sorted((x["region_seq"], x["md"]) for x in OPERATORS["table_fallback"](reg=r, **structures(spark, frame)).collect())
    note = "<!-- Table{} -->\n\n".format
    assert got == [(0, note(" detected but no TSR data")), (1, ""), (2, note(": no XML")), (3, note(": invalid XML")), (4, note(": no cells")), (5, ""), (6, note(": no cells"))]


def test_tables_from_xml(spark):
    """Cells of the last structure's XML, those without a box left out, in a whole grid; one with cells of its own isn't read."""
    r = spark.createDataFrame(*reg((0, "Table", 100, 50, 160, 80), (1, "Table", 300, 50, 360, 80)))
    frame = [(1, 1, 100, 50, 0, 0, "<broken", False), (1, 1, 100, 50, 1, 0, XML_CELLS, True), (1, 1, 300, 50, 0, 4, XML_CELLS, True)]
    made = structures(spark, frame)
    cells = sorted(tuple(x[c] for c in ("left", "tsr_seq", "n", "row", "col", "x", "y", "w", "h")) for x in made["xmlcell"].where("`left` = 100").collect())
    assert cells == [(100, 1, 0, 0, 0, 0.0, 0.0, 20.5, 10.0), (100, 1, 1, 0, 2, 40.0, 0.0, 20.0, 10.0), (100, 1, 3, 2, 1, 20.0, 20.0, 20.0, 10.0)]
    points = OPERATORS["cells_in_points"](xmlcell=made["xmlcell"].where("`left` = 100 and n = 0")).collect()
    assert [(r["x"], r["w"], r["h"]) for r in points] == [(0.0, pytest.approx(9.84), pytest.approx(4.8))]
    tokens = spark.createDataFrame(*tok((1, "a", 102, 52, 110, 58), (2, "b", 142, 52, 150, 58), (3, "c", 121, 71, 130, 79)))
    (got,) = OPERATORS["xml_table_md"](reg=r, tok=tokens, **made).collect()
    assert (got["region_seq"], got["md"]) == (0, "| a |  | b |\n| --- | --- | --- |\n|  |  |  |\n|  | c |  |")


def test_ragged_tables(rows):
    """Cells (0,0), (0,2), (2,1): the grid is whole, empty row and rule included."""
    cells = ([(1, 1, 0, 0, 0, r, c, 50.0 * c, 20.0 * r, 50.0, 20.0) for r, c in ((0, 0), (0, 2), (2, 1))], CELL)
    frame = tok((1, "a", 5, 5, 15, 15), (2, "b", 105, 5, 115, 15), (3, "c", 55, 45, 65, 55))
    assert rows("md_table", "md", cell=cells, tok=frame) == [("| a |  | b |\n| --- | --- | --- |\n|  |  |  |\n|  | c |  |",)]


def test_text_in_bbox(rows):
    """A box of 200 x 100 reaches ten further each way; over a tenth of a token must lie within; boxes without text give ''."""
    r = reg((0, "Figure", 100, 100, 300, 200), (1, "Figure", 400, 400, 405, 405), (2, "Figure", 500, 500, 500, 520))
    frame = tok((1, "edge", 302, 150, 322, 160), (2, "far", 310, 150, 330, 160), (3, "left", 91, 101, 111, 111), (4, "tenth", 308, 120, 328, 130), (5, "low", 100, 209, 120, 219), (6, "one", 406, 400, 407, 401))
    assert rows("text_in_bbox", "region_seq txt", reg=r, tok=frame) == [(0, "left edge"), (1, ""), (2, "")]


def test_digits_of_other_kinds(rows):
    frame = ([(1, 1, i + 1, c, 6, 0, 0, 10, 5, 10, 5, 12) for i, c in enumerate(["²", "٣", "½", "1²", "x"])] + [(1, 1, 9, "line", 6, 0, 0, 90, 14, 90, 14, 12)], "doc_id long, page_number int, pos int, content string, token_type int, `left` int, top int, `right` int, bottom int, width int, height int, common_height int")
    assert rows("script_type", "pos styled", styled=frame)[:5] == [(1, "<sup>²</sup>"), (2, "<sup>٣</sup>"), (3, "½"), (4, "<sup>1²</sup>"), (5, "x")]
    got = rows("text_features", "pos is_numeric contains_digit digit_ratio", tok=tok(*[(i + 1, c, 0, 0, 5, 5) for i, c in enumerate(["²", "½", "1.²,③", "a¹b"])]), font=FONTS)
    assert got == [(1, 1, 1, 1.0), (2, 0, 0, 0.0), (3, 1, 1, 0.6), (4, 0, 1, 1 / 3)]


def test_separators_have_no_category(rows):
    assert rows("unicode_categories", "pos slots", tok=tok((1, "\u2028a", 0, 0, 5, 5), (2, "b\u2029", 0, 0, 5, 5))) == [(1, "-1,12,-1,-1,-1,-1,-1,-1"), (2, "12,-1,-1,-1,-1,-1,-1,-1")]


def test_picture_markdown(rows):
    base, schema = reg((0, "Photo", 1, 2, 11, 22), (1, "Figure", 3, 4, 13, 14), (2, "Table", 0, 0, 1, 1))
    frame = ([(*r, c) for r, c in zip(base, (b"png", None, None), strict=True)], schema + ", crop binary")
    assert rows("picture_markdown", "region_seq placeholder url embed", cropped=frame) == [
        (0, "<!-- Photo at (1,2) 10x20 -->\n\n[Photo p1](image_page1_1_2.png)", "![Photo p1](images/image_page1_1_2.png)", "![Photo p1](data:image/png;base64,cG5n)"),
        (1, "<!-- Figure at (3,4) 10x10 -->\n\n[Figure p1](image_page1_3_4.png)", "![Figure p1](images/image_page1_3_4.png)", "[Figure p1](image_page1_3_4.png)"),
    ]


CELL = "doc_id long, page_number int, region_seq int, region_left int, region_top int, `row` int, col int, x double, y double, w double, h double"
TSR = "doc_id long, page_number int, `left` int, top int, `right` int, bottom int, region_seq int, tsr_seq int, num_cells int"


def test_document_json(rows):
    cells = ([(1, 1, 0, 0, 0, 0, 0, 0.0, 0.0, 20.5, 10.0), (1, 1, 0, 0, 0, 0, 1, 50.0, 0.0, 10.0, 10.0)], CELL)
    tsr = ([(1, 1, 0, 0, 60, 30, 0, 0, 4), (1, 1, 0, 0, 60, 30, 0, 1, 2)], TSR)
    r = reg((0, "Table", 0, 0, 60, 30), (1, "Figure", 0, 0, 60, 30))
    (got,) = rows("document_json", "json", tok=tok((1, 'say "a\\b"', 5, 5, 15, 9, 5), (2, "é\n", 300, 5, 315, 9)), page=PAGES, reg=r, tsr=tsr, cell=cells)
    box = lambda *x: dict(zip(("left", "top", "right", "bottom"), x, strict=True))
    region = lambda kind, **more: {"region_type": kind, "bounding_box": box(0, 0, 60, 30), "width": 60, "height": 30, "area": 1800, "aspect_ratio": 2.0} | more
    cell = lambda col, b, text: {"row": 0, "col": col, "bounding_box": b, "text": text}
    found = {"num_cells": 2, "cells": [cell(0, box(0, 0, 20, 10), 'say "a\\b"'), cell(1, box(50, 0, 60, 10), "")]}
    tokens = [{"text": 'say "a\\b"', "token_type": "Title", "bounding_box": box(5, 5, 15, 9)}, {"text": "é\n", "token_type": "Text", "bounding_box": box(300, 5, 315, 9)}]
    page = lambda n, t, g: {"page_number": n, "width": 600, "height": 800, "tokens": t, "regions": g}
    assert json.loads(got[0]) == {"pages": [page(1, tokens, [region("Table", tsr_result=found), region("Figure")]), page(2, [], [])], "num_pages": 2, "num_tokens": 2, "num_regions": 2}


def test_cell_text(rows):
    cells = ([(1, 1, 0, 100, 100, 0, c, 50.0 * c, 0.0, 50.0, 20.0) for c in range(2)], CELL)
    frame = tok((1, "left one", 100, 102, 140, 112), (2, "a b c d", 130, 104, 170, 114), (3, "away", 400, 400, 410, 410))
    assert rows("cell_text_md", "col txt", cell=cells, tok=frame) == [(0, "left one a b"), (1, "c d")]
    assert rows("md_table", "md", cell=cells, tok=frame) == [("| left one a b | c d |\n| --- | --- |",)]
    assert rows("cell_text_json", "col txt", cell=cells, tok=frame) == [(0, ""), (1, "")]  # boxes of cells aren't moved


def test_table_structures(rows):
    box = "doc_id long, page_number int, region_seq int, seq int, x int, y int, w int, h int, img_w int, img_h int"
    frame = ([(1, 1, 0, s, x, y, w, 10, 200, 200) for s, (x, y, w) in enumerate([(0, 0, 40), (60, 1, 40), (0, 20, 40), (60, 21, 40), (120, 22, 40), (0, 60, 190), (0, 90, 40)])], box)
    assert rows("tsr_box_filter", "seq", box=frame) == [(s,) for s in (0, 1, 2, 3, 4, 6)]
    assert rows("tsr_rows", "seq row_no", box=frame) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)]
    assert rows("tsr_column_centers", "col center", box=frame) == [(0, 20), (1, 80), (2, 140)]
    assert rows("tsr_column_assign", "seq row_no col", box=frame) == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 1, 2)]


def test_table_xml(rows):
    box = "doc_id long, page_number int, region_seq int, seq int, x int, y int, w int, h int, img_w int, img_h int"
    frame = ([(1, 1, 0, s, x, y, 40, 10, 200, 200) for s, (x, y) in enumerate([(0, 0), (60, 1), (2, 2), (0, 30), (60, 30)])] + [(1, 1, 1, 0, 0, 0, 199, 10, 200, 200)], box)
    cell = '  <cell row="{}" column="{}">\n    <boundingbox x="{}" y="{}" w="40" h="10"/>\n  </cell>\n'.format
    got = dict(rows("tsr_xml", "region_seq xml", box=frame))
    # three boxes of the first row make three columns; those of the second go to the nearest
    assert got[1] == "<table/>\n" and got[0].startswith("<table>\n" + cell(0, 0, 0, 0)) and got[0].endswith(cell(1, 2, 60, 30) + "</table>\n")


def test_text_mask():
    ink = np.zeros((60, 300), bool)
    ink[20:26, 20:40] = ink[20:26, 60:80] = ink[20:26, 200:220] = True
    mask = raster.text_mask(ink, 150)
    # kernels of even size move what they close by one
    assert mask[21:27, 21:81].all() and not mask[20:28, 100:190].any() and mask[21:27, 201:221].all() and not mask[:15].any()


def test_predictions(rows):
    pred = ([(1, 1, 0, 10, 10, 3), (1, 1, 1, 10, 10, 4), (1, 1, 2, 95, 10, 5), (1, 1, 3, 500, 500, 7)], "doc_id long, page_number int, seq int, `left` int, top int, token_type int")
    frame = tok((1, "a", 10, 10, 20, 20), (2, "b", 100, 10, 110, 20), (3, "c", 300, 10, 310, 20))
    assert rows("apply_predictions", "pos token_type", tok=frame, pred=pred) == [(1, 4), (2, 5), (3, 6)]


def test_embedded_images(rows):
    img = "doc_id long, page_number int, seq int, page_w double, page_h double, a double, b double, c double, d double, e double, f double, has_text boolean"
    frame = ([(1, 1, 0, 600.0, 800.0, 100.0, 0.0, 0.0, 50.0, 10.0, 20.0, True), (1, 1, 1, 600.0, 800.0, 590.0, 0.0, 0.0, 790.0, 5.0, 5.0, False), (1, 1, 2, 600.0, 800.0, 590.0, 0.0, 0.0, 790.0, 5.0, 5.0, True)], img)
    assert rows("embedded_image_regions", "seq region_type left top width height area", img=frame) == [(0, "Figure", 10, 730, 100, 50, 5000), (1, "ScannedPage", 0, 0, 600, 800, 480000)]


def test_lines_and_reading_order(rows):
    schema = TOK + ", reading_order_no int"
    base = tok((1, "a", 0, 0, 9, 10), (2, "b", 0, 8, 9, 18), (3, "c", 0, 30, 9, 40))[0]
    got = rows("reading_order_features", "pos gap_norm percentile_1 percentile_2 adjacent", ord=([(*r, n) for r, n in zip(base, (1, 5, 3), strict=True)], schema))
    assert got == [(1, 4 / 3, 0.0, 2.0, 0), (2, -2 / 3, 2.0, 1.0, 1)]


def test_text_features(rows):
    columns = "pos is_all_caps starts_with_capital is_title_case is_numeric contains_digit digit_ratio ends_with_period word_count is_bold"
    got = rows("text_features", columns, tok=tok((1, "ABC", 0, 0, 1, 1, 6, 1, 1), (2, "The End.", 0, 0, 1, 1), (3, "1,2.5", 0, 0, 1, 1), (4, "A", 0, 0, 1, 1)), font=FONTS)
    assert got == [(1, 1, 1, 0, 0, 0, 0.0, 0, 0.05, 1), (2, 0, 1, 1, 0, 0, 0.0, 1, 0.1, 0), (3, 0, 0, 0, 1, 1, 0.6, 0, 0.05, 0), (4, 0, 1, 0, 0, 0, 0.0, 0, 0.05, 0)]


def test_long_titles_are_read_without_a_frame_of_the_stack_a_word(rows):
    kinds = ["Ab " * 5000, "Ab " * 5000 + "c", "A1" * 40_000, "A" * 9000 + "b", " . " * 3000 + "Ab"]
    got = rows("text_features", "pos is_title_case", tok=tok(*[(i + 1, c, 0, 0, 1, 1) for i, c in enumerate(kinds)]), font=FONTS)
    assert got == [(1, 1), (2, 0), (3, 1), (4, 0), (5, 1)]


def test_title_case_is_that_of_the_oracle(spark):
    import duckdb

    parts = np.random.default_rng(5).choice(["A", "b", "\u01c5", "É", "ß", "1", " ", ".", "中", "\u0301", "Ab", "\U0001d400", "\U0001d41a"], (1500, 6))
    names, kinds = [c.strip(" `") for c in TOK.replace(" int", "").replace(" long", "").replace(" string", "").split(",")], TOK
    data = [(1, 1, i, "".join(p[: i % 7]), 0, 0, 1, 1, 1, 1, 0, 6) for i, p in enumerate(parts.tolist())]
    got = OPERATORS["text_features"](tok=spark.createDataFrame(data, kinds), font=spark.createDataFrame(*FONTS)).select("pos", "is_title_case").collect()
    con = duckdb.connect()
    con.execute(f"create table tok ({', '.join(chr(34) + n + chr(34) + (' varchar' if n == 'content' else ' bigint') for n in names)})")
    con.executemany(f"insert into tok values ({', '.join('?' * len(names))})", data)
    con.execute("create table font (doc_id bigint, font_id bigint, bold boolean, italics boolean)")
    want = dict(con.execute(f"select pos, is_title_case from ({OPERATORS['text_features'].oracle()})").fetchall())
    assert dict(map(tuple, got)) == want and 0 < sum(want.values()) < 1500


def test_sinks(spark, tmp_path):
    features = spark.createDataFrame([(1, 1, 1, [0.5, 1.0], 3)], "doc_id long, page_number int, pos int, features array<float>, label int")
    sinks.write_features(features, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").collect() == features.collect()
    sinks.write_mistakes(spark.createDataFrame([(1, 1, 1, 0), (2, 1, 1, 0), (2, 1, 2, 2)], "doc_id long, page_number int, pos int, mistake int"), f"{tmp_path}/m")
    assert {r["doc_id"]: r["status"] for r in spark.read.json(f"{tmp_path}/m/status").collect()} == {1: "finished", 2: "open"}
    assert spark.read.json(f"{tmp_path}/m/mistakes").count() == 3
    sinks.write_json(spark.createDataFrame([(1, '{"a":1}')], "doc_id long, json string"), f"{tmp_path}/j")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/j").collect()] == ['{"a":1}']


def test_failed_crops_are_kept(spark):
    crops = spark.createDataFrame([(1, 1, 0, 10, 10, bytes(100)), (1, 1, 1, 10, 10, bytes(7))], "doc_id long, page_number int, region_seq int, img_w int, img_h int, gray binary")
    got = {r["region_seq"]: r["error"] for r in raster.table_boxes(crops, "bordered").collect()}
    assert "50 pixels" in got[0] and "reshape" in got[1]
