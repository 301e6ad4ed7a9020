"""XML that isn't well formed: every later page stays, whatever is wrong before it."""

import xml.etree.ElementTree as ET

import pytest

from pagewright.sources import poppler
from pagewright.sources.recovery import recovered

GOOD = """<?xml version="1.0"?>
<pdf2xml><page number="1" width="600" height="800"><fontspec id="0" size="12" family="Times" color="#000000"/>
<text top="10" left="10" width="50" height="12" font="0">first <b>bold</b></text>
<text top="30" left="10" width="50" height="12" font="0">second <a href="http://x.example/">link</a></text></page>
<page number="2" width="600" height="800"><text top="10" left="10" width="50" height="12" font="0">third &amp; last</text></page></pdf2xml>"""

WHOLE = [(1, 1, "first bold"), (1, 2, "second link"), (2, 1, "third & last")]

BROKEN = {
    "stray end tag": (GOOD.replace("</b>", "</b></i></u>"), WHOLE),
    "missing end of a text": (GOOD.replace("bold</b></text>", "bold</b>"), WHOLE),
    "missing end of bold": (GOOD.replace("</b>", ""), WHOLE),
    "missing end of a page": (GOOD.replace("</page>", "", 1), WHOLE),
    "early end of the root": (GOOD.replace("</page>", "</page></pdf2xml>", 1), WHOLE),
    "bare signs": (GOOD.replace("first", "1 < 2 & 3 <"), [(1, 1, "1 < 2 & 3 < bold"), *WHOLE[1:]]),
    "value without quotes": (GOOD.replace('top="10"', "top=10", 1), WHOLE),
    "quote that isn't closed": (GOOD.replace('font="0">f', 'font="0>f'), WHOLE),
    "crossing tags": (GOOD.replace("first <b>bold</b>", "<b>fi<i>rst</b> bo</i>ld"), WHOLE),
    "control characters": (GOOD.replace("first", "fi\x00r\x0bst"), WHOLE),
    "an entity that isn't known": (GOOD.replace("first", "first&nosuch;"), [(1, 1, "first&nosuch; bold"), *WHOLE[1:]]),
    "cut within a tag": (GOOD[: GOOD.index("</page></pdf2xml>")] + "</pa", WHOLE),
    "cut within a text": (GOOD[: GOOD.index(" &amp; last")], [*WHOLE[:2], (2, 1, "third")]),
    "two roots": (GOOD + "<pdf2xml>" + GOOD.split("</page>")[1].replace('number="2"', 'number="3"') + "</page>", [*WHOLE, (3, 1, "third & last")]),
}


@pytest.mark.parametrize("what", BROKEN)
def test_later_pages_stay(what):
    text, want = BROKEN[what]
    with pytest.raises(ET.ParseError):
        ET.fromstring(text)
    assert [(number, pos, content) for number, pos, _, content, *_ in poppler._tokens(recovered(text))] == want


def test_sound_xml_is_read_alike():
    assert ET.tostring(recovered(GOOD)) == ET.tostring(ET.fromstring(GOOD))
    assert recovered("") is None and recovered("no element") is None and recovered("<<< >") is None


def test_cut_elements_are_opened_again():
    root = recovered('<t><text><a href="x">1<b>2</a>3</b>4</text>')
    assert ET.tostring(root).decode() == '<t><text><a href="x">1<b>2</b></a><b>3</b>4</text></t>'


def test_recovered_documents_go_on_and_are_told(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(BROKEN.values())] + [(99, GOOD), (100, "nothing")], "doc_id long, xml string")
    parsed = poppler.parse(docs).persist()
    rows = {(r["doc_id"], r["page_number"], r["pos"]): r["content"] for r in poppler.scan_tokens(parsed).collect()}
    for i, (_, want) in enumerate(BROKEN.values()):
        assert [(n, p, rows[i, n, p]) for n, p, _ in want] == want
    told = {r["doc_id"]: r["recovered"] for r in poppler.quarantine(parsed).collect()}
    assert told == {i: True for i in range(len(BROKEN))} | {100: False}
    parsed.unpersist()
