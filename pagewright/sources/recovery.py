"""Reading of page XML that isn't well formed: a tokenizer and a stack of open elements, which go on after each error.

What the parser of the standard library reads never comes here. An end tag without an open element is dropped. One that closes
an outer element closes what is open within; bold, italic and links that it cuts are opened again behind it. Pages and texts
don't nest, so one that begins ends the one before. The root stays open to the end. A `<` that begins no tag is text, values
of attributes may lack quotes, and a file that is cut loses no more than the tag where it ends.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|[?!][^<>]*>?|/\s*(?P<end>[A-Za-z_][\w.:-]*)[^<>]*>?|(?P<start>[A-Za-z_][\w.:-]*)(?P<rest>(?:\"[^\"<]*\"|'[^'<]*'|[^<>\"']|[\"'](?=[^<>]*>))*)>)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w.:-]*)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)'|[\"']?([^\s\"'<>]+))")
_CUT = re.compile(r"<[/?!]?[A-Za-z_][^<>]*\Z")
_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

#: Elements that can't lie in one of the same kind, those that are opened again when they are cut, and those without content.
_APART, _INLINE, _EMPTY = ("page", "text"), ("b", "i", "a"), ("fontspec", "image")


def _decoded(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        code = int(m[1]) if m[1] else int(m[2], 16)
        good = code in (9, 10, 13) or 32 <= code < 0xD800 or 0xE000 <= code < 0xFFFE or 0x10000 <= code < 0x110000
        return chr(code) if good else ""

    return _ENTITY.sub(one, text)


class _Tree:
    def __init__(self):
        self.builder, self.open, self.root = ET.TreeBuilder(), [], None

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in _APART and any(n == name for n, _ in self.open):
            self.end(name)
        if name == "page" and any(n == "text" for n, _ in self.open):
            self.end("text")
        element = self.builder.start(name, attributes)
        self.root = element if self.root is None else self.root
        self.open.append((name, attributes))

    def text(self, text: str) -> None:
        if self.open and text:
            self.builder.data(text)

    def end(self, name: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == name), 0)
        if not depth:  # nothing of that name is open, or the root alone, which stays open
            return
        cut = [self.open.pop() for _ in range(len(self.open) - depth)]
        for n, _ in cut:
            self.builder.end(n)
        if name in _INLINE:
            for n, attributes in reversed(cut[:-1]):
                if n in _INLINE:
                    self.start(n, attributes)

    def close(self) -> ET.Element | None:
        while self.open:
            self.builder.end(self.open.pop()[0])
        return self.root


def recovered(xml: str) -> ET.Element | None:
    """The root of what can be read, None if there is no element."""
    xml, tree, at = _CONTROL.sub("", xml), _Tree(), 0
    while at < len(xml):
        m = _TAG.search(xml, at)
        if m is None:
            cut = _CUT.search(xml, at)
            tree.text(_decoded(xml[at : cut.start() if cut else len(xml)]))
            break
        tree.text(_decoded(xml[at : m.start()]))
        if m["data"] is not None:
            tree.text(m["data"])
        elif m["end"]:
            tree.end(m["end"])
        elif m["start"]:
            rest = m["rest"]
            tree.start(m["start"], {k: _decoded(next(v for v in found if v is not None)) for k, *found in ((a[1], a[2], a[3], a[4]) for a in _ATTRIBUTE.finditer(rest))})
            if (rest.endswith("/") or m["start"] in _EMPTY) and len(tree.open) > 1:
                tree.end(m["start"])
        at = m.end()
    return tree.close()
