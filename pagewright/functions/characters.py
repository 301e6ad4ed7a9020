"""Classes of characters for regular expressions of both engines."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

#: Code points from which the class of digits is made; none beyond has the property in Python's tables.
_LAST = 0x20000


def _ranges(holds) -> str:
    out, start = [], None
    for c in range(_LAST + 1):
        now = c < _LAST and holds(chr(c))
        if now and start is None:
            start = c
        elif not now and start is not None:
            out.append(chr(start) if c == start + 1 else f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


#: Characters that count as digits: decimal ones of all scripts, superscripts, subscripts, circled and the like; as ranges of
#: the characters themselves, so that the class doesn't depend on an engine's version of Unicode.
DIGIT = f"[{_ranges(str.isdigit)}]"


#: By code point: the number of a category in _KINDS, with 64 added for digits; _UNSEEN where it wasn't looked up yet.
_UNSEEN, _KINDS, _codes = 255, [], None


def _classes(points: np.ndarray) -> np.ndarray:
    global _codes
    if _codes is None:
        _codes = np.full(0x110000, _UNSEEN, np.uint8)
    out = _codes[points]
    for c in np.unique(points[out == _UNSEEN]).tolist():
        kind = unicodedata.category(chr(c))
        if kind not in _KINDS:
            _KINDS.append(kind)
        _codes[c] = _KINDS.index(kind) + (64 if chr(c).isdigit() else 0)
    return _codes[points]


def text_numbers(content: pa.Array, place_of: dict[str, int]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of each text: what text_features says but for its font, its length, blanks and punctuation; and the places (`place_of`) of
    the categories of its first and last four characters (all, if there are eight at most), -1 for none. All texts are looked at
    together, as arrays of code points."""
    n = len(content)
    content = content.cast(pa.large_string()).fill_null("")
    _, offsets, data = content.buffers()
    at = np.frombuffer(offsets, np.int64)[content.offset : content.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])  # noqa: E731  how many before a place
    edge = count((raw & 0xC0) != 0x80)[at - at[0]]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    code = _classes(points)
    kind, digit = code & 63, code >= 64
    begin, end = edge[:-1], edge[1:]
    within = lambda mask, lo=begin, hi=end: (c := count(mask))[hi] - c[lo]

    ink = points != 32
    seen = np.append(np.flatnonzero(ink), len(points))  # places of what isn't a blank
    lo, hi = np.searchsorted(seen, begin), np.searchsorted(seen, end)
    start = np.where(hi > lo, seen[lo], begin)
    stop = np.where(hi > lo, seen[np.maximum(hi - 1, 0)] + 1, begin)
    size = stop - start
    one_of = lambda *names: np.isin(kind, [i for i, k in enumerate(_KINDS) if k in names])
    upper, lower, title = one_of("Lu"), one_of("Ll"), one_of("Lt")
    cased = upper | lower | title
    fresh = np.zeros(len(points) + 1, bool)  # where a text without its outer blanks begins
    fresh[start] = True
    after = np.append(False, cased[:-1])[: len(points)] & ~fresh[:-1]  # behind a cased character
    firsts = (upper | title) & ~after
    wrong = ((upper | title) & after) | (lower & ~after)
    mark = (points == 44) | (points == 46)
    digits = within(digit, start, stop)
    plain = size - within(mark, start, stop)
    last = np.where(size > 0, np.append(points, 0)[np.maximum(stop - 1, 0)], 0)
    words = within(ink & ~np.append(False, ink[:-1])[: len(points)] | ink & fresh[:-1], start, stop)
    ascii_ = points < 128
    punctuation = ascii_ & (points > 32) & (points < 127) & ~((points >= 48) & (points <= 57)) & ~((points >= 65) & (points <= 90)) & ~((points >= 97) & (points <= 122))
    out = {
        "is_all_caps": (within(upper, start, stop) > 0) & (within(lower | title, start, stop) == 0) & (size >= 2), "starts_with_capital": (size > 0) & np.append(upper, False)[start],
        "is_title_case": (within(firsts, start, stop) > 0) & (within(wrong, start, stop) == 0) & (size >= 2), "is_numeric": (plain > 0) & (within(digit & ~mark, start, stop) == plain),
        "contains_digit": digits > 0, "digit_ratio": digits / np.maximum(size, 1), "ends_with_period": last == 46, "ends_with_colon": last == 58, "ends_with_semicolon": last == 59,
        "word_count": np.minimum(words / 20, 1), "length_": end - begin, "blanks": within(~ink), "punctuation": within(punctuation),
    }
    place = np.array([*(place_of.get(k, -1) for k in _KINDS), -1])
    of_point = np.append(np.where(points == 0, -1, place[kind]), -1)
    k = np.arange(8)
    length = (end - begin)[:, None]
    where = np.where((length > 8) & (k >= 4), end[:, None] - 8 + k, begin[:, None] + k)
    return out, np.where(k < length, of_point[np.minimum(where, len(points))], -1)
