"""The input of the token type model: for each token the vectors of the eight pairs of tokens around it, 8 x 501 numbers.

A page has four padding tokens before its own and four after, so every token has eight pairs. Vectors are sparse: a pair has
its places and values other than zero, and a token's row is its eight pairs' one after another, cut out of the page's arrays.
Tokens come sorted by page; whole pages of a batch are computed together in numpy, a page that a batch cuts waits for the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.characters import text_numbers
from ..plans.dual import frame_operator, rendered
from ..plans.fixtures import FX
from .boosting import _binaries
from .features import _PLACE_OF, CATEGORIES, PUNCTUATION, _braces
from .geometry import LAST_TILE, TILE
from .sweep import CONTEXTS, PAIRS, by_pages, largest, near, page_numbers, ranges

#: Tokens of context on each side, pairs of a window, and the edges of a padding token's box.
CONTEXT, WINDOW, PAD_BOX = 4, 8, (-1, -1, 1, 1)

#: Parts of a pair's vector in order, with their numbers.
PARTS = (("base", 8), ("position", 22), ("text", 12), ("next text", 12), ("reading", 6), ("place", 7), ("touching", 2), ("categories", 216), ("next categories", 216))
PAIR = sum(n for _, n in PARTS)
_DENSE = PAIR - 2 * 216

#: Tokens that are computed together (a longer page alone), and rows of a batch that is given out.
TOKENS, ROWS = 16_384, 2048

BOX = ("left", "top", "right", "bottom")
TEXTS = ("is_all_caps", "starts_with_capital", "is_title_case", "is_numeric", "contains_digit", "digit_ratio", "ends_with_period", "ends_with_colon", "ends_with_semicolon", "word_count", "is_bold", "is_italic")
COUNTS = ("length_", "blanks", "punctuation")
MODES = ("font_size_mode", "lines_space_mode", "right_space_mode")
NUMBERS = (*BOX, "font", *CONTEXTS, *TEXTS, *COUNTS, "ro", "touches", *MODES)


def dense_pairs(page: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """page: number of each token's page, ascending; x: NUMBERS, and width and height where they aren't those of the box. The
    numbers but categories of all pairs with padding, page after page; the padded token that each begins with; which padded
    tokens are real; where tokens are among these; and the first pair of each token's window."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(page)) + 1])
    size = np.diff(np.concatenate([first, [len(page)]]))
    padded = size + 2 * CONTEXT
    begin = np.concatenate([[0], np.cumsum(padded)[:-1]])
    own = ranges(begin + CONTEXT, size)  # where tokens are among the padded ones
    n = int(padded.sum())
    group = np.repeat(np.arange(len(size)), padded)
    real = np.zeros(n, bool)
    real[own] = True

    def wide(name: str, pad: float = 0.0) -> np.ndarray:
        out = np.full(n, float(pad))
        out[own] = x[name]
        return out

    box = {k: wide(k, v) for k, v in zip(BOX, PAD_BOX, strict=True)}
    corner = np.zeros(len(size))  # what touches a token at the padding's corner touches the padding
    there = (x["left"] == PAD_BOX[0]) & (x["top"] == PAD_BOX[1])
    np.maximum.at(corner, np.repeat(np.arange(len(size)), size)[there], x["touches"][there])
    touches = corner[group]
    touches[own] = x["touches"]
    of_page = lambda name: x[name][first][group]

    a = np.flatnonzero(group[:-1] == group[1:])
    b = a + 1
    one = {k: v[a] for k, v in box.items()} | {c: wide(c)[a] for c in CONTEXTS}
    two = {k: v[b] for k, v in box.items()} | {c: wide(c)[b] for c in CONTEXTS}
    across, down = (wide(c, 2) if c in x else box[far] - box[near] for c, near, far in (("width", "left", "right"), ("height", "top", "bottom")))
    w1, h1, w2, h2 = across[a], down[a], across[b], down[b]

    # the tokens of the page that start between the first one's bottom and the second one's top
    order = np.lexsort((x["top"], page))
    stretch = np.repeat(np.arange(len(size)), size)
    least = min(x["top"].min(), one["bottom"].min(), two["top"].min()) if n else 0
    span = max(x["top"].max(), one["bottom"].max(), two["top"].max()) - least + 1
    tops = stretch[order] * span + x["top"][order] - least
    lo, hi = (np.searchsorted(tops, group[a] * span + edge - least) for edge in (one["bottom"], two["top"]))
    apart = two["top"] - one["top"] - h1
    gap = apart.copy()
    some = np.flatnonzero(lo < hi)
    gap[some] -= (two["top"][some] - largest(x["bottom"][order], lo[some], hi[some])) - (x["top"][order][lo[some]] - one["top"][some] - h1[some])

    right1, right2 = (np.maximum(s["right"], s["right_of_token_on_the_right"]) for s in (one, two))
    left1, left2 = (np.minimum(s["left"], s["left_of_token_on_the_left"]) for s in (one, two))
    lsm, rsm = of_page("lines_space_mode")[a], of_page("right_space_mode")[a]
    font = wide("font", np.nan)
    same = (font[a] == font[b]) | (~real[a] & ~real[b])
    base = [same, of_page("font_size_mode")[a] / 100] + [wide(c)[at] for c in COUNTS for at in (a, b)]
    position = [right1, one["top"], one["right"], w1, h1, two["top"], two["right"], w2, h2, two["left"] - one["left"] - w1, one["left"] - two["left"], one["left_of_token_on_the_right"] - one["right"], two["left"] - two["right_of_token_on_the_left"],
                h1 - h2, apart, apart - lsm, gap, apart - h1, np.abs(right1 - right2), left1 - left2, lsm - gap, rsm - right1]
    text = [wide(c)[a] for c in TEXTS] + [wide(c)[b] for c in TEXTS]
    both = (real[a] & real[b]).astype(float)
    ro, head, tail = wide("ro"), x["ro"][first][group], x["ro"][first + size - 1][group]
    reach = np.maximum(tail - head, 1)[a]
    reading = [both * v for v in ((ro[b] - ro[a]) / size[group[a]], (ro[a] - head[a]) / reach, (ro[b] - head[a]) / reach, np.abs(ro[b] - ro[a]) <= 2, ro[a], ro[b])]
    extent = {k: f.reduceat(x[k], first)[group[a]] for k, f in zip(BOX, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True)}
    breadth, length = np.maximum(extent["right"] - extent["left"], 1), np.maximum(extent["bottom"] - extent["top"], 1)
    fx, fr, fy = (one["left"] - extent["left"]) / breadth, (one["right"] - extent["left"]) / breadth, (one["top"] - extent["top"]) / length
    place = [fx, fy, fy < 0.10, fy > 0.90, fx < 0.05, fr > 0.95, np.minimum(size[group[a]] / 2000, 1)]
    dense = np.stack([np.asarray(c, float) for c in (*base, *position, *text, *reading, *place, touches[a], touches[b])], axis=1)
    # pairs of page p begin at begin[p] - p, since each page before has one pair fewer than padded tokens
    return dense, a, real, own, ranges(begin - np.arange(len(size)), size)


def pair_vectors(page: np.ndarray, x: dict[str, np.ndarray], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """page, x: as above; slots: 8 categories' places. (offsets, places, values) of all pairs with padding, page after page, and
    the first pair of each token's window."""
    dense, a, real, own, start_of = dense_pairs(page, x)
    b, n = a + 1, len(real)
    pair, column = np.nonzero(dense)
    parts = [(pair, column, dense[pair, column])]
    kinds = len(CATEGORIES)
    wide_slots = np.full((n, 8), -1)
    wide_slots[own] = slots
    for at, start in ((a, _DENSE), (b, _DENSE + 216)):
        row, slot = np.nonzero((wide_slots[at] >= 0) & real[at][:, None])
        parts.append((row, start + slot * kinds + wide_slots[at][row, slot], np.ones(len(row))))
        pads = np.flatnonzero(~real[at])
        parts.append((np.repeat(pads, 216), np.tile(np.arange(start, start + 216), len(pads)), np.full(216 * len(pads), -1.0)))
    pair, column, value = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(pair * PAIR + column)
    offsets = np.searchsorted(pair[order], np.arange(len(a) + 1))
    return offsets, column[order], value[order].astype(np.float32), start_of


def windows(offsets: np.ndarray, places: np.ndarray, values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, places, values) of rows: the WINDOW pairs from each start, one after another, cut out of the pairs' arrays."""
    size = offsets[start + WINDOW] - offsets[start]
    at = ranges(offsets[start], size)
    pairs = start[:, None] + np.arange(WINDOW)
    shift = np.repeat(np.tile(PAIR * np.arange(WINDOW), len(start)), (offsets[pairs + 1] - offsets[pairs]).ravel())
    return np.concatenate([[0], np.cumsum(size)]), places[at] + shift, values[at]


def _token_matrix(tok: DataFrame, ctx: DataFrame, texts: DataFrame, slots: DataFrame, ord: DataFrame, touching: DataFrame, modes: DataFrame, fontmode: DataFrame) -> DataFrame:
    key = ["doc_id", "page_number", "pos"]
    counts = rendered(lambda d: f"""select doc_id, page_number, pos, "left", top, "right", bottom, font_id as font, length(content) as length_, {d.count_of('content', "' '")} as blanks, {_braces(d, d.matches_count('content', PUNCTUATION))} as punctuation from {d.t('tok')}""", {"tok": tok})
    x = counts.join(ctx, key).join(texts, key).join(slots, key).join(ord.select(*key, F.col("reading_order_no").alias("ro")), key).join(touching.select(*key, F.col("touches")), key)
    x = x.join(modes, "doc_id", "left").join(fontmode.select("doc_id", "font_size_mode"), "doc_id", "left")
    x = x.withColumn("font", F.xxhash64("font") % (1 << 52))  # told apart by value, whatever their type; whole in a double
    x = x.select(*key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMBERS], "slots")
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        page = page_numbers(t)
        slot = np.array([s.split(",") for s in t.column("slots").to_pylist()]).astype(int)
        offsets, places, values, start = pair_vectors(page, {c: t.column(c).to_numpy() for c in NUMBERS}, slot)
        for at in range(0, t.num_rows, ROWS):
            o, p, v = windows(offsets, places, values, start[at : at + ROWS])
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(a)) for a in (p.astype(np.int32), v)]
            yield pa.RecordBatch.from_arrays([*(t.column(c).slice(at, ROWS).combine_chunks() for c in key), *lists], [*key, "places", "values"])

    return by_pages(x, out, ", ".join(f"{k} {kinds[k]}" for k in key) + ", places array<int>, values array<float>", TOKENS)


#: What the vectors of tokens and pairs are made of: tokens, and what is known of their documents and pages.
INPUTS = ("tok", "font", "ord", "reg", "modes", "fontmode")


def with_page(tok: DataFrame, font: DataFrame, ord: DataFrame, reg: DataFrame, modes: DataFrame, fontmode: DataFrame, *more: str) -> DataFrame:
    """Tokens with their reading order; the first one of a page also has what belongs to the page: modes, fonts of the document
    (name's hash, 1 for bold and 2 for italics) and boxes of regions. So joins of a token's key are all that tokens go through,
    and everything else of theirs is computed a page at a time (`numbers`). more: further columns of tokens to keep."""
    key, page = ["doc_id", "page_number", "pos"], ["doc_id", "page_number"]
    named = lambda c: F.xxhash64(c) % (1 << 52)  # noqa: E731  told apart by value, whatever the type; whole in a double
    first = tok.groupBy(*page).agg(F.min("pos").alias("pos"))
    marks = F.coalesce(F.col("bold").cast("int"), F.lit(0)) + 2 * F.coalesce(F.col("italics").cast("int"), F.lit(0))
    fonts = font.groupBy("doc_id").agg(F.collect_list(F.struct(named("font_id").cast("double").alias("font"), marks.cast("double").alias("marks"))).alias("f"))
    fonts = fonts.select("doc_id", F.col("f.font").alias("fonts"), F.col("f.marks").alias("marks"))
    boxes = reg.where("region_type <> 'ScannedPage'").groupBy(*page).agg(F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in BOX]))).alias("boxes"))
    first = first.join(fonts, "doc_id", "left").join(modes, "doc_id", "left").join(fontmode.select("doc_id", "font_size_mode"), "doc_id", "left").join(boxes, page, "left")
    first = first.select(*key, *[F.col(c).cast("double").alias(c) for c in MODES], "fonts", "marks", "boxes")
    own = tok.select(*key, *more, "content", *[F.col(c).cast("double").alias(c) for c in (*BOX, "width", "height")], F.when(F.col("font_id").isNotNull(), named("font_id")).cast("double").alias("font"))
    return own.join(ord.select(*key, F.col("reading_order_no").cast("double").alias("ro")), key).join(first, key, "left")


def touched(page: np.ndarray, box: tuple[np.ndarray, ...], r_page: np.ndarray, r_box: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which tokens (left, top, right, bottom) overlap or touch a region of their page. Both are dealt to tiles of the page, and
    pairs of a tile are looked through a bounded number at a time."""

    def dealt(number: np.ndarray, edges: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        x0, y0, x1, y1 = (np.clip(np.floor(e / TILE), 0, LAST_TILE).astype(np.int64) for e in edges)
        wide, high = np.maximum(x1 - x0 + 1, 0), np.maximum(y1 - y0 + 1, 0)
        who = np.repeat(np.arange(len(number)), wide * high)
        k = ranges(np.zeros(len(number), np.int64), wide * high)
        return ((number[who] * (LAST_TILE + 1) + y0[who] + k // wide[who]) * (LAST_TILE + 1)) + x0[who] + k % wide[who], who

    out = np.zeros(len(page), bool)
    (t_tile, t), (r_tile, r) = dealt(page, box), dealt(r_page, r_box)
    order = np.argsort(r_tile, kind="stable")
    lo, hi = (np.searchsorted(r_tile[order], t_tile, side) for side in ("left", "right"))
    some = np.flatnonzero(hi > lo)
    ends = np.cumsum(hi[some] - lo[some])
    begin = 0
    while begin < len(some):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        at = some[begin:stop]
        begin = stop
        size = hi[at] - lo[at]
        me, other = np.repeat(t[at], size), r[order[ranges(lo[at], size)]]
        hit = (box[2][me] >= r_box[0][other]) & (box[0][me] <= r_box[2][other]) & (box[3][me] >= r_box[1][other]) & (box[1][me] <= r_box[3][other])
        out[me[hit]] = True
    return out


def _of_pages(column: pa.ChunkedArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(page's number, value) of lists of numbers that first tokens have."""
    lists = column.combine_chunks().take(pa.array(first)).fill_null([])
    return np.repeat(np.arange(len(first)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)


def numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Of whole pages from `with_page`: page's number of each token, whether its font is known, NUMBERS (modes that aren't known
    are NaN) with width and height, and categories' places at eight places."""
    page = page_numbers(t)
    first = np.concatenate([[0], np.flatnonzero(np.diff(page)) + 1])
    x = {c: t.column(c).to_numpy() for c in (*BOX, "width", "height", "font", "ro")}
    for c in MODES:
        x[c] = t.column(c).to_numpy()[first][page]
    whole = {c: x[c].astype(np.int64) for c in (*BOX, "height")}
    x |= {c: v.data.astype(float) for c, v in near(page, *(whole[c] for c in (*BOX, "height"))).items() if c in CONTEXTS}

    r_page, r = _of_pages(t.column("boxes"), first)
    touches = touched(page, tuple(x[c] for c in BOX), r_page[::4], tuple(r[k::4] for k in range(4)))
    order = np.lexsort((np.arange(len(page)), x["top"], x["left"], page))  # of tokens at one corner the last decides
    same = (page[order][1:] == page[order][:-1]) & (x["left"][order][1:] == x["left"][order][:-1]) & (x["top"][order][1:] == x["top"][order][:-1])
    last = np.append(np.flatnonzero(~same), len(page) - 1)
    x["touches"] = np.zeros(len(page))
    x["touches"][order] = touches[order[last[np.searchsorted(last, np.arange(len(page)))]]]

    f_page, fonts = _of_pages(t.column("fonts"), first)
    marks = _of_pages(t.column("marks"), first)[1].astype(np.int64)
    known = ~np.isnan(x["font"])
    names = np.unique(np.concatenate([fonts, x["font"][known]]))
    table, own = f_page * (len(names) + 1) + np.searchsorted(names, fonts), page * (len(names) + 1) + np.where(known, np.searchsorted(names, x["font"]), len(names))
    order = np.argsort(table, kind="stable")
    at = np.minimum(np.searchsorted(table[order], own), max(len(table) - 1, 0))
    mark = np.where(table[order][at] == own, marks[order][at], 0) if len(table) else np.zeros(len(page), np.int64)

    text, slots = text_numbers(t.column("content").combine_chunks(), _PLACE_OF)
    x |= text | {"is_bold": mark & 1, "is_italic": mark >> 1}
    return page, known, x, slots


def _page_inputs(t: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Page's numbers, NUMBERS and categories' places of whole pages, as the matrix has them."""
    page, known, x, slot = numbers(t)
    x["font"] = np.where(known, x["font"], -1.0)
    return page, {c: np.nan_to_num(v) if c in MODES else v for c, v in x.items() if c not in ("width", "height")}, slot


def _matrix_rows(df: DataFrame, key: list[str], made: Callable[[pa.Table], Iterator[tuple[int, list[pa.Array]]]], columns: str) -> DataFrame:
    """made(table of whole pages): the first row and the columns of some rows at a time. df: as `with_page` gives it."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*key, *(c.split()[0] for c in columns.split(", "))]

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for at, rows in made(t):
            yield pa.RecordBatch.from_arrays([*(t.column(c).slice(at, len(rows[0])).combine_chunks() for c in key), *rows], names)

    return by_pages(df, out, ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + columns, TOKENS)


def _lists(t: pa.Table) -> Iterator[tuple[int, list[pa.Array]]]:
    offsets, places, values, start = pair_vectors(*_page_inputs(t))
    for at in range(0, t.num_rows, ROWS):
        o, p, v = windows(offsets, places, values, start[at : at + ROWS])
        yield at, [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(a)) for a in (p.astype(np.int32), v)]


def _packed(t: pa.Table) -> Iterator[tuple[int, list[pa.Array]]]:
    """As _lists, in binaries of 16-bit places and 32-bit values, which Spark carries as they are."""
    offsets, places, values, start = pair_vectors(*_page_inputs(t))
    for at in range(0, t.num_rows, ROWS):
        o, p, v = windows(offsets, places, values, start[at : at + ROWS])
        yield at, [_binaries(o, a) for a in (p.astype(np.uint16), v)]


def _sums(t: pa.Table) -> Iterator[tuple[int, list[pa.Array]]]:
    n, total, by_place = window_sums(*_page_inputs(t))
    yield 0, [pa.array(n.astype(np.int32)), pa.array(total), pa.array(by_place)]


def window_sums(page: np.ndarray, x: dict[str, np.ndarray], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token's row, without making it: how many values aren't zero, their sum, and the sum of each by its place. A pair
    stands in eight rows, at eight places: its own sums are taken once, from what isn't a category and from counts of these."""
    dense, a, real, own, start_of = dense_pairs(page, x)
    n, total, by_place = np.count_nonzero(dense, axis=1), np.zeros(len(a)), np.zeros(len(a))
    for column in range(_DENSE):
        value = dense[:, column].astype(np.float32).astype(float)
        total += value
        by_place += (column + 1) * value
    kinds = len(CATEGORIES)
    wide_slots = np.full((len(real), 8), -1)
    wide_slots[own] = slots
    for at, start in ((a, _DENSE), (a + 1, _DENSE + 216)):
        slot = wide_slots[at]
        there, pad = (slot >= 0) & real[at][:, None], ~real[at]
        many = there.sum(axis=1) + 216 * pad
        n = n + many
        total += np.where(pad, -216.0, many)
        by_place += np.where(pad, -float(np.arange(start + 1, start + 217).sum()), (there * (slot + start + kinds * np.arange(8) + 1)).sum(axis=1))
    out = [np.zeros(len(start_of), c.dtype) for c in (n, total, by_place)]
    for k in range(WINDOW):
        for o, c in zip(out, (n, total, by_place + k * PAIR * total), strict=True):
            o += c[start_of + k]
    return tuple(out)


def _fused_matrix(tok: DataFrame, font: DataFrame, ord: DataFrame, reg: DataFrame, modes: DataFrame, fontmode: DataFrame) -> DataFrame:
    return _matrix_rows(with_page(tok, font, ord, reg, modes, fontmode), ["doc_id", "page_number", "pos"], _lists, "places array<int>, values array<float>")


def _labelled(tok: DataFrame, font: DataFrame, ord: DataFrame, reg: DataFrame, modes: DataFrame, fontmode: DataFrame) -> DataFrame:
    """The matrix with the tokens' types, without joining the two."""
    df = with_page(tok, font, ord, reg, modes, fontmode, "token_type")
    return _matrix_rows(df, ["doc_id", "page_number", "pos", "token_type"], _packed, "places binary, values binary")


def feature_rows(tok: DataFrame, font: DataFrame, ord: DataFrame, reg: DataFrame, modes: DataFrame, fontmode: DataFrame) -> DataFrame:
    """The vector of 501 numbers of each token and the next of its page, of documents whose modes are known."""
    key = ["doc_id", "page_number", "pos"]
    df = with_page(tok, font, ord, reg, modes, fontmode)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    of_kind = np.arange(len(CATEGORIES))

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        page, known, x, slots = numbers(t)
        pos = t.column("pos").to_numpy()
        some = np.flatnonzero((page[1:] == page[:-1]) & (pos[1:] == pos[:-1] + 1) & ~np.isnan([x[c][:-1] for c in MODES]).any(axis=0))
        dense, _, _, own, _ = dense_pairs(page, x)
        dense = dense[own - page]  # the pair that a token begins: pages before have one pair fewer than padded tokens
        dense[:-1, 0] *= known[:-1] & known[1:]
        for at in range(0, len(some), ROWS):
            i = some[at : at + ROWS]
            hot = [(slots[j][:, :, None] == of_kind).reshape(len(i), -1) for j in (i, i + 1)]
            features = np.concatenate([dense[i], *hot], axis=1, dtype=np.float32)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(i) + 1) * PAIR).astype(np.int32)), pa.array(features.ravel()))
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks().take(pa.array(i)) for c in key), lists], [*key, "features"])

    return by_pages(df, out, ", ".join(f"{k} {kinds[k]}" for k in key) + ", features array<float>", TOKENS)


FX.add("matrix", *INPUTS, spark=_fused_matrix)(lambda d: "")
FX.add("labelled", *INPUTS, spark=_labelled)(lambda d: "")


@frame_operator(*INPUTS)
def token_matrix(tok: DataFrame, font: DataFrame, ord: DataFrame, reg: DataFrame, modes: DataFrame, fontmode: DataFrame) -> DataFrame:
    """Each token's row of the model's input: how many of its 4008 numbers aren't zero, their sum, and the sum of each by its
    place, rounded. Sums are taken a page at a time, without making rows."""
    df = with_page(tok, font, ord, reg, modes, fontmode)
    sums = _matrix_rows(df, ["doc_id", "page_number", "pos"], _sums, "n int, total double, by_place double")
    return sums.select("doc_id", "page_number", "pos", "n", F.round("total", 3).alias("total"), F.round("by_place", 1).alias("by_place"))
