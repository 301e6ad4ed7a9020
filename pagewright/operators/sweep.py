"""One pass over a page's tokens, sorted by their tops, for all that depends on the tokens beside and below each: its neighbours on
the line, the distance to the next token corrected for those between, the gap to the nearest one below, and line ends.

Tokens come sorted by page; whole pages of a batch are computed together in numpy. Tokens whose tops lie within a token's own
height are a stretch of the sorted tops, found by bisection and looked through a bounded number at a time; what is below and
between follows from the sorted tops and tables of maxima. No token meets those of other lines, and no page is joined to itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixtures import FX

KEY = ["doc_id", "page_number", "pos"]

#: Tokens of whole pages that are computed together (a longer page alone), and pairs that are looked through at a time.
TOKENS, PAIRS = 16_384, 1 << 20

CONTEXTS = ("right_of_token_on_the_left", "left_of_token_on_the_left", "left_of_token_on_the_right", "right_of_token_on_the_right")
NEAR = "doc_id long, page_number int, pos int, " + ", ".join(f"{c} int" for c in CONTEXTS) + ", gap int, below int, end_right int"


def page_numbers(t: pa.Table) -> np.ndarray:
    """A number for each row's page, ascending from 0, of rows sorted by document and page."""
    doc, number = (t.column(c).to_numpy() for c in KEY[:2])
    return np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (number[1:] != number[:-1]))])


def by_pages(df: DataFrame, out: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, tokens: int = TOKENS) -> DataFrame:
    """out(table of whole pages, sorted by KEY) for all rows; a page that a batch cuts waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= tokens:
                t = pa.Table.from_batches(held).combine_chunks()
                page = page_numbers(t)
                whole = int(np.searchsorted(page, page[-1]))
                if whole:
                    yield from out(t.slice(0, whole))
                    t = t.slice(whole)
                held, rows = t.to_batches(), t.num_rows
        if rows:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    # a window sorts by place and deals only what doesn't lie together by page or document yet
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*KEY[:2]).orderBy(KEY[2])))
    return placed.mapInArrow(run, schema)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., one after another."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def largest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """max(values[lo:hi]) for each pair of bounds (lo < hi), by tables of maxima over stretches of 1, 2, 4 ... values."""
    level = np.floor(np.log2(hi - lo)).astype(int)
    out, table = np.zeros(len(lo), values.dtype), values
    for k in range(level.max() + 1 if len(level) else 0):
        if k:
            table = np.maximum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(table[lo[at]], table[hi[at] - (1 << k)])
    return out


def near(page: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, height: np.ndarray) -> dict[str, np.ma.MaskedArray]:
    """The columns of NEAR but the key, of tokens sorted by page and position."""
    n = len(page)
    order = np.lexsort((top, page))
    edges = np.concatenate([top, bottom, top - height, top + height])
    least = int(edges.min())
    span = int(edges.max()) - least + 2
    at = lambda y, side="left": np.searchsorted(page[order] * span + top[order] - least, page * span + y - least, side)
    end = np.searchsorted(page[order], page, "right")

    below = at(bottom, "right")
    gap_below = np.ma.masked_array(top[order][np.minimum(below, n - 1)] - bottom, below >= end)

    last = np.append(page[1:] != page[:-1], True)
    ahead = np.where(last, 0, np.append(top[1:], 0))
    gap = ahead - top - height
    lo, hi = at(bottom), np.where(last, 0, at(np.where(last, top, ahead)))
    some = np.flatnonzero(~last & (lo < hi))
    gap[some] -= (ahead[some] - largest(bottom[order], lo[some], hi[some])) - (top[order][lo[some]] - top[some] - height[some])

    lo, hi = at(top - height), at(top + height, "right")
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    found = {c: np.zeros(n, np.int64) for c in CONTEXTS}
    ends = np.zeros(n, bool)
    size = np.maximum(hi - lo, 0)
    cut = np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum() + PAIRS, PAIRS), "right") + 1
    begin = 0
    for stop in np.unique(np.minimum(cut, n)).tolist():
        t = np.arange(begin, stop)[size[begin:stop] > 0]
        begin = stop
        if not len(t):
            continue
        o, me = order[ranges(lo[t], size[t])], np.repeat(t, size[t])
        starts = np.concatenate([[0], np.cumsum(size[t])[:-1]])
        o_end = top[o] + height[o]
        line = ((top[o] <= top[me]) & (top[me] < o_end)) | ((top[o] < bottom[me]) & (bottom[me] <= o_end))
        before, behind = line & (right[o] < right[me]), line & (left[me] < left[o])
        for name, pick, side, values, none in (
            (CONTEXTS[0], np.maximum, before, right, low),
            (CONTEXTS[1], np.minimum, before, left, high),
            (CONTEXTS[2], np.minimum, behind, left, high),
            (CONTEXTS[3], np.maximum, behind, right, low),
        ):
            best = pick.reduceat(np.where(side, values[o], none), starts)
            found[name][t] = np.where(best == none, 0, best)
        # the last of a line: on one (its own at least), and nothing on it starts behind its right edge
        ends[t] = np.logical_or.reduceat(line, starts) & ~np.logical_or.reduceat(line & (left[o] > right[me]), starts)
    return {c: np.ma.masked_array(v, False) for c, v in found.items()} | {"gap": np.ma.masked_array(gap, last), "below": gap_below, "end_right": np.ma.masked_array(right, ~ends)}


def sweep(tok: DataFrame) -> DataFrame:
    """tok -> NEAR, a row a token. gap is null for a page's last token, below where nothing starts below, end_right but for the
    last tokens of lines."""

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        box = (t.column(c).to_numpy().astype(np.int64) for c in ("left", "top", "right", "bottom", "height"))
        columns = near(page_numbers(t), *box)
        made = [pa.array(v.data.astype(np.int32), pa.int32(), mask=np.broadcast_to(v.mask, v.shape)) for v in columns.values()]
        yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in KEY), *made], [*KEY, *columns])

    typed = tok.selectExpr("cast(doc_id as bigint) doc_id", "cast(page_number as int) page_number", "cast(pos as int) pos", *(f"cast(`{c}` as int) `{c}`" for c in ("left", "top", "right", "bottom", "height")))
    return by_pages(typed, out, NEAR)


def _sweep_duck(d) -> str:
    from .aggregates import line_ends
    from .joins import closest_below, top_distance_gap
    from .sequence import token_context

    on = lambda a: f"t.doc_id = {a}.doc_id and t.page_number = {a}.page_number and t.pos = {a}.pos"
    columns = ", ".join(f"c.{c}" for c in CONTEXTS)
    return f"""select t.doc_id, t.page_number, t.pos, {columns}, g.gap, b.gap as below, e.v as end_right from {d.t('tok')} t join ({token_context.template(d)}) c on {on('c')}
 left join ({top_distance_gap.template(d)}) g on {on('g')} left join ({closest_below.template(d)}) b on {on('b')} left join ({line_ends(d)}) e on {on('e')}"""


FX.add("sweep", "tok", spark=sweep)(_sweep_duck)
FX.add("ctx", "sweep")(lambda d: f"select doc_id, page_number, pos, {', '.join(CONTEXTS)} from {d.t('sweep')}")
