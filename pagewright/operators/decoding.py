"""Decoding: the likeliest sequence of a page's types, given emissions of its tokens and transitions between types.

Scores are sums of logarithms in whole multiples of 2**-32, the same in whatever order they are added. So a long page can be cut
into stretches that tasks share, and still gets the labels that a walk from its first to its last token gives, with the first
type on ties:

1. each stretch gives the best score from every type before it to every type at its end, a product of matrices where sums stand
   for products and maxima for sums;
2. a page's products, a kilobyte a stretch, give the scores with which each stretch is entered;
3. each stretch is walked from these, and says for every type at its end which type comes before its first token;
4. from the page's last type back, these say at which type each stretch ends;
5. each stretch is walked again and labelled from its end.

A page of one stretch is walked at once. A page that has no tokens has no rows; tokens with equal places are taken in the order of
their emissions, and gaps between places are no matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = 11
#: Tokens of a stretch.
STRETCH = 1024
#: Walks that are taken together; bounds the memory of a batch.
TOGETHER = 256
_PAGE = ("doc_id", "page_number")
_STRETCH = (*_PAGE, "stretch")


def fixed(p: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities in multiples of 2**-32; 2**25 tokens of them add up within 64 bits."""
    return np.rint(np.log(p + 1e-12) * 2.0**32).astype(np.int64)


def walk(logs: list[np.ndarray], start: np.ndarray, transition: np.ndarray, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """logs: sequences, longest first; start (sequence, beginning, type): scores at the first token for one or more beginnings
    -> scores at the last token, and with `keep` the best type before each further token, by step, of sequences that go on."""
    sizes = np.array([len(x) for x in logs])
    best, back = start.copy(), []
    for step in range(1, sizes[0]):
        on = int((sizes > step).sum())
        scores = best[:on, :, :, None] + transition
        if keep:
            back.append(scores.argmax(axis=2))
        best[:on] = scores.max(axis=2) + np.stack([x[step] for x in logs[:on]])[:, None, :]
    return best, back


def traced(sizes: np.ndarray, back: list[np.ndarray], ends: np.ndarray) -> list[np.ndarray]:
    """Back from types at the last token, ends (sequence, way) -> types (token, way) of each sequence. Sequences are longest
    first and were walked from one beginning."""
    types = [np.empty((n, ends.shape[1]), np.int64) for n in sizes]
    now = ends.copy()
    for step in range(sizes[0] - 1, -1, -1):
        on = int((sizes > step).sum())
        for k in range(on):
            types[k][step] = now[k]
        if step:
            now[:on] = np.take_along_axis(back[step - 1][:, 0], now[:on], axis=1)
    return types


def decoded(pages: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """Types of whole sequences of fixed logarithms, those of a group step by step together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
    for group in _groups(pages):
        logs = [pages[i] for i in group]
        best, back = walk(logs, np.stack([x[0] for x in logs])[:, None], transition, keep=True)
        for i, t in zip(group, traced(np.array([len(x) for x in logs]), back, best[:, 0].argmax(axis=1)[:, None]), strict=True):
            out[i] = t[:, 0]
    return out


def _groups(logs: list[np.ndarray]) -> Iterator[list[int]]:
    order = sorted((i for i in range(len(logs)) if len(logs[i])), key=lambda i: -len(logs[i]))
    for at in range(0, len(order), TOGETHER):
        yield order[at : at + TOGETHER]


def _products(logs: list[np.ndarray], transition: np.ndarray, x: pd.DataFrame) -> dict[str, list]:
    out: list = [None] * len(logs)
    for group in _groups(logs):
        first = np.stack([logs[i][0] for i in group])[:, None]
        begins = np.vstack([transition, np.zeros((1, TYPES), np.int64)])  # from each type, and as a page's first stretch
        best, _ = walk([logs[i] for i in group], first + begins, transition, keep=False)
        for i, b in zip(group, best, strict=True):
            out[i] = b.ravel()
    return {"product": out}


def _walked(logs: list[np.ndarray], transition: np.ndarray, x: pd.DataFrame, group: list[int]):
    """Scores at the end and types before each token, for stretches that are entered with known scores."""
    first = np.stack([logs[i][0] for i in group])
    entry = np.stack([x["entry"].iloc[i] for i in group])
    entered = ~x["begins"].to_numpy(bool)[group][:, None, None]
    scores = entry[:, :, None] + transition * entered  # a page's first stretch is entered with zeros
    best, back = walk([logs[i] for i in group], (scores.max(axis=1) + first)[:, None], transition, keep=True)
    return best[:, 0], back, scores.argmax(axis=1)


def _heads(logs: list[np.ndarray], transition: np.ndarray, x: pd.DataFrame) -> dict[str, list]:
    heads, ends = [None] * len(logs), [0] * len(logs)
    for group in _groups(logs):
        best, back, before = _walked(logs, transition, x, group)
        every = np.tile(np.arange(TYPES), (len(group), 1))
        for k, (i, t) in enumerate(zip(group, traced(np.array([len(logs[i]) for i in group]), back, every), strict=True)):
            heads[i], ends[i] = before[k][t[0]], int(best[k].argmax())
    return {"heads": heads, "last": ends}


def _filled(logs: list[np.ndarray], transition: np.ndarray, x: pd.DataFrame) -> dict[str, list]:
    labels = [None] * len(logs)
    for group in _groups(logs):
        _, back, _ = _walked(logs, transition, x, group)
        for i, t in zip(group, traced(np.array([len(logs[i]) for i in group]), back, x["ends_in"].to_numpy()[group][:, None]), strict=True):
            labels[i] = t[:, 0]
    return {"labels": labels}


def _by_stretch(df: DataFrame, make: Callable, keys: tuple[str, ...], added: str) -> DataFrame:
    """make(logs, transition, rows) -> columns to add, a batch of stretches at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                transition = fixed(np.asarray(x["matrix"].iloc[0], float)).reshape(TYPES, TYPES)
                logs = [fixed(np.asarray(p, float)).reshape(-1, TYPES) for p in x["p"]]
                yield x[list(keys)].assign(**make(logs, transition, x))

    return df.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {added}")


def _by_page(df: DataFrame, fold: Callable[[pd.DataFrame], dict[str, list]], added: str) -> DataFrame:
    """fold(a page's stretches in order) -> columns to add."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("stretch")
        return x[list(_STRETCH)].assign(**fold(x))

    return df.groupBy(*_PAGE).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in _STRETCH) + f", {added}")


def _entries(x: pd.DataFrame) -> dict[str, list]:
    best, out = np.zeros(TYPES, np.int64), []
    for m in x["product"]:
        m = m.reshape(TYPES + 1, TYPES)
        best, entry = (best[:, None] + m[:TYPES]).max(axis=0) if out else m[TYPES], best
        out.append(entry)
    return {"entry": out, "begins": [k == 0 for k in range(len(out))]}


def _ends(x: pd.DataFrame) -> dict[str, list]:
    now, out = int(x["last"].iloc[-1]), []
    for heads in x["heads"].iloc[::-1]:
        out.append(now)
        now = int(heads[now])
    return {"ends_in": out[::-1]}


def _joined(df: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Joins by keys that may be null."""
    other = other.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    on = [df[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return df.join(other, on, how).drop(*(f"_{k}" for k in keys))


def viterbi(emi: DataFrame, trans: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """emi (doc_id, page_number, pos, p array<double>) and trans (prev, curr, p: 121 rows or fewer) -> (doc_id, page_number, pos,
    label). A job over the places says whether a page is longer than a stretch; if none is, the plan has no steps for such pages.
    Emissions that are costly to make should be a written table."""
    cells = trans.agg(F.map_from_entries(F.collect_list(F.struct(F.col("prev") * TYPES + F.col("curr"), F.col("p").cast("double")))).alias("cells"))  # one row
    matrix = cells.select(F.expr(f"transform(sequence(0, {TYPES * TYPES - 1}), i -> coalesce(try_element_at(cells, i), 0D))").alias("matrix"))
    placed = emi.select(*_PAGE, F.expr(f"(coalesce(pos, 1) - 1) div {stretch}").alias("stretch"), F.struct("pos", F.col("p").cast("array<double>").alias("p")).alias("token"))

    def grouped(tokens: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        tokens = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list("token")).alias("tokens"))
        return tokens.select(*keys, F.col("tokens.pos").alias("pos"), F.flatten("tokens.p").alias("p")).crossJoin(F.broadcast(matrix))  # matrix: one row

    def whole(logs: list[np.ndarray], transition: np.ndarray, x: pd.DataFrame) -> dict[str, list]:
        return {"labels": decoded(logs, transition), "pos": list(x["pos"])}

    def filled(logs: list[np.ndarray], transition: np.ndarray, x: pd.DataFrame) -> dict[str, list]:
        return {**_filled(logs, transition, x), "pos": list(x["pos"])}

    def labels(df: DataFrame, make: Callable) -> DataFrame:
        out = _by_stretch(df, make, _PAGE, "labels array<int>, pos array<int>").select(*_PAGE, F.explode(F.arrays_zip("pos", "labels")).alias("x"))
        return out.select(*_PAGE, F.col("x.pos").alias("pos"), F.col("x.labels").alias("label"))

    long = placed.where("stretch > 0").select(*_PAGE)
    if long.isEmpty():
        return labels(grouped(placed, _PAGE), whole)
    long = long.distinct()
    # dealt by stretch even where a document's tokens lie together, so that a long page is shared; read once for all steps
    parts = grouped(_joined(placed, long, _PAGE, "left_semi").repartition(*_STRETCH), _STRETCH)
    entries = _by_page(_by_stretch(parts, _products, _STRETCH, "product array<bigint>"), _entries, "entry array<bigint>, begins boolean")
    entered = _joined(parts, entries, _STRETCH)
    ends = _by_page(_by_stretch(entered, _heads, _STRETCH, "heads array<int>, last int"), _ends, "ends_in int")
    short = labels(grouped(_joined(placed, long, _PAGE, "left_anti"), _PAGE), whole)
    return short.unionByName(labels(_joined(entered, ends, _STRETCH), filled))
