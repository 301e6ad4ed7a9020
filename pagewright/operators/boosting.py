"""Gradient boosting over several classes on distributed histograms.

Rows are sparse vectors (places, values). Each feature is cut into bins once, by quantiles of its values; a row then is the list
of its bins that aren't the bin of zero. A round grows one tree a class under a softmax loss. Each pass over the rows sums
gradients, hessians and rows by (node, bin) on the map side for all nodes of all classes that may be split next; these sums are
shuffled by node and block of features, where the best split is found, so the driver gets one short row a node and block.

Trees grow best-first up to a number of leaves, the node with the largest gain next. Since a node's gain doesn't depend on
other splits, a pass asks for all nodes at once that such a growth reaches with the gains known so far; nodes that it doesn't
reach then can't be reached later either. So a tree takes as many passes as it is deep, not as it has splits. Gradients and
hessians are whole multiples of 2**-24: their sums are exact, so trees don't depend on how rows are partitioned.
"""

from __future__ import annotations

import heapq
import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import removed, written
from .shipped import shipped
from .sweep import ranges


@dataclass(frozen=True)
class Settings:
    """Those of the model that this one stands for."""

    rounds: int = 700
    leaves: int = 127
    rate: float = 0.1
    l1: float = 1.1533558410486358e-08
    l2: float = 4.91211684620458
    feature_fraction: float = 0.7087268965467017
    bagging_fraction: float = 0.6810645192499981
    bagging_freq: int = 10
    least_rows: int = 47
    least_hessian: float = 1e-3
    bins: int = 255
    classes: int = 11
    seed: int = 22


#: Gradients are whole multiples of 1 / UNIT. Sums of a pass that a task holds, bins of a block, values of features that a task
#: counts at a time, rounds after which scores are written, and the width of the bin of zero.
UNIT, CELLS, BLOCK, COUNTED, WRITE, ZERO = float(1 << 24), 1 << 21, 1 << 12, 1 << 21, 8, 1e-35


class Bins:
    """Upper edges of each feature's bins, in one array; bin b of feature f is number starts[f] + b of all bins."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = [np.asarray(e, np.float32) for e in edges]
        self.starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)
        self.zero = np.array([np.searchsorted(e, 0.0) for e in self.edges], np.int64)
        self.width, self.total = len(edges), int(self.starts[-1])
        self.feature = np.repeat(np.arange(self.width), np.diff(self.starts))
        #: Types that places and cells fit in; numbers of two bytes are sorted by radix.
        self.short = np.uint16 if self.width <= 1 << 16 else np.int32
        self.kind = np.uint16 if self.total <= 1 << 16 else np.int32
        self.of_cell = self.feature.astype(self.short)

    def cells(self, offsets: np.ndarray, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, cells): of each row the bins but those of zero, ascending."""
        n = len(offsets) - 1
        order, cut = self.by_feature(places.astype(self.short))
        sorted_values, found = values[order].astype(np.float32), np.zeros(len(places), np.int64)
        for f in np.flatnonzero(np.diff(cut)):
            found[cut[f] : cut[f + 1]] = np.searchsorted(self.edges[f], sorted_values[cut[f] : cut[f + 1]])
        bins = np.empty_like(found)
        bins[order] = found
        keep = bins != self.zero[places]
        row, cell = np.repeat(np.arange(n), np.diff(offsets))[keep], (self.starts[places] + bins)[keep]
        if ((cell[1:] <= cell[:-1]) & (row[1:] == row[:-1])).any():  # places of a row didn't ascend
            cell = cell[np.lexsort((cell, row))]
        return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), cell

    def by_feature(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order by feature, and where each feature begins and ends in it."""
        return np.argsort(places, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(places, minlength=self.width))])

    def dense(self, offsets: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Bins of all features, a row each."""
        out = np.repeat(self.zero.astype(np.uint8)[None], len(offsets) - 1, axis=0)
        f = self.feature[cells]
        out[np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), f] = cells - self.starts[f]
        return out


def quantile_bins(rows: DataFrame, width: int, bins: int = 255) -> Bins:
    """Edges from the quantiles of each feature's values other than zero, which has a bin of its own, over all rows. Tasks count
    equal values of a feature, at most COUNTED of them at a time; a feature's counts meet in one group, and at most `bins`
    numbers a feature reach the driver."""
    get = _numbers(rows, np.int64), _numbers(rows, np.float32)
    at = np.arange(1, bins - 3) / (bins - 3)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in _parts(batches):
            places, values = get[0](part.column(0))[1], get[1](part.column(1))[1]
            some = values != 0
            own, n = np.unique(places[some].astype(np.uint64) << np.uint64(32) | values[some].view(np.uint32), return_counts=True)
            keys, many = _merged(np.concatenate([keys, own]), np.concatenate([many, n]))
            if len(keys) > COUNTED:
                yield told(keys, many)
                keys, many = keys[:0], many[:0]
        if len(keys):
            yield told(keys, many)

    def told(keys: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        place = (keys >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        cut = np.append(first, len(place))
        return pa.RecordBatch.from_arrays([pa.array(place[first]), _binaries(cut, keys.astype(np.uint32)), _binaries(cut, many)], ["place", "bits", "many"])

    def cuts(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        bits, n = _merged(np.concatenate([np.frombuffer(b, np.uint32) for b in x["bits"]]), np.concatenate([np.frombuffer(b, np.int64) for b in x["many"]]))
        order = np.argsort(bits.view(np.float32), kind="stable")
        v, upto = bits.view(np.float32)[order].astype(float), np.cumsum(n[order])
        place = (upto[-1] - 1) * at
        low, high = np.floor(place), np.ceil(place)
        i, j = (np.searchsorted(upto, p + 1) for p in (low, high))
        own = np.where(i == j, v[i], (high - place) * v[i] + (place - low) * v[j])  # between neighbours by distance
        ends = ([-ZERO] if v[0] < 0 else []) + ([ZERO] if v[-1] > 0 else [])
        return pd.DataFrame([(key[0], np.unique(np.concatenate([own[own < v[-1]], ends])).tobytes())], columns=["place", "edges"])

    edges = [np.zeros(0)] * width
    told_ = rows.select("places", "values").mapInArrow(counted, "place int, bits binary, many binary")
    for r in told_.groupBy("place").applyInPandas(cuts, "place int, edges binary").collect():
        edges[r["place"]] = np.frombuffer(r["edges"])
    return Bins(edges)


def _merged(keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys told apart, ascending, with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")  # of parts that are sorted each
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(many[order], first) if len(first) else many


@dataclass
class Tree:
    """Node 0 is the root; a node with left < 0 is a leaf. A row goes left if its bin of the feature is `cut` or less."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, len(self.left), len(self.left) + 1
        for _ in range(2):
            for column, empty in ((self.feature, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]

    def node_of(self, dense: np.ndarray, column: np.ndarray | None = None) -> np.ndarray:
        """column: where a feature is in `dense`, if that doesn't have all."""
        feature, cut, left, right = map(np.asarray, (self.feature, self.cut, self.left, self.right))
        feature = feature if column is None else column[feature]
        at = np.zeros(len(dense), np.int64)
        moving = np.arange(len(dense)) if left[0] >= 0 else np.zeros(0, np.int64)
        while len(moving):
            node = at[moving]
            at[moving] = np.where(dense[moving, feature[node]] <= cut[node], left[node], right[node])
            moving = moving[left[at[moving]] >= 0]
        return at

    def scores(self, dense: np.ndarray, column: np.ndarray | None = None) -> np.ndarray:
        return np.asarray(self.value)[self.node_of(dense, column)]

    def walked(self) -> list[int]:
        """Features that its splits ask for."""
        return [f for f, left in zip(self.feature, self.left, strict=True) if left >= 0]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the softmax loss for each class, in whole units."""
    p, k = softmax(scores), scores.shape[1]
    return np.rint((p - (label[:, None] == np.arange(k))) * UNIT), np.rint(k / max(1, k - 1) * p * (1 - p) * UNIT)


def worth(g, h, s: Settings):
    """What a node with these sums (in units) contributes to a gain, twice the loss that its best value saves."""
    g, h = np.asarray(g) / UNIT, np.asarray(h) / UNIT
    return np.maximum(np.abs(g) - s.l1, 0) ** 2 / (h + s.l2)


def leaf_value(g: float, h: float, s: Settings) -> float:
    g, h = g / UNIT, h / UNIT
    return float(-np.sign(g) * max(abs(g) - s.l1, 0) / (h + s.l2) * s.rate)


def best_split(sums: np.ndarray, total: np.ndarray, features: np.ndarray, starts: np.ndarray, zero: np.ndarray, s: Settings):
    """(gain, feature, cut, left sums) of the best split of a node, or None. sums: (gradient, hessian, rows) by bin of features
    that lie one after another, without the bins of zero; starts: their first bins and the end; total: the node's sums. Of
    equal gains the first feature's first cut."""
    sums = sums.copy()
    sums[:, starts[:-1] + zero] = total[:, None] - np.add.reduceat(sums, starts[:-1], axis=1)
    left = np.cumsum(sums, axis=1)
    left -= np.repeat((left[:, starts[:-1]] - sums[:, starts[:-1]]), np.diff(starts), axis=1)
    right = total[:, None] - left
    ok = (left[2] >= s.least_rows) & (right[2] >= s.least_rows) & (np.minimum(left[1], right[1]) >= s.least_hessian * UNIT)
    if not ok.any():
        return None
    gain = np.where(ok, worth(left[0], left[1], s) + worth(right[0], right[1], s) - worth(*total[:2], s), -np.inf)
    i = int(np.argmax(gain))
    if gain[i] <= 0:
        return None
    f = int(np.searchsorted(starts, i, "right")) - 1
    return float(gain[i]), int(features[f]), i - int(starts[f]), left[:, i]


class Growing:
    """A tree of one class while it grows: known[node] is None (no split) or (gain, feature, cut, left sums)."""

    def __init__(self):
        self.tree, self.known, self.sums, self.path = Tree(), {}, {}, {0: 1}

    def reached(self, leaves: int) -> list[int]:
        """Nodes that are split, in order, as far as gains are known. Of equal gains the one further up and left."""
        heap, out = [], []

        def push(node: int) -> None:
            if self.known.get(node):
                heapq.heappush(heap, (-self.known[node][0], self.path[node], node))

        push(0)
        while heap and len(out) < leaves - 1:
            node = heapq.heappop(heap)[2]
            out.append(node)
            if self.tree.left[node] >= 0:
                push(self.tree.left[node])
                push(self.tree.right[node])
        return out

    def expand(self, s: Settings) -> list[int]:
        """Splits what is reached and wasn't split yet; the new nodes whose best split must be found."""
        asked = []
        for node in self.reached(s.leaves):
            if self.tree.left[node] < 0:
                _, feature, cut, left = self.known[node]
                pair = self.tree.split(node, feature, cut)
                for child, sums, bit in zip(pair, (left, self.sums[node] - left), (0, 1), strict=True):
                    self.sums[child], self.path[child] = sums, 2 * self.path[node] + bit
                    if sums[2] >= 2 * s.least_rows:
                        asked.append(child)
                    else:
                        self.known[child] = None
        return asked

    def finished(self, s: Settings) -> Tree:
        """The tree of the nodes that are split in the end, with the values of its leaves."""
        out, chosen = Tree(), set(self.reached(s.leaves))
        todo = [(0, 0)]
        while todo:
            here, there = todo.pop()
            if here in chosen:
                a, b = out.split(there, self.tree.feature[here], self.tree.cut[here])
                todo += [(self.tree.right[here], b), (self.tree.left[here], a)]
            else:
                out.value[there] = leaf_value(*self.sums[here][:2], s)
        return out


def _lists(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).astype(np.int64), column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(kind)


def _blobs(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of an array of binaries that hold numbers of that kind."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    return (at - at[0]) // size, np.frombuffer(data, kind, int(at[-1] - at[0]) // size, int(at[0])) if at[-1] > at[0] else np.zeros(0, kind)


def _numbers(rows: DataFrame, kind):
    """How vectors are read: lists of numbers, or binaries of 16-bit places and 32-bit values."""
    if rows.schema["places"].dataType.typeName() == "array":
        return lambda column: _lists(column, kind)
    stored = np.uint16 if kind == np.int64 else kind
    return lambda column: (lambda at, x: (at, x.astype(kind)))(*_blobs(column, stored))


def _binaries(offsets: np.ndarray, numbers: np.ndarray) -> pa.Array:
    numbers = np.ascontiguousarray(numbers)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * numbers.itemsize).astype(np.int32)), pa.py_buffer(numbers)])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Model:
    """Bins, scores before the first tree, and the trees of each round, one a class; settings for their number of classes."""

    def __init__(self, bins: Bins, first: np.ndarray, settings: Settings):
        self.bins, self.first, self.settings, self.rounds = bins, first, settings, []

    def raw(self, dense: np.ndarray) -> np.ndarray:
        out = np.repeat(self.first[None], len(dense), axis=0)
        for trees in self.rounds:
            out += np.stack([t.scores(dense) for t in trees], axis=1)
        return out

    def probabilities(self, offsets: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        return softmax(self.raw(self.bins.dense(*self.bins.cells(offsets, places, values))))

    def to_bytes(self) -> bytes:
        """The model as arrays; equal models give equal bytes."""
        trees = [t for trees in self.rounds for t in trees]
        parts = {f"tree_{f.name}": np.concatenate([np.zeros(0), *(getattr(t, f.name) for t in trees)]).astype(np.float64 if f.name == "value" else np.int64) for f in fields(Tree)}
        out = io.BytesIO()
        np.savez(
            out, settings=np.array(json.dumps(asdict(self.settings))), first=self.first, edges=np.concatenate([np.zeros(0, np.float32), *self.bins.edges]),
            edge_counts=np.array([len(e) for e in self.bins.edges], np.int64), nodes=np.array([len(t.left) for t in trees], np.int64), **parts,
        )
        return out.getvalue()

    @staticmethod
    def of_bytes(data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        model = Model(Bins(np.split(x["edges"], np.cumsum(x["edge_counts"])[:-1]) if len(x["edge_counts"]) else []), x["first"], Settings(**json.loads(str(x["settings"]))))
        cuts = np.cumsum(x["nodes"])[:-1]
        trees = [Tree(*columns) for columns in zip(*(np.split(x[f"tree_{f.name}"], cuts) for f in fields(Tree)), strict=True)] if len(x["nodes"]) else []
        classes = model.settings.classes
        model.rounds = [trees[at : at + classes] for at in range(0, len(trees), classes)]
        return model


def allowed(s: Settings, width: int, number: int, k: int) -> np.ndarray:
    """Features that the tree of class k may use in a round."""
    if s.feature_fraction >= 1:
        return np.ones(width, bool)
    chosen = np.random.default_rng([s.seed, number, k]).permutation(width)[: max(1, round(width * s.feature_fraction))]
    return np.isin(np.arange(width), chosen)


#: Rows whose sums are taken together, bits of their numbers, and what a row adds to a hessian's sum: both are whole numbers, so one sum of theirs is
#: exact and can be taken apart again (a hessian is 2**23 at most).
TOGETHER, BITS, ROW = 5000, 13, float(1 << 38)


class Sums:
    """Sums of asked (class, node)s by bin: [i] is (gradient, hessian, rows) by the bins of the features that the class may use,
    totals[i] the node's."""

    def __init__(self, bins: Bins, trees: dict[int, Tree], recent: list[list[Tree]], asked: list[tuple[int, int]], own: dict[int, np.ndarray]):
        self.bins, self.trees, self.recent, self.asked, self.own = bins, trees, recent, asked, own
        self.span, self.of = {}, {k: np.full(len(t.left), -1) for k, t in trees.items()}  # a class's nodes are one after another
        for i, (k, node) in enumerate(asked):
            self.of[k][node] = i
            self.span[k] = (self.span.get(k, (i, i))[0], i + 1)
        self.used = np.unique([f for t in [*(trees[k] for k in self.span), *(t for ts in recent for t in ts)] for f in t.walked()]).astype(np.int64)
        self.column = np.full(bins.width, -1)
        self.column[self.used] = np.arange(len(self.used))
        self.stretches, self.size = {}, {}  # first and last features of stretches, and what their bins' numbers are less by
        for k in self.span:
            f, count = own[k], np.diff(bins.starts)
            head = np.flatnonzero(np.diff(f, prepend=-2) != 1)
            first, last = f[head], f[np.append(head[1:], len(f)) - 1] if len(f) else f
            length = bins.starts[last + 1] - bins.starts[first]
            self.stretches[k] = first, last, bins.starts[first] - (np.cumsum(length) - length)
            self.size[k] = int(count[f].sum())
        self.wide = np.uint32 if bins.total <= 1 << 32 - BITS else np.uint64
        self.sums = {k: np.zeros((3, hi - lo, self.size[k])) for k, (lo, hi) in self.span.items()}
        self.totals = np.zeros((len(asked), 3))

    def __getitem__(self, i: int) -> np.ndarray:
        k = self.asked[i][0]
        return self.sums[k][:, i - self.span[k][0]]

    def add(self, offsets: np.ndarray, cells: np.ndarray, label: np.ndarray, scores: np.ndarray) -> None:
        bins, n = self.bins, len(label)
        # entries by cell, as one number each, so that those of a class's features are stretches, and sums are added to side by side
        entry = np.repeat(np.arange(n, dtype=self.wide), np.diff(offsets))
        entry |= cells.astype(self.wide) << self.wide(BITS)
        entry.sort()
        cells, row = (entry >> self.wide(BITS)).astype(np.int64), (entry & self.wide((1 << BITS) - 1)).astype(np.int64)
        cut = np.searchsorted(cells, bins.starts)
        dense = np.repeat(bins.zero[self.used].astype(np.uint8)[None], n, axis=0)  # of the features that trees ask for
        for j, f in enumerate(self.used.tolist()):
            dense[row[cut[f] : cut[f + 1]], j] = cells[cut[f] : cut[f + 1]] - bins.starts[f]
        for trees in self.recent:
            scores = scores + np.stack([t.scores(dense, self.column) for t in trees], axis=1)
        g, h = gradients(scores, label)
        for k, (lo, hi) in self.span.items():
            node = self.of[k][self.trees[k].node_of(dense, self.column)] - lo
            inside = node >= 0
            if not inside.any():
                continue
            weights, many, size = (g[:, k].copy(), h[:, k] + ROW), hi - lo, self.size[k]
            first, last, less = self.stretches[k]
            begin, end = cut[first], cut[last + 1]
            pieces = list(zip(begin.tolist(), end.tolist(), strict=True))
            if pieces:
                of_row = np.concatenate([row[a:b] for a, b in pieces])
                cell = np.concatenate([cells[a:b] for a, b in pieces]) - np.repeat(less, end - begin)
                if not inside.all():
                    here = np.flatnonzero(inside[of_row])
                    of_row, cell = of_row[here], cell[here]
                if many > 1:
                    cell += (node * size)[of_row]
                told = [np.bincount(cell, weights=w[of_row], minlength=many * size).reshape(many, size) for w in weights]
                self._added(self.sums[k], *told)
            self._added(self.totals[lo:hi].T, *(np.bincount(node[inside], weights=w[inside], minlength=many) for w in weights))

    @staticmethod
    def _added(to: np.ndarray, g: np.ndarray, both: np.ndarray) -> None:
        rows = np.floor(both * (1 / ROW))
        to[0] += g
        to[1] += both - rows * ROW
        to[2] += rows


def _splits(rows: DataFrame, bins: Bins, recent: list[list[Tree]], growing: list[Growing], asked: list[tuple[int, int]], number: int, s: Settings) -> None:
    """Finds the best split of each asked (class, node); a pass over the rows for each CELLS sums."""
    blocks, lo = [], 0  # features lo to hi - 1, of BLOCK bins or one feature
    while lo < bins.width:
        hi = max(lo + 1, int(np.searchsorted(bins.starts, bins.starts[lo] + BLOCK, "right")) - 1)
        blocks.append((lo, hi))
        lo = hi
    partial, may = {k: growing[k].tree for k, _ in asked}, {k: allowed(s, bins.width, number, k) for k, _ in asked}
    own = {(k, b): np.flatnonzero(may[k][lo:hi]) + lo for k in may for b, (lo, hi) in enumerate(blocks)}  # what a class uses of a block
    place = {(k, b): int(np.diff(bins.starts)[: lo][may[k][:lo]].sum()) for k in may for b, lo in enumerate([*(lo for lo, _ in blocks), bins.width])}  # first bin of a block's
    bag = int(s.bagging_fraction * (1 << 20)) if s.bagging_freq and s.bagging_fraction < 1 else 1 << 20
    salt = F.lit(s.seed * 1_000_003 + (number // s.bagging_freq if s.bagging_freq else 0))
    bagged = rows.where(F.pmod(F.xxhash64("place", salt), F.lit(1 << 20)) < bag) if bag < 1 << 20 else rows
    many = max(1, CELLS // max(1, bins.total))
    for at in range(0, len(asked), many):
        some = asked[at : at + many]  # a class's nodes are one after another

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(bins, partial, recent, some, {k: np.flatnonzero(may[k]) for k in may})
            for part in _parts(batches, TOGETHER):
                offsets, cells = _blobs(part.column(0), bins.kind)
                sums.add(offsets, cells, part.column(1).to_numpy(zero_copy_only=False), _blobs(part.column(2), float)[1].reshape(part.num_rows, -1))
            for i, (k, _) in enumerate(some):
                if sums.totals[i, 2]:
                    for b in range(len(blocks)):
                        blob = np.concatenate([sums.totals[i], sums[i][:, place[k, b] : place[k, b + 1]].ravel()])
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([b], pa.int32()), pa.array([blob.tobytes()], pa.binary())], ["node", "block", "sums"])

        def best(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
            whole = sum(np.frombuffer(b) for b in x["sums"])
            features = own[some[key[0]][0], key[1]]
            total, found = whole[:3], None
            if len(features):
                starts = np.concatenate([[0], np.cumsum(np.diff(bins.starts)[features])])
                found = best_split(whole[3:].reshape(3, -1), total, features, starts, bins.zero[features], s)
            gain, feature, cut, left = found or (0.0, -1, 0, np.zeros(3))
            return pd.DataFrame([(key[0], gain, feature, cut, *left, *total)], columns=["node", "gain", "feature", "cut", "lg", "lh", "ln", "g", "h", "n"])

        summed = bagged.select("cells", "label", "scores").mapInArrow(run, "node int, block int, sums binary")
        told = summed.groupBy("node", "block").applyInPandas(best, "node int, gain double, feature int, cut int, lg double, lh double, ln double, g double, h double, n double")
        for k, node in some:
            growing[k].known.setdefault(node, None)
        for r in sorted(told.collect(), key=lambda r: (-r["gain"], r["feature"])):  # a row a node and block
            k, node = some[r["node"]]
            growing[k].sums.setdefault(node, np.array([r["g"], r["h"], r["n"]]))
            if r["feature"] >= 0 and growing[k].known[node] is None:
                growing[k].known[node] = (r["gain"], r["feature"], r["cut"], np.array([r["lg"], r["lh"], r["ln"]]))


def train(rows: DataFrame, width: int, settings: Settings = Settings()) -> Model:
    """rows (places array<int>, values array<float>, label int) -> a model. Rows without label or vector don't count; a label
    outside the classes is an error. Rows are written in the shared folder, then their bins with their scores, these anew every
    WRITE rounds, and removed at the end. Without any row all classes are equally likely."""
    model, _, at = _trained(rows.where("label is not null"), width, settings, ())
    removed(rows.sparkSession, at)
    return model


def fitted(rows: DataFrame, width: int, settings: Settings, key: tuple[str, ...] = ("doc_id", "page_number", "pos")) -> DataFrame:
    """rows (key, places, values, label) -> key, p as `predict` gives it for all rows, by a model trained on those with a label.
    Vectors are written once and binned once, for training and for prediction."""
    model, data, _ = _trained(rows, width, settings, key)
    get, kinds, bins = shipped(rows.sparkSession, model.to_bytes(), Model.of_bytes), {f.name: f.dataType.simpleString() for f in rows.schema}, model.bins.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            model = get()
            p = softmax(model.raw(model.bins.dense(*_blobs(part.column(len(key)), bins))))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], _rows(p)], [*key, "p"])

    return data.select(*key, "cells").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", p array<double>")


def _rows(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(p) + 1) * p.shape[1]).astype(np.int32)), pa.array(p.ravel()))


def _trained(rows: DataFrame, width: int, settings: Settings, key: tuple[str, ...]) -> tuple[Model, DataFrame, str]:
    """The model of the rows that have a label, all rows with a vector as bins (key, cells, label, scores, place), and where these
    are written."""
    s, spark = settings, rows.sparkSession
    rows, raw = written(rows.where("places is not null and values is not null").select(*key, "places", "values", "label"))
    labelled = rows.where("label is not null")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(k < 0 or k >= s.classes for k in counts):
        raise ValueError(f"labels must be 0 to {s.classes - 1}")
    bins = quantile_bins(labelled, width, s.bins)
    share = np.array([counts.get(k, 0) for k in range(s.classes)], float)
    first = np.log(np.maximum(share / max(1.0, share.sum()), 1e-15)) if share.sum() else np.zeros(s.classes)
    model = Model(bins, first, s)
    get = _numbers(rows, np.int64), _numbers(rows, np.float32)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 10_000):
            offsets, places = get[0](part.column(0))
            offsets, cells = bins.cells(offsets, places, get[1](part.column(1))[1])
            scores = _binaries(np.arange(part.num_rows + 1) * s.classes, np.tile(first, part.num_rows))
            yield pa.RecordBatch.from_arrays([_binaries(offsets, cells.astype(bins.kind)), part.column(2), scores, *part.columns[3:]], ["cells", "label", "scores", "place", *key])

    kind, kinds = "cells binary, label int, scores binary, place long", {f.name: f.dataType.simpleString() for f in rows.schema}
    keyed = rows.select("places", "values", F.col("label").cast("int").alias("label"), F.xxhash64("places", "values", "label").alias("place"), *key)
    whole, first_at = written(keyed.mapInArrow(binned, ", ".join([kind, *(f"{k} {kinds[k]}" for k in key)])), "zstd")  # neighbours are alike
    data, at = whole.where("label is not null").drop(*key), first_at
    removed(spark, raw)
    recent: list[list[Tree]] = []
    for number in range(s.rounds):
        growing = [Growing() for _ in range(s.classes)]
        asked = [(k, 0) for k in range(s.classes)]
        while asked:
            _splits(data, bins, recent, growing, asked, number, s)
            asked = [(k, node) for k, g in enumerate(growing) for node in g.expand(s)]
        for g in growing:
            g.sums.setdefault(0, np.zeros(3))
        trees = [g.finished(s) for g in growing]
        model.rounds.append(trees)
        recent.append(trees)
        if all(t.left[0] < 0 for t in trees) and s.bagging_fraction >= 1 and s.feature_fraction >= 1:
            break  # no class has a split any more, nor will have in a later round
        if len(recent) == WRITE and number + 1 < s.rounds:
            now, old = list(recent), at

            def scored(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
                for part in _parts(batches):
                    dense = bins.dense(*_blobs(part.column(0), bins.kind))
                    scores = _blobs(part.column(2), float)[1].reshape(len(dense), -1)
                    for trees in now:
                        scores = scores + np.stack([t.scores(dense) for t in trees], axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binaries(np.arange(len(dense) + 1) * s.classes, scores), part.column(3)], ["cells", "label", "scores", "place"])

            data, at = written(data.mapInArrow(scored, kind), "zstd")
            if old != first_at:
                removed(spark, old)
            recent = []
    if at != first_at:
        removed(spark, at)
    return model, whole, first_at


def predict(rows: DataFrame, model: Model, key: tuple[str, ...] = ("doc_id", "page_number", "pos")) -> DataFrame:
    """rows (key, places, values) -> key, p array<double>: the probability of each class. The model goes out as a broadcast (its
    size is that of its trees, at most rounds x classes x leaves nodes), which a worker reads once however many tasks and queries
    use it."""
    get, kinds = shipped(rows.sparkSession, model.to_bytes(), Model.of_bytes), {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            n = len(key)
            offsets, places = _lists(part.column(n), np.int64)
            p = get().probabilities(offsets, places, _lists(part.column(n + 1), np.float32)[1])
            yield pa.RecordBatch.from_arrays([*part.columns[:n], _rows(p)], [*key, "p"])

    return rows.select(*key, "places", "values").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", p array<double>")
