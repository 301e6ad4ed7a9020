"""Removal of repeated substrings through suffix arrays.

A byte goes if a LENGTH-byte string that covers it also starts earlier (smaller doc_id, or same document, earlier start).

Every window of LENGTH bytes has an anchor: the smallest, by hash, of its SEED_BYTES-byte strings. Equal windows have equal
anchors, and successive windows with one anchor form a run. A run's context, the bytes of its windows, is known by a hash;
runs count as equal if anchor's and context's hashes, 128 bits together, are.
1. Tasks find the runs of their texts and keep the first of equal runs in a slice of documents, and of those that are common
   in a slice the first that the task has met so far; the rest is covered. A hot passage so leaves a few rows a task.
2. Runs meet by anchor. Runs with equal contexts: all but the first are covered. An anchor with one context is done.
3. Anchors with several contexts, where repeats begin or end, go on with the first run of each context, and their bytes are
   cut from the documents. Anchors with over CROWD contexts get longer: a run is parted by where the anchor stands in its
   windows, and the bytes that all windows of a part have around the anchor become the part's anchor. Equal windows stay
   together, runs with different surroundings part, and at the latest an anchor of LENGTH bytes tells all windows apart. So no
   anchor, however hot, brings over CROWD contexts into one suffix array.
4. The enhanced suffix arrays of whole anchors give the maximal repeats with all their occurrences; all but the first
   occurrence are covered.
5. Each document's covered stretches are merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash
from .suffix_array import SuffixArray

#: Bytes of a repeat, of an anchor, documents of a slice, positions hashed at a time, context bytes of a suffix array, most
#: contexts of an anchor, and runs from which a context is common in a slice, with the most of these that a task remembers.
LENGTH, SEED_BYTES, SLICE, STEP, ARRAY_BYTES, CROWD, COMMON, KEPT = 100, 32, 256, 1 << 17, 1 << 20, 512, 8, 1 << 16
#: Tasks that a crowded anchor's contexts are dealt to where they meet their number.
SALTS = 32
#: A run's `windows` hold their number in the low bits, and above them where the anchor stands in the first of them.
PLACE = 1 << 12

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class Roller:
    """Polynomial hashes of all substrings of a stretch of at most STEP positions and their windows."""

    def __init__(self, length: int = LENGTH, seed_bytes: int = SEED_BYTES):
        n = STEP + length + 1
        self.length, self.k = length, seed_bytes
        self.power, self.inverse = (self._powers(b, n) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.letters = np.random.default_rng(3).integers(1, 1 << 64, 256, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(31))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def runs(self, raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """raw: bytes, end: for each position the end of its document (both as far as windows from the first STEP positions
        reach). Returns anchor hash, context hash, first window, windows (with PLACE), of each run that begins at one of those."""
        k, w = self.k, self.length - self.k + 1
        starts = np.flatnonzero(np.arange(min(STEP, len(raw))) + self.length <= end[:STEP])
        if not len(starts):
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        n = len(raw)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[raw] * self.power[:n], out=total[1:])
        h = self._mixed((total[k:] - total[:-k]) * self.inverse[: n - k + 1])
        low = np.uint64((1 << 20) - 1)  # a position fits in 20 bits: the smallest hash, then the first place
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-(len(h) + w) // w) * w, np.uint64(_MASK))
        padded[: len(h)] = packed
        table = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[starts], ahead[starts + w - 1]) & low).astype(np.int64)
        first = np.ones(len(starts), bool)
        first[1:] = (place[1:] != place[:-1]) | (np.diff(starts) != 1)
        at = np.flatnonzero(first)
        count = np.diff(np.concatenate([at, [len(starts)]]))
        begin = starts[at]
        context = self._mixed((total[begin + count - 1 + self.length] - total[begin]) * self.inverse[begin] + count.astype(np.uint64) * np.uint64(_BASE))
        return h[place[at]], context, begin, count + PLACE * (place[at] - begin)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents of a slice in order of doc_id."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            texts = part.column(1).to_pylist()
            yield ids[order], [texts[i] or b"" for i in order.tolist()]


RUNS = "anchor long, context long, doc long, pos long, windows int"


def runs_of(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc long not null, raw binary) -> RUNS. context 0 marks a run that an equal one of its task precedes; its anchor
    only spreads it."""

    def run(batches):
        roller, earliest = Roller(length), {}
        for ids, texts in _slices(batches):
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            raw = np.frombuffer(b"".join(texts), np.uint8)
            if not len(raw):
                continue
            end = np.repeat(ends, sizes)
            found = []
            for at in range(0, len(raw), STEP):
                stretch = slice(at, at + STEP + length)
                anchor, context, begin, count = roller.runs(raw[stretch], end[stretch] - at)
                found.append((anchor, context, begin + at, count))
            anchor, context, begin, count = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = np.searchsorted(ends, begin, side="right")
            doc, pos = ids[owner], begin - (ends - sizes)[owner]
            context[context == 0] = 1
            known, head, group, n = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
            again = (doc != doc[head[group]]) | (pos != pos[head[group]])
            if len(earliest) > KEPT:
                earliest = {}
            for k in np.flatnonzero(n >= COMMON).tolist():
                i = int(head[k])
                own, key = (int(doc[i]), int(pos[i])), (int(known[k]), int(anchor[i]))
                if earliest.get(key, own) < own:
                    again[i] = True
                else:
                    earliest[key] = own
            anchor = np.where(again, roller._mixed(context + doc.astype(np.uint64)), anchor)
            context = np.where(again, np.uint64(0), context)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(pos), pa.array(count.astype(np.int32))], ["anchor", "context", "doc", "pos", "windows"])

    return docs.mapInArrow(run, RUNS)


def resolved(runs: DataFrame) -> DataFrame:
    """Runs met by anchor -> open boolean, RUNS: covered runs (open false), and the first run of each context where an anchor
    has several (open true)."""
    met = runs.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "pos")

    def run(batches):
        held = None  # rows of the last context so far: its first, and whether its anchor had another before
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]) if batch.num_rows else None
            if x is None:
                continue
            flagged = x[1] == 0
            out = [(False, x[:, flagged])]
            x = x[:, ~flagged]
            before = 0
            if held is not None:
                x, before = np.concatenate([held[0], x], axis=1), held[1]
            if not x.shape[1]:
                yield from _rows(out)
                continue
            first = np.ones(x.shape[1], bool)
            first[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
            heads = np.flatnonzero(first)
            head = heads[np.cumsum(first) - 1]
            out.append((False, x[:, ~first & ((x[2] != x[2][head]) | (x[3] != x[3][head]))]))
            a = x[0][heads]
            several = np.zeros(len(heads), bool)
            several[1:] |= a[1:] == a[:-1]
            several[:-1] |= a[1:] == a[:-1]
            several[0] |= bool(before) and not (held is None)
            out.append((True, x[:, heads[:-1][several[:-1]]]))
            held = (x[:, heads[-1:]].copy(), int(several[-1]))
            yield from _rows(out)
        if held is not None and held[1]:
            yield from _rows([(True, held[0])])

    def _rows(parts):
        for is_open, x in parts:
            if x.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(x.shape[1], is_open)), *(pa.array(x[i]) for i in range(4)), pa.array(x[4].astype(np.int32))], ["open", "anchor", "context", "doc", "pos", "windows"])

    return met.mapInArrow(run, "open boolean, " + RUNS)


CUT = "anchor long, doc long, pos long, place int, low int, high int, bytes binary"


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])


_CUT = [("anchor", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary())]


def contexts(docs: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes of the wanted runs (RUNS), cut from their documents: CUT. place is where the anchor begins in them, low..high
    where it may stand in a window. A document's runs go to it as one list, which its own length bounds."""
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "pos", "windows")).alias("runs"))
    joined = docs.join(per_doc, "doc").select("doc", "raw", "runs")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for doc, raw, runs in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    rows += [(r["anchor"], doc, r["pos"], r["windows"] // PLACE, 0, length - SEED_BYTES, raw[r["pos"] : r["pos"] + r["windows"] % PLACE - 1 + length]) for r in runs]
                if rows:
                    yield _batch(rows, _CUT)

    return joined.mapInArrow(run, CUT)


def longer_anchors(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """CUT -> context long, CUT: each run in two parts, the windows in which the anchor stands at low..middle and at middle+1
    ..high bytes from the start. The bytes that windows with these places have in common are the part's anchor."""
    schema = [("context", pa.int64()), *_CUT]

    def run(batches):
        import xxhash

        def signed(raw, seed):
            return xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = []
                for doc, pos, place, low, high, raw in zip(*(part.column(c).to_pylist() for c in ("doc", "pos", "place", "low", "high", "bytes")), strict=True):
                    middle = (low + high) // 2
                    for lo, hi in ((low, middle), (middle + 1, high)):
                        first, last = max(0, place - hi), min(len(raw) - length, place - lo)
                        if first <= last and lo <= hi:
                            own = raw[first : last + length]
                            rows.append((signed(own, 1), signed(raw[place - lo : place - hi + length], 2 + lo), doc, pos + first, place - first, lo, hi, own))
                if rows:
                    yield _batch(rows, schema)

    return cut.mapInArrow(run, "context long, " + CUT)


def part_crowds(cut: DataFrame, crowds: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """CUT, crowds (anchor) -> (anchor, doc, pos, bytes with at most `crowd` contexts an anchor; doc, start, end of covered
    stretches). A round halves low..high; where they meet, contexts are anchors and no anchor has several. Counts, minima and
    joins combine on the map side or can be split by adaptive execution, so hot anchors and contexts stay spread."""
    own = ["anchor", "doc", "pos", "bytes"]
    calm, covered = cut.join(crowds, "anchor", "left_anti").select(own), []
    rows = cut.join(crowds, "anchor", "left_semi").select(*cut.columns)
    while True:
        parts = stash(longer_anchors(rows, length), "substring-parts")
        heads = parts.groupBy("anchor", "context").agg(F.min(F.struct("doc", "pos")).alias("head"))
        several = heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot anchor's contexts go to many tasks
        heads = heads.withColumn("salt", F.pmod("context", F.lit(SALTS)).cast("int")).join(several, ["anchor", "salt"], "left")
        heads = heads.select("anchor", "context", F.col("head.doc").alias("head_doc"), F.col("head.pos").alias("head_pos"), F.coalesce("n", F.lit(1)).alias("n"))
        met = stash(parts.join(heads, ["anchor", "context"]), "substring-parted")
        is_head = (F.col("doc") == F.col("head_doc")) & (F.col("pos") == F.col("head_pos"))
        covered.append(met.where(~is_head).select("doc", F.col("pos").alias("start"), (F.col("pos") + F.length("bytes")).alias("end")))
        calm = calm.unionByName(met.where(is_head & (F.col("n") > 1) & (F.col("n") <= crowd)).select(own))
        rows = met.where(is_head & (F.col("n") > crowd)).select(*cut.columns)
        if rows.isEmpty():
            return calm, reduce(DataFrame.union, covered)


def covered_by_repeats(doc: np.ndarray, pos: np.ndarray, strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings at (doc, pos) -> (doc, start, end): what all but the first occurrence of each maximal repeat cover, merged."""
    array = SuffixArray(strings, 2 * length)
    order = array.order
    s, offset = array.place(order)
    place = np.empty(len(order), np.int64)  # of each suffix in the order of (doc, start)
    place[np.lexsort((pos[s] + offset, doc[s]))] = np.arange(len(order))
    covered = np.zeros(len(order), np.int64)  # bytes from each suffix's start
    for size, first, end in array.intervals(length):
        part = covered[first:end]
        least = int(place[first:end].argmin())
        before = part[least]
        np.maximum(part, size, out=part)
        part[least] = before
    hit = covered > 0
    d, p, e = doc[s[hit]], pos[s[hit]] + offset[hit], pos[s[hit]] + offset[hit] + covered[hit]
    by = np.lexsort((p, d))
    d, p, e = d[by], p[by], e[by]
    # stretches of one document that touch become one; ends are made to ascend over documents by their number
    number = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]])) if len(d) else d
    wide = int(e.max()) + 1 if len(e) else 1
    upto = np.maximum.accumulate(number * wide + e)
    head = np.ones(len(d), bool)
    head[1:] = number[1:] * wide + p[1:] > upto[:-1]
    at = np.flatnonzero(head)
    last = np.concatenate([at[1:], [len(d)]]) - 1 if len(d) else at
    return d[at], p[at], upto[last] - number[last] * wide


def repeats_within(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor, doc, pos, bytes -> doc, start, end of covered stretches; whole anchors go into a suffix array together, a run
    that stands twice, since rows repeat its document, once."""
    met = cut.repartition("anchor").sortWithinPartitions("anchor", "doc", "pos")

    def found(rows):
        d, s, e = covered_by_repeats(np.array(rows[1], np.int64), np.array(rows[2], np.int64), rows[3], length)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], ["doc", "start", "end"])

    def run(batches):
        rows, size, before = [[], [], [], []], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[:3] == before:
                    continue
                before = row[:3]
                if size >= ARRAY_BYTES and row[0] != rows[0][-1]:
                    yield found(rows)
                    rows, size = [[], [], [], []], 0
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
                size += len(row[3]) + 1
        if size:
            yield found(rows)

    return met.mapInArrow(run, "doc long, start long, end long")


def substring_dedup(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, kept binary, n_bytes, n_removed, n_spans, one row for each input row.

    Texts are UTF-8 bytes, so a cut may fall within a character; matches never cross documents; strings are judged on the
    input. A null text counts as empty, and texts under `length` bytes lose nothing. A row whose doc_id is null comes after all others and
    keeps its text whole. Rows that repeat a doc_id must repeat its text and are answered alike. An empty table gives an
    empty result. Columns beyond doc_id and text are not read. doc_id: an integer.
    """
    kind = dict(docs.dtypes)["doc_id"]
    bytes_ = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    named = bytes_.where("doc is not null")
    met = stash(resolved(runs_of(named, length)), "substring-runs")
    whole = met.where("not open").select("doc", F.col("pos").alias("start"), (F.col("pos") + F.col("windows") % PLACE - 1 + length).alias("end"))
    wanted = met.where("open").drop("open")
    crowds = stash(wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("anchor"), "substring-crowds")
    cut = contexts(named, wanted, length)
    if crowds.isEmpty():
        calm, parted = cut.select("anchor", "doc", "pos", "bytes"), None
    else:
        calm, parted = part_crowds(stash(cut, "substring-contexts"), crowds, length, crowd)
    part = stash(repeats_within(calm, length), "substring-repeats")
    spans = whole.union(part) if parted is None else whole.union(part).union(parted)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = bytes_.join(spans, "doc", "left").select("doc", "raw", "spans")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for doc, raw, spans in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    runs: list[list[int]] = []
                    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], e)
                        else:
                            runs.append([s, e])
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((doc, kept, len(raw), len(raw) - len(kept), len(runs)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long").withColumn("doc_id", F.col("doc_id").cast(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
