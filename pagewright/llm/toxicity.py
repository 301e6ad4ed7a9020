"""Toxicity scores: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

The n-grams of a labelled sample are counted by class, each once a document; tasks send sums by hashed n-gram. The ratio of an
n-gram is the logarithm of its share in toxic documents over that in others, and the n-grams that part the classes best (by
the likelihood ratio) are the features. A document's value of a feature is the ratio where the n-gram occurs, else 0, and a
logistic regression on these values gives the score; each of its steps is a sum over tasks, so the sample's rows stay on the
executors and the driver holds vectors of FEATURES numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stash

#: Lengths of n-grams, bits of their hash, features, labelled rows that a fit reads at most (about), documents that an n-gram
#: must be in, smoothing of the ratios, penalty and most steps of the regression, and the score from which a text is toxic.
SIZES, BITS, FEATURES, FIT_ROWS, LEAST, SMOOTH, PENALTY, STEPS, THRESHOLD = (3, 4, 5, 6), 20, 1 << 12, 16_000, 3, 1.0, 1.0, 60, 0.5
#: Characters that the kernel takes at a time; a longer text is taken in pieces that overlap.
CHARS = 1 << 19


def pieces(texts: list[str | None], most: int = CHARS) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of pieces of texts, lower case, with the number of the text of each. Together they hold all its n-grams."""
    group, owner, held = [], [], 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, max(1, len(low) - SIZES[-1] + 1), most):
            piece = low[at : at + most + SIZES[-1] - 1]
            if held + len(piece) > most and group:
                yield group, owner
                group, owner, held = [], [], 0
            group.append(piece)
            owner.append(i)
            held += len(piece)
    if group:
        yield group, owner


def hashed(group: list[str], owner: list[int], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, hash) of all n-grams of all pieces, for one length at a time."""
    codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, group), np.int64, len(group))
    piece = np.repeat(np.arange(len(group)), lengths)
    owners = np.asarray(owner)
    h = np.full(len(codes), 7, np.uint64)
    for n in range(1, SIZES[-1] + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            whole = piece[:size] == piece[n - 1 :]
            yield owners[piece[:size][whole]], ((h[whole] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(text: str | None, last: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hashes of all n-grams of a text, once each. last: room for a number for each hash; what it holds doesn't matter."""
    h = np.concatenate([np.zeros(0, np.int64), *(x for group in pieces([text]) for _, x in hashed(*group, bits))])
    at = np.arange(len(h), dtype=last.dtype)
    last[h] = at
    return h[last[h] == at]


def occurring(texts: list[str | None], slots: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, place) of each n-gram that occurs in it and has a place in slots (else -1), once each, ascending."""
    found = [np.zeros(0, np.int64)]
    for group, owner in pieces(texts):
        for doc, h in hashed(group, owner, bits):
            place = slots[h]
            keep = place >= 0
            found.append(np.unique((doc[keep] << bits) | place[keep]))
    both = np.unique(np.concatenate(found))
    return both >> bits, both & ((1 << bits) - 1)


class Model:
    """Places of the n-grams that are features, weights (ratio times coefficient), and the constant."""

    def __init__(self, hashes: np.ndarray, ratios: np.ndarray, bits: int = BITS):
        self.bits, self.hashes, self.ratios = bits, hashes.astype(np.int32), ratios
        self.w, self.b = np.zeros(len(hashes)), 0.0

    def slots(self) -> np.ndarray:
        slots = np.full(1 << self.bits, -1, np.int32)
        slots[self.hashes] = np.arange(len(self.hashes))
        return slots

    def score(self, texts: list[str | None], slots: np.ndarray) -> np.ndarray:
        """Rounded margins, so that equal texts have equal scores."""
        doc, place = occurring(texts, slots, self.bits)
        z = np.round(np.bincount(doc, weights=(self.ratios * self.w)[place], minlength=len(texts)) + self.b, 9)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rate = min(1.0, fit_rows / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    return stash(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"), "toxicity-fit")  # chosen: about fit_rows rows of two numbers


def _counted(sample: DataFrame, bits: int) -> DataFrame:
    """(hash, pos, neg): labelled documents of each class with the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros((2, 1 << bits), np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, label in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                total[0 if label > 0 else 1][distinct(text, last, bits)] += 1
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["hash", "pos", "neg"])

    return sample.mapInArrow(run, "hash long, pos long, neg long").groupBy("hash").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _placed(sample: DataFrame, model: Model) -> DataFrame:
    """(label, places array<int>) of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                doc, place = occurring(part.column(0).to_pylist(), slots, model.bits)
                offsets = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))], ["label", "places"])

    return sample.mapInArrow(run, "label int, places array<int>")


def _loss(placed: DataFrame, model: Model, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Penalised logistic loss of coefficients w (the constant last) and its gradient; tasks send vectors of that length."""
    ratios = model.ratios

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 1)
        for batch in batches:
            y, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            offsets, place = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(y)), np.diff(offsets))
            place = place[offsets[0] : offsets[-1]]
            z = np.bincount(doc, weights=(ratios * w[:-1])[place], minlength=len(y)) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            total[0] += np.sum(np.logaddexp(0, z) - y * z)
            total[1:-1] += np.bincount(place, weights=(p - y)[doc], minlength=len(ratios)) * ratios
            total[-1] += np.sum(p - y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    rows = placed.mapInArrow(run, "total binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    total = rows.treeReduce(np.add) if rows.getNumPartitions() else np.zeros(len(w) + 1)
    pull = np.append(np.full(len(w) - 1, PENALTY), 1e-3) * w  # the constant is held a little, for samples of one class
    return total[0] + pull @ w / 2, total[1:] + pull


def minimised(loss, w: np.ndarray, steps: int = STEPS, memory: int = 10, close: float = 1e-4) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps."""
    f, g = loss(w)
    first, pairs = np.linalg.norm(g), []
    while steps > 0 and np.linalg.norm(g) > close * max(1.0, first):
        d, alphas = -g, []
        for s, y in reversed(pairs):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        d = d * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, first))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0
        while steps > 0:
            steps -= 1
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        if f2 >= f:
            break
        s, y = step * d, g2 - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        w, f, g = w + s, f2, g2
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES, bits: int = BITS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic). About fit_rows labelled rows are read, chosen by a hash of
    doc_id. A document labelled twice counts once (its larger label); null labels and ids don't count."""
    sample = _sample(docs, labels, fit_rows)
    n = {r["label"]: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos + n_neg:
        return Model(np.zeros(0), np.zeros(0), bits)
    part = lambda a, b: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) * (n_pos + n_neg) / ((F.col("pos") + F.col("neg")) * max(1, b)))).otherwise(0.0)
    told = _counted(sample, bits).where(F.col("pos") + F.col("neg") >= LEAST).withColumn("gain", part("pos", n_pos) + part("neg", n_neg))
    best = told.orderBy(F.desc("gain"), "hash").limit(features).select("hash", "pos", "neg").collect()  # `features` rows at most
    table = np.array(best, float).reshape(-1, 3)
    table = table[np.argsort(table[:, 0])]
    ratios = np.log((table[:, 1] + SMOOTH) / (n_pos + 2 * SMOOTH)) - np.log((table[:, 2] + SMOOTH) / (n_neg + 2 * SMOOTH))
    model = Model(table[:, 0], ratios, bits)
    placed = stash(_placed(sample, model), "toxicity-places")
    w = minimised(lambda w: _loss(placed, model, w), np.zeros(len(ratios) + 1))
    model.w, model.b = w[:-1], float(w[-1])
    return model


def toxicity_scores(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """docs (text, any more) -> the given columns, score (0 to 1), predicted (1 from threshold on).

    Null and empty texts, which have no n-gram, get the score of the constant alone. Whole texts count, however long; repeated
    rows are answered each and a null in `columns` is given back; equal texts get equal scores; an empty table gives an empty
    result; without any label every score is 0.5. Only `columns` and text are read, so that other names can't clash.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                score = model.score(part.column(len(columns)).to_pylist(), slots)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*columns, "score", "predicted"])

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, labels.where(~held))
    return toxicity_scores(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
