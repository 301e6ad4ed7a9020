"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel on standardised statistics of a text. Tasks sum their parts of the normal
equations, the driver solves them (a matrix of fixed size), and pooled adjacent violators turn the ridge scores of rows
that the fit did not see into probabilities.
"""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, stash

#: Fourier features, ridge penalty, labelled rows that a fit reads at most (about), seed, and the score from which a row is good.
FEATURES, RIDGE, FIT_ROWS, SEED, THRESHOLD = 256, 1e-3, 16000, 7, 0.7

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\n", "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "mark": b"#$%&*", "odd": b"<>{}[]\\/=+_^~`@"}


def _weights() -> np.ndarray:
    w = np.zeros((256, len(_KINDS) + 1))
    for i, chars in enumerate(_KINDS.values()):
        w[list(chars), i] = 1
    w[128:, -1] = 1
    return w


WIDTH = len(_KINDS) + 1 + 9


def statistics(text: str | None, weights: np.ndarray, compressor) -> list[float]:
    """WIDTH statistics of a whole text; a null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    parts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ weights / max(1, n)
    words, lines = raw.split(), raw.split(b"\n")
    m = len(words)
    distinct = len(set(words))
    return [
        *np.sqrt(parts).tolist(),
        np.log1p(n),
        np.log1p(m),
        (n - len(lines)) / (m + 1) / 16,
        distinct / (m + 1),
        np.log1p(distinct),
        sum(map(operator.eq, words, words[1:])) / (m + 1),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        len(compressor.compress(raw)) / (n + 16),
    ]


def with_statistics(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    def make():
        import zstandard

        weights, compressor = _weights(), zstandard.ZstdCompressor(level=1)

        def apply(cols):
            return {c: cols[c] for c in columns} | {"stats": [statistics(t, weights, compressor) for t in cols["_text"]]}

        return apply

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_texts(docs.select(*columns, F.col("text").alias("_text")), make, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", stats array<double>")


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: block centres and means, both ascending. Equal scores are one block from the start, so that
    copies and empty texts get the mean of their labels."""
    values, place = np.unique(scores, return_inverse=True)
    count = np.bincount(place, minlength=len(values))
    good = np.bincount(place, weights=labels, minlength=len(values))
    blocks: list[list[float]] = []  # label sum, count, score sum
    for s, y, n in zip((values * count).tolist(), good.tolist(), count.tolist(), strict=True):
        blocks.append([y, n, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y1, n1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + n1, blocks[-1][2] + s1]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


class Model:
    """Standardisation, Fourier projection, ridge weights and calibration; small enough to go with a task."""

    def __init__(self, mean, scale, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + len(mean) + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z / 8, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Rounded, since the last bits of a product depend on a row's place among others and equal texts must tie."""
        return np.round(self.features(stats) @ self.beta, 10)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def _summed(df: DataFrame, shape: tuple[int, ...], part) -> np.ndarray:
    """The sum over tasks of part(list of column lists): arrays of a fixed shape, merged in a tree."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part([batch.column(i).to_pylist() for i in range(batch.num_columns)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    rows = df.mapInArrow(run, "total binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])).reshape(shape))
    return rows.treeReduce(np.add) if rows.getNumPartitions() else np.zeros(shape)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality). About fit_rows labelled rows are read, chosen by a hash
    of doc_id; a quarter of them calibrates. A document labelled twice counts once (its smaller label); null labels don't."""
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    rate = min(1.0, fit_rows / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    stats = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about fit_rows rows of two numbers
    data = stash(with_statistics(stats, ("doc_id", "label")), "quality-fit").withColumn("calibrates", F.pmod(F.hash("doc_id"), F.lit(4)) == 0)
    train = data.where("not calibrates").select("stats", "label")

    def moments(cols):
        x = np.array(cols[0])
        return np.stack([x.sum(0), (x**2).sum(0), np.full(WIDTH, len(x))])

    total, squares, n = _summed(train, (3, WIDTH), moments)
    mean = total / np.maximum(n, 1)
    model = Model(mean, np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 1e-8)))
    if not n[0]:
        return model

    def normal(cols):
        x = model.features(np.array(cols[0]))
        return x.T @ np.concatenate([x, np.array(cols[1])[:, None]], axis=1)

    size = len(model.beta)
    sums = _summed(train, (size, size + 1), normal) / n[0]
    model.beta = np.linalg.solve(sums[:, :size] + RIDGE * np.eye(size) * np.trace(sums[:, :size]) / size, sums[:, size])
    held = data.where("calibrates").select("stats", "label").collect()  # a quarter of the bounded sample
    if held:
        model.x, model.y = isotonic(model.raw(np.array([r[0] for r in held])), np.array([r[1] for r in held]))
    return model


def quality_scores(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """docs (text, any more) -> the given columns, score (0 to 1, calibrated probability of label 1), predicted (1 from threshold on).

    Null and empty texts are scored too, as texts without characters. Whole texts count; repeated rows are answered each and a
    null in `columns` is given back; equal texts get equal scores; an empty table gives an empty result; without any label
    every score is 0.5. Only `columns` and text are read, so that other names can't clash.
    """

    def make():
        import zstandard

        weights, compressor = _weights(), zstandard.ZstdCompressor(level=1)

        def apply(cols):
            score = model.score(np.array([statistics(t, weights, compressor) for t in cols["_text"]])) if cols["_text"] else np.zeros(0)
            return {c: cols[c] for c in columns} | {"score": score.tolist(), "predicted": [int(s >= threshold) for s in score]}

        return apply

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_texts(docs.select(*columns, F.col("text").alias("_text")), make, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, labels.where(~held))
    return quality_scores(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
