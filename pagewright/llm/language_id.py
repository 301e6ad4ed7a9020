"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of its letters,
rotated by their place; a document's vector bundles (adds) its trigrams' vectors, and a language's prototype bundles the
unit vectors of documents in it, less the mean over the languages, since what all share tells none from another. The
language whose prototype has the largest cosine with the document is the prediction.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_texts

#: Length of the vectors, letter classes (code points go to them by value), documents a language that prototypes are fitted on.
DIM, CLASSES, FIT_ROWS, SEED = 1024, 512, 2000, 20240117
UNKNOWN = "und"
#: Trigram vectors that a worker keeps (1 KB each).
KEPT = 1 << 15


@cache
def letter_classes() -> np.ndarray:
    """The class of each code point, 0 for all that is no letter; made once a worker process."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = 1 + ord(chr(c).lower()[0]) % (CLASSES - 1)
    return out


class Encoder:
    """Texts to hyperdimensional vectors. The same seed gives the same letter vectors in every worker."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dim))
        self.letters[0] = 1  # white space and all that is no letter: neutral
        self.table, self.rows = np.zeros((1024, dim), np.int8), {}
        self.classes = letter_classes()

    def _vector(self, code: int) -> np.ndarray:
        a, b, c = code // CLASSES // CLASSES, code // CLASSES % CLASSES, code % CLASSES
        return np.roll(self.letters[a], 2) * np.roll(self.letters[b], 1) * self.letters[c]

    def _index(self, codes: list[int]) -> np.ndarray:
        if len(self.rows) + len(codes) > KEPT:
            self.rows = {}
        for c in codes:
            if c not in self.rows:
                n = len(self.rows)
                if n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[n] = self._vector(c)
                self.rows[c] = n
        return np.fromiter(map(self.rows.__getitem__, codes), np.int64, len(codes))

    def encode(self, text: str | None) -> np.ndarray | None:
        """The text's vector; None if it is null or has no letter."""
        if not text:
            return None
        x = self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)  # runs of others count as one
        x = np.concatenate([[0], x[keep], [0]]).astype(np.int64)
        if not x.any():
            return None
        codes = (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]
        codes, n = np.unique(codes, return_counts=True)
        out = np.zeros(self.table.shape[1], np.float32)
        for at in range(0, len(codes), 4096):
            rows = self._index(codes[at : at + 4096].tolist())
            out += n[at : at + 4096].astype(np.float32) @ self.table[rows].astype(np.float32)
        return out


def fit(docs: DataFrame, dim: int = DIM, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by language, from docs (doc_id, text, lang). About fit_rows documents a language are read, chosen by a
    hash of doc_id at a rate that follows from the language's count; languages with fewer are read whole."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    share = labelled.groupBy("lang").agg((F.lit(float(fit_rows)) / F.count(F.lit(1))).alias("rate"))
    chosen = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        encoder, sums = Encoder(dim), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (v := encoder.encode(text)) is not None and (norm := float(np.linalg.norm(v))):
                    sums[lang] = sums.get(lang, 0) + v / norm
        for lang, v in sums.items():  # a row for each language and task
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.astype(np.float64).tolist()])], ["lang", "v"])

    parts = chosen.mapInArrow(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():  # dim numbers a language
        out.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["x"]
    out = {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(out.items())}
    mean = sum(out.values()) / len(out) if len(out) > 1 else 0
    return {k: (v - mean) / (np.linalg.norm(v - mean) or 1) for k, v in out.items()}


def language_id(docs: DataFrame, prototypes: dict[str, np.ndarray], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text, any more) -> the given columns, lang_pred, score.

    The score is the best cosine with a prototype, cut to 0..1. A null text, or one without a letter, is `und` with score 0;
    so is every text if no prototype was learned. Equal cosines: the language first by name. Whole texts are read; repeated
    rows are answered each and a null in `columns` is given back; an empty table gives an empty result. Only `columns` and
    text are read, so that other names can't clash.
    """
    names = list(prototypes)
    matrix = np.array(list(prototypes.values()), np.float32) if names else np.zeros((0, DIM), np.float32)
    dim = matrix.shape[1]

    def make():
        encoder = Encoder(dim)

        def apply(cols):
            pred, score = [], []
            for text in cols["text"]:
                v = encoder.encode(text) if names else None
                if v is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                cos = matrix @ v / (float(np.linalg.norm(v)) or 1.0)
                best = int(np.argmax(cos))
                pred.append(names[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            return {c: cols[c] for c in columns} | {"lang_pred": pred, "score": score}

        return apply

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_texts(docs.select(*dict.fromkeys((*columns, "text"))), make, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    prototypes = fit(docs.where(~held))
    found = language_id(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
