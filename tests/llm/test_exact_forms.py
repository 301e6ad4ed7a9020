"""Operators against exact forms of what they approximate or order: cosines in full, kernel ridge, the order of blocks."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import language_id, mixing, quality


def full_vector(letters, text):
    """A text's vector trigram by trigram."""
    marks, out = [0], np.zeros(letters.shape[1])
    for c in text or "":
        k = 1 + ord(c.lower()[0]) % (len(letters) - 1) if c.isalpha() else 0
        if k or marks[-1]:
            marks.append(k)
    if not any(marks):
        return None
    marks = [0, *marks, 0] if not text[0].isalpha() else [*marks, 0]  # a mark at the start is one beside the text's edge
    for a, b, c in zip(marks, marks[1:], marks[2:], strict=False):
        out += np.roll(letters[a].astype(float), 2) * np.roll(letters[b].astype(float), 1) * letters[c]
    return out


def test_languages_by_cosines_in_full(spark):
    """Three alphabets, two languages of one script, whose words are made of the same characters, long and odd texts."""
    r = np.random.default_rng(4)
    han = [chr(0x4E00 + 7 * i) for i in range(60)]
    words = {g: ["".join(r.choice(han, 2)) for _ in range(40)] for g in ("ha", "hb")}
    draw = {
        "aa": lambda n: "".join(r.choice(list("abcdefg hij"), n)), "bb": lambda n: "".join(r.choice(list("éghi jklmn."), n)),
        "ha": lambda n: "".join(r.choice(words["ha"], n // 2)), "hb": lambda n: "".join(r.choice(words["hb"], n // 2)),
    }
    rows = [(i, draw[g](int(r.integers(80, 200))), g) for i, g in enumerate(sorted(draw) * 15)]
    rows += [(100, draw["ha"](60_000), "ha"), (101, draw["bb"](60_000), "bb"), (102, "  ", "aa"), (103, None, "bb"), (104, "Ж", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = language_id.fit(docs.where("doc_id < 60 and doc_id % 3 <> 1"))
    letters = language_id.Encoder().letters
    sums = defaultdict(float)
    for i, t, g in rows[:60]:
        if i % 3 != 1:
            v = full_vector(letters, t)
            sums[g] = sums[g] + v / np.linalg.norm(v)
    unit = {g: v / np.linalg.norm(v) for g, v in sums.items()}
    mean = sum(unit.values()) / len(unit)
    whole = {g: (v - mean) / np.linalg.norm(v - mean) for g, v in unit.items()}
    assert prototypes.keys() == whole.keys()
    got = {x["doc_id"]: x for x in language_id.language_id(docs, prototypes).collect()}
    for i, t, g in rows:
        v = full_vector(letters, t)
        if v is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cos = {k: float(p @ v / np.linalg.norm(v)) for k, p in whole.items()}
        assert got[i]["lang_pred"] == max(cos, key=cos.get), (i, cos)
        assert got[i]["score"] == pytest.approx(max(0.0, max(cos.values())), abs=1e-4)
        if g and t.strip() and i % 3 == 1:
            assert got[i]["lang_pred"] == g


def test_quality_against_kernel_ridge(spark):
    """Scores before calibration against ridge regression with the Gaussian kernel itself, on 200 rows."""
    import zstandard

    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 8)))
    kinds = [lambda: ". ".join(" ".join(word() for _ in range(r.integers(4, 12))).capitalize() for _ in range(r.integers(2, 9))), lambda: " ".join(word().upper() + "!" * int(r.integers(0, 3)) for _ in range(r.integers(5, 60)))]
    rows = [(i, kinds[int(i % 3 == 0)](), int((i % 3 > 0) ^ (i % 11 == 0))) for i in range(200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    held = {x["doc_id"] for x in docs.where(F.pmod(F.hash("doc_id"), F.lit(4)) == 0).collect()}
    weights, compressor = quality._weights(), zstandard.ZstdCompressor(level=1)
    stats = np.array([quality.statistics(t, weights, compressor) for _, t, _ in rows])
    use = np.array([i not in held for i, _, _ in rows])
    assert np.allclose(model.mean, stats[use].mean(0))
    z = np.clip((stats - stats[use].mean(0)) / np.sqrt(np.maximum(stats[use].var(0), 1e-8)), -6, 6)
    near = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * quality.WIDTH)) + z @ z.T / 64 + 1
    size, n = len(model.beta), int(use.sum())
    ridge = quality.RIDGE * np.trace(near[np.ix_(use, use)]) / size  # the trace of the features' moments is that of the kernel
    y = np.array([y for _, _, y in rows], float)
    exact = near[:, use] @ np.linalg.solve(near[np.ix_(use, use)] + ridge * np.eye(n), y[use])
    got = model.raw(stats)
    assert np.corrcoef(exact, got)[0, 1] > 0.97 and np.sqrt(np.mean((exact - got) ** 2)) < 0.12


@pytest.mark.parametrize("budget", [3000, 40_000])
def test_mixing_takes_blocks_in_order(spark, budget):
    """What a source has beyond whole epochs goes to its documents in the order of block_rank, doc_rank_key and doc_id, up to the
    first that no longer fits and to none after it. Rows that repeat a doc_id with other texts have a place each."""
    r = np.random.default_rng(6)
    rows = [(int(i), " ".join(["w"] * int(r.integers(0, 40))), "hot" if r.random() < 0.6 else f"s{i % 4}") for i in range(600)]
    rows += [(7, "a b c", "hot"), (7, "a b c d e f g", "hot"), (7, "a", "hot")]
    rows += [(9000, "w " * i, "same") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, budget=budget).collect()
    again = mixing.mix(docs.repartition(5, "text"), budget=budget).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    by_source = defaultdict(list)
    for x in got:
        by_source[x["source"]].append(x)
    for mine in by_source.values():
        mine.sort(key=lambda x: (x["block_rank"], x["doc_rank_key"], x["doc_id"], x["n_tokens"]))
        assert len({(x["block"], x["block_rank"]) for x in mine}) == len({x["block"] for x in mine}) == max(x["block_rank"] for x in mine)
        tokens, wanted = sum(x["n_tokens"] for x in mine), int(budget * mine[0]["weight"] * (1 + 1e-9))
        epochs, rest, before = wanted // tokens, wanted % tokens, 0
        for x in mine:
            before += x["n_tokens"]
            assert x["copies"] == epochs + (1 if 0 < x["n_tokens"] and before <= rest else 0)
