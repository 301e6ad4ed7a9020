"""Decoding against a walk token by token, and against all paths."""

from itertools import product

import numpy as np
import pytest

from pagewright.operators import decoding

TYPES = decoding.TYPES


def one_by_one(logs, transition):
    """Types by a walk from the first to the last token, the first type on ties."""
    best, back = list(logs[0]), []
    for row in logs[1:]:
        scores = [[best[k] + transition[k][j] for k in range(TYPES)] for j in range(TYPES)]
        back.append([s.index(max(s)) for s in scores])
        best = [max(s) + e for s, e in zip(scores, row, strict=True)]
    path = [best.index(max(best))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def drawn(r, n, tied):
    p = r.integers(1, 4, (n, TYPES)).astype(float) if tied else r.random((n, TYPES)) ** 3
    return p / p.sum(axis=1, keepdims=True)


def decode(spark, pages, transition, stretch):
    rows = [(d, n, i + 1, row) for (d, n), page in pages.items() for i, row in enumerate(page.tolist())]
    np.random.default_rng(0).shuffle(rows)
    emi = spark.createDataFrame([(None if d is None else int(d), int(n), int(i), p) for d, n, i, p in rows], "doc_id long, page_number int, pos int, p array<double>")
    trans = spark.createDataFrame([(int(a), int(b), float(transition[a, b])) for a in range(TYPES) for b in range(TYPES) if transition[a, b]], "prev int, curr int, p double")
    out = {}
    for x in sorted(decoding.viterbi(emi, trans, stretch).collect(), key=lambda x: x["pos"]):
        out.setdefault((x["doc_id"], x["page_number"]), []).append((x["pos"], x["label"]))
    return out


@pytest.mark.parametrize("tied", [True, False])
@pytest.mark.parametrize("stretch", [1, 7, 1024])
def test_labels_of_stretches_are_those_of_one_walk(spark, tied, stretch):
    r = np.random.default_rng(stretch)
    transition = r.integers(0, 3, (TYPES, TYPES)) / 20 if tied else r.dirichlet(np.ones(TYPES), TYPES)
    pages = {(d, n): drawn(r, size, tied) for d, n, size in [(1, 1, 1), (1, 2, 2), (1, 3, 7), (2, 1, 8), (2, 2, 14), (2, 3, 15), (3, 1, 100), (None, 1, 40), (None, 2, 3)]}
    out = decode(spark, pages, transition, stretch)
    assert out.keys() == pages.keys()
    for key, p in pages.items():
        expected = one_by_one(decoding.fixed(p).tolist(), decoding.fixed(transition).tolist())
        assert out[key] == list(enumerate(expected, 1)), key


def test_a_page_of_a_hundred_thousand_tokens(spark):
    r = np.random.default_rng(5)
    base, transition = drawn(r, 1000, True), r.integers(0, 3, (TYPES, TYPES)) / 20
    parts = spark.createDataFrame([(int(i), base[i].tolist()) for i in range(1000)], "k int, p array<double>")
    emi = spark.range(100_000).selectExpr("7L as doc_id", "1 as page_number", "cast(id + 1 as int) as pos", "cast((id * id + id div 9) % 1000 as int) as k").join(parts, "k").drop("k")
    trans = spark.createDataFrame([(a, b, float(transition[a, b])) for a in range(TYPES) for b in range(TYPES)], "prev int, curr int, p double")
    got = [x["label"] for x in decoding.viterbi(emi, trans).orderBy("pos").collect()]
    ids = np.arange(100_000)
    logs = decoding.fixed(base)[(ids * ids + ids // 9) % 1000]
    assert got == decoding.decoded([logs], decoding.fixed(transition))[0].tolist()
    assert got[:2000] == one_by_one(logs.tolist(), decoding.fixed(transition).tolist())[:2000]


def test_gaps_and_repeated_places(spark):
    """Places 1, 5, 6, 30 and twice 31: the labels are those of six tokens in this order."""
    r = np.random.default_rng(2)
    p, transition = drawn(r, 6, True), r.integers(0, 3, (TYPES, TYPES)) / 20
    p[4:] = p[4]
    emi = spark.createDataFrame([(1, 1, at, x) for at, x in zip([1, 5, 6, 30, 31, 31], p.tolist(), strict=True)], "doc_id long, page_number int, pos int, p array<double>")
    trans = spark.createDataFrame([(a, b, float(transition[a, b])) for a in range(TYPES) for b in range(TYPES)], "prev int, curr int, p double")
    expected = one_by_one(decoding.fixed(p).tolist(), decoding.fixed(transition).tolist())
    for stretch in (4, 1024):
        got = [(x["pos"], x["label"]) for x in decoding.viterbi(emi, trans, stretch).collect()]
        assert sorted(got) == sorted(zip([1, 5, 6, 30, 31, 31], expected, strict=True))


def test_empty(spark):
    assert decode(spark, {}, np.full((TYPES, TYPES), 0.1), 4) == {}


def test_likeliest_of_all_paths():
    r = np.random.default_rng(1)
    for _ in range(3):
        e, t = np.full((4, TYPES), 1e-30), r.random((TYPES, TYPES))
        e[:, :3] = r.random((4, 3))
        logs, moves = decoding.fixed(e), decoding.fixed(t)
        score = lambda p: sum(logs[i, k] for i, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert score(decoding.decoded([logs], moves)[0].tolist()) == max(map(score, product(range(3), repeat=4)))
