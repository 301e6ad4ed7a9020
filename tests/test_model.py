"""The token type model: its matrix by a plain walk over pairs of tokens, its trees by a plain search over all splits."""

import unicodedata

import numpy as np
import pytest

from pagewright.operators import boosting, matrix, model, sweep
from pagewright.operators.features import CATEGORIES, categories
from pagewright.plans import queries

KEY = ["doc_id", "page_number", "pos"]
TOK = "doc_id long, page_number int, pos int, content string, `left` int, top int, `right` int, bottom int, width int, height int, font_id int, token_type int"
WORDS = ["Ab c", "x", "1.2, (3)", "long content of a token", "", "é", "end.", " ²"]


def pages(seed=1):
    """Pages of 1, 2, 5 and 40 tokens, one token at the padding's corner, columns that go back up."""
    r = np.random.default_rng(seed)
    out = []
    for doc, number, n in ((1, 1, 1), (1, 3, 2), (2, 1, 5), (3, 1, 40)):
        for pos in range(1, n + 1):
            x, y, w, h = (int(v) for v in (r.integers(0, 500), r.integers(0, 200), r.integers(1, 60), r.integers(1, 14)))
            if (doc, pos) == (2, 4):
                x, y = -1, -1
            out.append({"doc_id": doc, "page_number": number, "pos": pos, "content": str(r.choice(WORDS)), "left": x, "top": y, "right": x + w, "bottom": y + h, "font_id": int(r.integers(3)),
                        "ctx": [int(v) for v in r.integers(0, 500, 4)], "text": [float(v) for v in r.integers(0, 3, 12)], "ro": int(pos + r.integers(0, 3)), "touches": bool(r.random() < 0.5)})
    return out


MODES = {1: (3, 40, 12.0), 2: (0, 7, 10.0)}  # document 3 has none


def by_hand(tokens):
    """(doc, page, pos) -> the 4008 numbers of its eight pairs."""
    pad = {"pad": True, "content": "", "left": -1, "top": -1, "right": 1, "bottom": 1, "font_id": "pad", "ctx": [0] * 4, "text": [0.0] * 12}
    out = {}
    for doc, number in sorted({(t["doc_id"], t["page_number"]) for t in tokens}):
        own = [t for t in tokens if (t["doc_id"], t["page_number"]) == (doc, number)]
        lines, rights, font = MODES.get(doc, (0, 0, 0.0))
        row = [pad] * 4 + own + [pad] * 4
        touch = lambda t: float(t["touches"] if "pad" not in t else any(o["touches"] for o in own if (o["left"], o["top"]) == (-1, -1)))
        w0, h0 = min(o["left"] for o in own), min(o["top"] for o in own)
        wide, high = max(max(o["right"] for o in own) - w0, 1), max(max(o["bottom"] for o in own) - h0, 1)
        vectors = []
        for a, b in zip(row, row[1:], strict=False):
            ha, hb, wa, wb = a["bottom"] - a["top"], b["bottom"] - b["top"], a["right"] - a["left"], b["right"] - b["left"]
            count = lambda t, chars: sum(t["content"].count(c) for c in chars)
            marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
            v = [a["font_id"] == b["font_id"], font / 100, len(a["content"]), len(b["content"]), count(a, " "), count(b, " "), count(a, marks), count(b, marks)]
            between = [o for o in own if a["bottom"] <= o["top"] < b["top"]]
            apart = b["top"] - a["top"] - ha
            gap = apart if not between else apart - (b["top"] - max(o["bottom"] for o in between)) + (min(o["top"] for o in between) - a["top"] - ha)
            ra, rb, la, lb = max(a["right"], a["ctx"][3]), max(b["right"], b["ctx"][3]), min(a["left"], a["ctx"][1]), min(b["left"], b["ctx"][1])
            v += [ra, a["top"], a["right"], wa, ha, b["top"], b["right"], wb, hb, b["left"] - a["left"] - wa, a["left"] - b["left"], a["ctx"][2] - a["right"], b["left"] - b["ctx"][0], ha - hb, apart, apart - lines, gap, apart - ha, abs(ra - rb), la - lb, lines - gap, rights - ra]
            v += a["text"] + b["text"]
            if "pad" in a or "pad" in b:
                v += [0] * 6
            else:
                reach = max(own[-1]["ro"] - own[0]["ro"], 1)
                v += [(b["ro"] - a["ro"]) / len(own), (a["ro"] - own[0]["ro"]) / reach, (b["ro"] - own[0]["ro"]) / reach, abs(b["ro"] - a["ro"]) <= 2, a["ro"], b["ro"]]
            x, xr, y = (a["left"] - w0) / wide, (a["right"] - w0) / wide, (a["top"] - h0) / high
            v += [x, y, y < 0.1, y > 0.9, x < 0.05, xr > 0.95, min(len(own) / 2000, 1), touch(a), touch(b)]
            for t in (a, b):
                v += [-1] * 216 if "pad" in t else [float(k == c) for c in categories(t["content"]) for k in range(27)]
            assert len(v) == 501
            vectors.append([float(z) for z in v])
        for i, t in enumerate(own):
            out[doc, number, t["pos"]] = np.array(sum(vectors[i : i + 8], []), np.float32)
    return out


def frames(spark, tokens):
    make = lambda f, schema: spark.createDataFrame([(*(t[k] for k in KEY), *f(t)) for t in tokens], "doc_id long, page_number int, pos int, " + schema).repartition(3)
    box = lambda t: (t["content"], t["left"], t["top"], t["right"], t["bottom"], t["right"] - t["left"], t["bottom"] - t["top"], t["font_id"], 6)
    return {
        "tok": make(box, TOK.split(", ", 3)[3]), "ctx": make(lambda t: t["ctx"], ", ".join(f"{c} int" for c in matrix.CONTEXTS)), "texts": make(lambda t: t["text"], ", ".join(f"{c} double" for c in matrix.TEXTS)),
        "slots": make(lambda t: (",".join(map(str, categories(t["content"]))),), "slots string"), "ord": make(lambda t: (t["ro"],), "reading_order_no int"), "touching": make(lambda t: (t["touches"],), "touches boolean"),
        "modes": spark.createDataFrame([(d, a, b) for d, (a, b, _) in MODES.items()], "doc_id long, lines_space_mode int, right_space_mode int"), "fontmode": spark.createDataFrame([(d, c) for d, (_, _, c) in MODES.items()], "doc_id long, font_size_mode double"),
    }


@pytest.mark.parametrize("together", [3, 16_384])
def test_matrix(spark, monkeypatch, together):
    monkeypatch.setattr(matrix, "TOKENS", together)
    tokens = pages()
    got = {tuple(r[k] for k in KEY): (r["places"], r["values"]) for r in matrix._token_matrix(**frames(spark, tokens)).collect()}
    want = by_hand(tokens)
    assert set(got) == set(want)
    for k, (places, values) in got.items():
        assert list(places) == sorted(places) and 0.0 not in values
        dense = np.zeros(8 * 501, np.float32)
        dense[places] = values
        assert np.allclose(dense, want[k], rtol=1e-5, atol=1e-5), (k, [(i // 501, i % 501) for i in np.flatnonzero(~np.isclose(dense, want[k], atol=1e-5))[:5]])


def test_matrix_of_a_page_of_one(spark):
    """Worked out: three pairs of paddings, the two with the token, three of paddings."""
    token = {"doc_id": 9, "page_number": 1, "pos": 1, "content": "Ab", "left": 10, "top": 20, "right": 30, "bottom": 32, "font_id": 1, "ctx": [0] * 4, "text": [0.0] * 12, "ro": 5, "touches": True}
    (r,) = matrix._token_matrix(**frames(spark, [token])).collect()
    dense = np.zeros((8, 501))
    dense.reshape(-1)[r["places"]] = r["values"]
    pads, first, second = dense[0], dense[3], dense[4]
    assert (dense[[1, 2, 5, 6, 7]] == pads).all()
    assert pads[:10].tolist() == [1, 0, 0, 0, 0, 0, 0, 0, 1, -1] and (pads[69:] == -1).all()
    assert first[:8].tolist() == [0, 0, 0, 2, 0, 0, 0, 0] and second[:8].tolist() == [0, 0, 2, 0, 0, 0, 0, 0]
    # from the padding at -1..1 down to the token: 20 - -1 - 2 from bottom to top, nothing starts between
    assert first[8:30].tolist() == [1, -1, 1, 2, 2, 20, 30, 20, 12, 9, -11, -1, 10, -10, 19, 19, 19, 17, 29, -1, -19, -1]
    assert first[54:60].tolist() == [0] * 6 and first[67:69].tolist() == [0, 1] and second[67:69].tolist() == [1, 0]
    assert (first[69:285] == -1).all() and np.flatnonzero(first[285:]).tolist() == [CATEGORIES.index("Lu"), 27 + CATEGORIES.index("Ll")]


def test_categories_without_a_place():
    assert categories("a  \0b") == [CATEGORIES.index("Ll"), -1, -1, -1, CATEGORIES.index("Ll"), -1, -1, -1]
    assert all(-1 <= k < 27 for c in range(0, 0x3000, 7) if unicodedata.category(chr(c)) != "Cs" for k in categories(chr(c)))


FEW = boosting.Settings(rounds=3, leaves=7, feature_fraction=0.7, bagging_fraction=1.0, least_rows=10, classes=3, bins=64)


def sample(n=500, width=12, seed=3):
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, width)) < 0.5, 0, r.normal(size=(n, width)).round(2)).astype(np.float32)
    x[:, 3], x[:, 4] = r.integers(0, 2, n), -1
    y = ((x[:, 0] > 0.2).astype(int) + 2 * ((x[:, 1] < -0.1) & (x[:, 3] > 0))).clip(0, 2)
    y[: n // 20] = r.integers(0, 3, n // 20)
    return x, y


def vectors(spark, x, y, parts=3):
    rows = [(i, [int(j) for j in np.flatnonzero(v)], [float(a) for a in v[np.flatnonzero(v)]], int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, places array<int>, values array<float>, label int").repartition(parts)


def grown(bins, g, h, allowed, s):
    """Best-first growth: every feature and cut of every leaf by a walk over the rows."""
    unit = boosting.UNIT
    score = lambda r: max(abs(g[r].sum() / unit) - s.l1, 0) ** 2 / (h[r].sum() / unit + s.l2)

    def best(r):
        found = None
        for f in np.flatnonzero(allowed):
            for cut in range(int(bins[:, f].max())):
                a, b = r[bins[r, f] <= cut], r[bins[r, f] > cut]
                if min(len(a), len(b)) >= s.least_rows and min(h[a].sum(), h[b].sum()) / unit >= s.least_hessian:
                    gain = score(a) + score(b) - score(r)
                    if gain > 0 and (found is None or gain > found[0]):
                        found = (gain, f, cut, a, b)
        return found

    leaves = [(np.arange(len(bins)), "", best(np.arange(len(bins))))]
    splits = {}
    while len(leaves) < s.leaves and any(leaf[2] for leaf in leaves):
        i = max((k for k in range(len(leaves)) if leaves[k][2]), key=lambda k: leaves[k][2][0])
        _, path, (_, f, cut, a, b) = leaves.pop(i)
        splits[path] = (int(f), cut)
        leaves += [(a, path + "l", best(a)), (b, path + "r", best(b))]
    value = {path: -np.sign(g[r].sum()) * max(abs(g[r].sum() / unit) - s.l1, 0) / (h[r].sum() / unit + s.l2) * s.rate for r, path, _ in leaves}
    return splits, value, {path: r for r, path, _ in leaves}


def test_boosting_grows_the_trees_of_a_full_search(spark):
    x, y = sample()
    made = boosting.train(vectors(spark, x, y), 12, FEW)
    dense = np.stack([np.searchsorted(made.bins.edges[f], x[:, f]) for f in range(12)], axis=1)
    scores = np.repeat(np.log(np.bincount(y, minlength=3) / len(y))[None], len(y), axis=0)
    for number, trees in enumerate(made.rounds):
        g, h = boosting.gradients(scores, y)
        step = np.zeros_like(scores)
        for k, tree in enumerate(trees):
            splits, value, rows = grown(dense, g[:, k], h[:, k], boosting.allowed(FEW, 12, number, k), FEW)
            got_splits, got_values, todo = {}, {}, [(0, "")]
            while todo:
                node, path = todo.pop()
                if tree.left[node] < 0:
                    got_values[path] = tree.value[node]
                else:
                    got_splits[path] = (tree.feature[node], tree.cut[node])
                    todo += [(tree.left[node], path + "l"), (tree.right[node], path + "r")]
            assert got_splits == splits and splits
            assert got_values == pytest.approx(value)
            for path, r in rows.items():
                step[r, k] = value[path]
        scores = scores + step
    again = boosting.train(vectors(spark, x, y, 7), 12, FEW)
    assert [[t.__dict__ for t in trees] for trees in again.rounds] == [[t.__dict__ for t in trees] for trees in made.rounds]


def test_boosting_is_better_than_a_linear_model_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE", 2)  # scores are written between rounds
    x, y = sample(1200)
    s = boosting.Settings(rounds=12, leaves=15, rate=0.3, least_rows=10, classes=3, bagging_freq=2)
    rows = vectors(spark, x, y)
    p = {r["doc_id"]: r["p"] for r in boosting.predict(rows.where("doc_id >= 900"), boosting.train(rows.where("doc_id < 900"), 12, s), ("doc_id",)).collect()}
    boosted = -np.mean([np.log(p[i][y[i]]) for i in range(900, 1200)])
    flat = spark.createDataFrame([(i, [float(a) for a in v], int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "doc_id long, features array<float>, label int")
    linear = {r["doc_id"]: r["p"] for r in model.score(flat.where("doc_id >= 900"), model.train(flat.where("doc_id < 900"))).collect()}
    assert boosted < 0.6 * -np.mean([np.log(max(1e-9, linear[i][y[i]])) for i in range(900, 1200)])


def test_boosting_of_few_rows(spark):
    """Without rows all classes are equally likely; too few for a split leave the shares of the classes."""
    x, y = sample(12)
    rows = vectors(spark, x, y)
    none = boosting.train(rows.limit(0), 12, FEW)
    assert np.allclose(none.probabilities(np.array([0, 0]), np.zeros(0, int), np.zeros(0)), 1 / 3)
    some = boosting.train(rows.unionByName(rows.selectExpr("doc_id", "places", "values", "cast(null as int) label")), 12, boosting.Settings(rounds=2, classes=3, rate=1e-9))
    (p,) = boosting.predict(rows.limit(1), some, ("doc_id",)).collect()
    assert np.allclose(p["p"], np.bincount(y, minlength=3) / 12, atol=1e-6)
    with pytest.raises(ValueError, match="labels"):
        boosting.train(rows.selectExpr("places", "values", "7 as label"), 12, FEW)


def test_sums_that_are_taken_in_parts_are_the_same(spark, monkeypatch):
    x, y = sample(200, 6)
    s = boosting.Settings(rounds=2, leaves=5, least_rows=5, classes=3)
    whole = boosting.train(vectors(spark, x, y), 6, s)
    monkeypatch.setattr(boosting, "BLOCK", 8)
    monkeypatch.setattr(boosting, "CELLS", 64)
    parts = boosting.train(vectors(spark, x, y), 6, s)
    assert [[t.__dict__ for t in trees] for trees in parts.rounds] == [[t.__dict__ for t in trees] for trees in whole.rounds]


def test_emissions_are_probabilities(spark, tmp_path):
    text = "\n".join(f"Row {i}. cell {i * 7}. value {i * i}. Title Case" for i in range(40))
    spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "Short. text", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["model_emissions"](spark, str(tmp_path)).collect()
    p = np.array([[float(v) for v in r["p"].split(",")] for r in got])
    assert len(got) == 162 and p.shape[1] == 11 and np.allclose(p.sum(1), 1, atol=1e-3)


def brute_near(tokens):
    """What sweep says of each token, by a look at every other token of its page."""
    out = {}
    for i, t in enumerate(tokens):
        own = [o for o in tokens if o[0] == t[0]]
        page, x0, y0, x1, y1, h = t
        line = [o for o in own if y0 - h <= o[2] <= y0 + h and (o[2] <= y0 < o[2] + o[5] or o[2] < y1 <= o[2] + o[5])]
        lefts, rights = [o for o in line if o[3] < x1], [o for o in line if x0 < o[1]]
        ahead = tokens[i + 1] if i + 1 < len(tokens) and tokens[i + 1][0] == page else None
        gap = None
        if ahead:
            between = [o for o in own if y1 <= o[2] < ahead[2]]
            gap = ahead[2] - y0 - h
            if between:
                gap -= (ahead[2] - max(o[4] for o in between)) - (min(o[2] for o in between) - y0 - h)
        under = [o[2] for o in own if o[2] > y1]
        ends = line and not any(o[1] > x1 for o in line)
        out[i] = (max((o[3] for o in lefts), default=0), min((o[1] for o in lefts), default=0), min((o[1] for o in rights), default=0), max((o[3] for o in rights), default=0), gap, min(under) - y1 if under else None, x1 if ends else None)
    return out


@pytest.mark.parametrize("pairs", [50, 1 << 20])
def test_sweep(monkeypatch, pairs):
    monkeypatch.setattr(sweep, "PAIRS", pairs)
    r = np.random.default_rng(12)
    tokens = []
    for page, n in enumerate((1, 2, 30, 1, 120, 7)):
        for _ in range(n):
            x, y, w, h = int(r.integers(-5, 300)), int(r.integers(-5, 60) // 3 * 3), int(r.integers(1, 60)), int(r.choice([2, 8, 10, 10, 30]))
            tokens.append((page, x, y, x + w, y + h, h))
    got = sweep.near(*(np.array(c) for c in zip(*tokens, strict=True)))
    for i, want in brute_near(tokens).items():
        assert tuple(None if np.ma.is_masked(c[i]) else int(c[i]) for c in got.values()) == want


def test_sweep_of_large_pages_takes_time_in_proportion(spark):
    """Pages of 5,000 and 40,000 tokens, as dense: no pairs beyond neighbouring lines."""
    seen = {}
    for n in (5_000, 40_000):
        k = np.arange(n)
        looked, before = [], sweep.ranges
        sweep.ranges = lambda a, b, f=before, looked=looked: (looked.append(int(b.sum())), f(a, b))[1]
        try:
            sweep.near(np.zeros(n, int), k % 10 * 50, k // 10 * 12, k % 10 * 50 + 40, k // 10 * 12 + 10, np.full(n, 10))
        finally:
            sweep.ranges = before
        seen[n] = sum(looked)
    assert seen[40_000] <= 8.1 * seen[5_000] and seen[40_000] == 40_000 * 10


def test_vectors_are_written_and_binned_once(spark, monkeypatch):
    """Emissions by `fitted` are those of `train` and `predict`, rows without label among them; what is written is the vectors,
    their bins and new scores."""
    seen = []
    monkeypatch.setattr(boosting, "written", lambda df, *a, f=boosting.written: (seen.append(df.columns), f(df, *a))[1])
    monkeypatch.setattr(boosting, "WRITE", 2)
    x, y = sample(300)
    rows = vectors(spark, x, y)
    some = rows.selectExpr("doc_id", "places", "values", "case when doc_id < 250 then label end as label")
    got = {r["doc_id"]: r["p"] for r in boosting.fitted(some, 12, FEW, ("doc_id",)).collect()}
    assert seen == [["doc_id", "places", "values", "label"], ["cells", "label", "scores", "place", "doc_id"], ["cells", "label", "scores", "place"]]
    want = {r["doc_id"]: r["p"] for r in boosting.predict(rows, boosting.train(rows.where("doc_id < 250"), 12, FEW), ("doc_id",)).collect()}
    assert got == want and len(got) == 300


def test_cells_of_places_in_any_order():
    bins = boosting.Bins([np.array([-0.5, 0.5], np.float32), np.zeros(0, np.float32), np.array([1.0], np.float32)])
    offsets, cells = bins.cells(np.array([0, 3, 3, 4]), np.array([2, 0, 1, 0]), np.array([2.0, -1.0, 5.0, 0.2]))
    assert offsets.tolist() == [0, 2, 2, 2] and cells.tolist() == [0, 5] and bins.kind == np.uint16


def test_bins_are_those_of_all_rows(spark):
    """Quantiles of 60,000 different values, and of values some of which are common, as numpy takes them from all."""
    n = 60_000
    rows = spark.range(n).selectExpr("array(0, 2) as places", "array(cast(id + 1 as float), cast(if(id % 3 = 0, -2, id % 7 - 3) as float)) as values").repartition(3)
    bins = boosting.quantile_bins(rows, 4, 31)
    at = np.arange(1, 28) / 28
    assert np.array_equal(bins.edges[0], np.array([boosting.ZERO, *np.quantile(np.arange(1, n + 1), at)], np.float32))
    ids = np.arange(n)
    v = np.where(ids % 3 == 0, -2.0, ids % 7 - 3)
    v = v[v != 0]
    want = {float(x) for x in np.quantile(v, at) if x < v.max()} | {-boosting.ZERO, boosting.ZERO}
    assert np.array_equal(bins.edges[2], np.array(sorted(want), np.float32)) and not len(bins.edges[1]) and not len(bins.edges[3])


def test_sums_of_a_pass_are_those_of_a_walk_over_the_rows():
    """Of nodes of three classes, over batches, with hessians as large as they get; gradients and hessians share no rounding."""
    r = np.random.default_rng(8)
    bins = boosting.Bins([np.sort(r.normal(size=n)).astype(np.float32) for n in (3, 0, 5, 1, 2, 7)])
    tree = boosting.Tree()
    tree.split(0, 2, 2)
    trees, asked, own = {0: tree, 1: boosting.Tree(), 2: tree}, [(0, 1), (0, 2), (1, 0), (2, 2)], {0: np.array([0, 1, 2, 5]), 1: np.array([3]), 2: np.zeros(0, int)}
    sums, want, totals = boosting.Sums(bins, trees, [], asked, own), [np.zeros((3, bins.total)) for _ in asked], np.zeros((4, 3))
    for _ in range(3):
        x = np.where(r.random((boosting.TOGETHER, 6)) < 0.5, 0, r.normal(size=(boosting.TOGETHER, 6))).astype(np.float32)
        label, scores = r.integers(0, 3, len(x)), np.log(np.full((len(x), 3), [0.5, 0.3, 0.2]))
        at = np.concatenate([[0], np.cumsum((x != 0).sum(1))])
        offsets, cells = bins.cells(at, np.nonzero(x)[1], x[x != 0])
        sums.add(offsets, cells.astype(bins.kind), label, scores)
        g, h = boosting.gradients(scores, label)
        row, node = np.repeat(np.arange(len(x)), np.diff(offsets)), tree.node_of(bins.dense(offsets, cells))
        for i, (k, n) in enumerate(asked):
            inside = np.ones(len(x), bool) if k == 1 else node == n
            weights = np.stack([g[:, k], h[:, k], np.ones(len(x))]) * inside
            totals[i] += weights.sum(1)
            for j in range(3):
                np.add.at(want[i][j], cells, weights[j][row])
    assert np.array_equal(sums.totals, totals) and totals[2, 2] == 3 * boosting.TOGETHER
    for i, (k, _) in enumerate(asked):
        assert np.array_equal(sums[i], want[i][:, np.isin(bins.feature, own[k])])


def test_vectors_in_binaries_give_the_model_of_lists(spark):
    x, y = sample(300)
    rows = vectors(spark, x, y)
    packed = rows.toPandas()
    for name, kind in (("places", np.uint16), ("values", np.float32)):
        packed[name] = [np.asarray(v, kind).tobytes() for v in packed[name]]
    packed = spark.createDataFrame(packed, "doc_id long, places binary, values binary, label int").repartition(3)
    lists, binaries = ({r["doc_id"]: r["p"] for r in boosting.fitted(df, 12, FEW, ("doc_id",)).collect()} for df in (rows, packed))
    assert lists == binaries and len(lists) == 300
