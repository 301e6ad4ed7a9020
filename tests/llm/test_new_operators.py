"""Fill-in-the-middle, toxicity and valid-time enrichment against brute-force versions."""

import hashlib
import zlib
from bisect import bisect_right
from datetime import datetime, timedelta
from glob import glob

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import fim, sale_enrichment, toxicity


def cut_by_hand(doc_id, text, unit="char"):
    """(n, form, prefix, middle, output) from the text's characters."""
    if unit == "char":
        units = list(text)
    else:
        units, blank = [], (" \t\n\r\x0b\x0c" if unit == "word" else "\n\r")
        for i, c in enumerate(text):
            if i and text[i - 1] in blank and c not in blank:
                units.append(c)
            else:
                units[-1:] = ["".join([*units[-1:], c])]
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


MARKED = ["a<P>b", "<", "<P", "P>", "x <S> y", "<M>", "<Q>", "P><", "日本語<P>", "ends with <", ">", "<Pé>"]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle(spark, docs, corpus, unit):
    more = [(2000 + i, t) for i, t in enumerate(MARKED * 3)] + [(3000 + i, "𝄞é\n" * i + " \t x") for i in range(30)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).coalesce(2)
    out = fim.fill_in_middle(frame, unit)
    got = {r["doc_id"]: r for r in out.withColumn("back", fim.restored()).collect()}
    rows = [(i, t) for i, t, *_ in corpus] + more
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut_by_hand(i, t or "", unit)
        assert r["back"] == (t or "")
    assert {r["form"] for r in got.values()} == set(fim.FORMS)


def test_fill_in_middle_of_odd_rows(docs, odd, empty):
    assert fim.fill_in_middle(empty).count() == 0
    rows = fim.fill_in_middle(odd).collect()
    assert len(rows) == 6
    for r in rows:
        if r["doc_id"] is None and r["n"]:
            assert r["output"] == cut_by_hand(None, {len(r["output"]): r["output"]}[len(r["output"])])[4] or r["form"] != "plain"
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs, "sentence")


def test_marks_do_not_cross_rows_and_slices_are_whole():
    texts = pa.array(["ab<", "P>cd", "", "<P>", "é<M>"])
    raw, at = fim.buffers(texts)
    cut = fim.cut_all(raw, at, np.zeros((4, 5), np.int64), "char")
    assert cut["form"].tolist() == [2, 2, 0, 0, 0] and cut["n"].tolist() == [3, 4, 0, 3, 4]
    assert [n for _, n in fim.slices(pa.array(["x" * 10] * 7), 25)] == [2, 2, 2, 1]
    assert [n for _, n in fim.slices(pa.array(["", "x" * 99, "", "y"]), 25)] == [1, 1, 2]
    raw, at = fim.buffers(texts.slice(1, 3))
    assert bytes(raw) == b"P>cd<P>" and at.tolist() == [0, 4, 4, 7]


def labelled(n, seed=5):
    r = np.random.default_rng(seed)
    syllables = "ba co du fe gi lo mu na pe ri so tu va zo".split()
    bad = ["grubnak", "vilethorn", "snorgle"]
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(r.choice(syllables, r.integers(1, 4))) for _ in range(r.integers(20, 90))]
        labels.append(int(r.random() < 0.3))
        for _ in range(2 * labels[-1]):
            words.insert(r.integers(len(words)), str(r.choice(bad)))
        texts.append(" ".join(words))
    return texts, labels


def test_toxicity_on_held_out_rows(spark):
    texts, labels = labelled(700)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    frame = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i < 500] + [(3, 0), (None, 1), (650, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, frame)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    held = range(500, 700)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) >= 0.98
    assert all(0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5) for i in got)


def test_toxicity_ratios_and_scores_by_hand(spark):
    """Ratios, and the minimum of the penalised loss, from plain sets of n-grams."""
    texts, labels = labelled(60, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"), features=1 << 20)
    last = np.zeros(1 << toxicity.BITS, np.int64)
    grams = [{t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)} for t in texts]
    hashes = [set(toxicity.distinct(t, last).tolist()) for t in texts]
    assert all(0.99 * len(g) <= len(h) <= len(g) for g, h in zip(grams, hashes, strict=True))
    y = np.array(labels)
    place = {int(h): k for k, h in enumerate(model.hashes)}
    x = np.zeros((len(texts), len(place)))
    for i, h in enumerate(hashes):
        x[i, [place[k] for k in h if k in place]] = 1
    assert set(place) == {k for h in hashes for k in h if sum(k in g for g in hashes) >= toxicity.LEAST}
    ratios = np.log((x[y == 1].sum(0) + 1) / (y.sum() + 2)) - np.log((x[y == 0].sum(0) + 1) / ((1 - y).sum() + 2))
    assert np.allclose(ratios, model.ratios)
    z = x @ (ratios * model.w) + model.b
    p = 1 / (1 + np.exp(-z))
    assert np.abs((x * ratios).T @ (p - y) + model.w).max() < 1e-2 * np.abs((x * ratios).T @ (0.5 - y)).max()  # the gradient at the minimum
    assert np.allclose(model.score(texts, model.slots()), p, atol=1e-6)
    whole = " ".join(texts) * 60  # longer than a piece
    assert np.isclose(model.score([whole], model.slots())[0], 1 / (1 + np.exp(-(((x.sum(0) > 0) * ratios) @ model.w + model.b))), atol=0.2)


def test_toxicity_pieces_hold_all_n_grams(monkeypatch):
    text, last = "".join(chr(97 + i * i % 23) for i in range(400)), np.zeros(1 << toxicity.BITS, np.int64)
    want = set(toxicity.distinct(text, last).tolist())
    monkeypatch.setattr(toxicity, "CHARS", 17)
    found = {int(h) for group in toxicity.pieces([text], 17) for _, x in toxicity.hashed(*group) for h in x}
    assert found == want


def test_toxicity_of_odd_rows(spark, docs, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert {r["score"] for r in toxicity.toxicity_scores(docs, model).collect()} == {0.5}
    one = toxicity.fit(docs, docs.selectExpr("doc_id", "1 as toxic"))
    rows = toxicity.toxicity_scores(odd, one).collect()
    assert len(rows) == 6 and all(r["predicted"] == 1 for r in rows)
    assert toxicity.toxicity_scores(empty, one).count() == 0
    same = toxicity.toxicity_scores(odd, one, ("doc_id", "text")).collect()
    assert len({(r["text"], r["score"]) for r in same}) == len({r["text"] for r in same})


def enriched_by_hand(sales, changes, batches=12):
    """The batches one after another, with plain lists."""
    day = lambda t: (t - datetime(1970, 1, 1)).days
    number = lambda d: max(0, min(batches - 1, (d - 19723) * 12 // 152))
    sales = [(s, c, t, batches - 1 if a is None else number(day(a))) for s, c, t, a in sales]
    changes = [(i, c, op, t, b, batches - 1 if i is None else number(day(t) + zlib.crc32(str(i).encode()) % 4)) for i, c, op, t, b in dict.fromkeys(changes) if t is not None]
    low = datetime.min
    held, waiting, out = {}, [], []
    sold = valid = low
    for b in range(batches + 1):
        h = min(sold, valid)
        for i, c, op, t, balance, at in changes:
            if at == b and t < valid:
                out.append(("late", i, b, None, None, None, None))
            elif at == b:
                held.setdefault(c, []).append((t, i, None if balance is None else int(np.floor(100 * balance + 0.5)), op))
        for v in held.values():
            v.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] is not None, x[2] or 0))
        waiting += [s for s in sales if s[3] == b]
        now, waiting = [s for s in waiting if s[2] is None or s[2] < h or b == batches], [s for s in waiting if not (s[2] is None or s[2] < h or b == batches)]
        for s, c, t, _ in now:
            v = held.get(c, []) if c is not None else []
            j = bisect_right([x[0] for x in v], t) - 1 if t is not None else -1
            out.append(("sale", s, b, len(v), *((v[j][1], v[j][2], v[j][3]) if j >= 0 else (None, None, None))))
        for c, v in held.items():
            under = [x for x in v if x[0] <= h]
            held[c] = under[-1:] + [x for x in v if x[0] > h]
        sold = max([sold, *(t for _, _, t, a in sales if a == b and t is not None)])
        valid = max([valid, *(t for _, _, _, t, _, a in changes if a == b)])
    return out


SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, batch int"
CHANGES = "change_id long, client_id long, op string, valid_at timestamp_ntz, balance double, slice string"


def shop(seed, n, clients, hours):
    """Rows with a client that holds a third, equal times, nulls, late and repeated rows."""
    r = np.random.default_rng(seed)
    start = datetime(2024, 1, 1)
    time = lambda: start + timedelta(hours=int(r.integers(hours)))
    client = lambda: None if r.random() < 0.02 else 1 if r.random() < 0.33 else int(r.integers(2, clients))
    sales, changes = [], []
    for i in range(n):
        t = time()
        sales.append((i if r.random() > 0.02 else 7, client(), None if r.random() < 0.03 else t, None if r.random() < 0.02 else t + timedelta(days=int(r.integers(0, 3)) if r.random() < 0.9 else 30)))
        t = None if r.random() < 0.02 else time()
        changes.append((int(r.integers(2**40)) if r.random() > 0.02 else 11, client(), str(r.choice(["U", "I", "D"])) if r.random() > 0.02 else None, t, None if r.random() < 0.05 else float(r.integers(-1000, 10000)) / 8))
    return sales, changes + changes[:5]


@pytest.mark.parametrize("least", [5, 4096])
def test_enrichment(spark, least):
    """Slices of five rows part every client; of 4096, none."""
    sales, changes = shop(4, 150, 9, 24 * 150)
    frames = [spark.createDataFrame([(*x, 0) for x in sales], SALES).repartition(3), spark.createDataFrame([(*x, "clash") for x in changes], CHANGES).repartition(2)]
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        got = sale_enrichment.enrich_sales(*frames, least_slice=least)
        assert sorted(map(repr, (tuple(r[c] for c in "rec id batch n_held change_id balance_cents op".split()) for r in got.collect()))) == sorted(map(repr, enriched_by_hand(sales, changes)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_enrichment_of_empty_tables(spark):
    no_sales, no_changes = spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES)
    assert sale_enrichment.enrich_sales(no_sales, no_changes).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        alone = spark.createDataFrame([(5, 1, datetime(2024, 2, 1), datetime(2024, 2, 2), 0)], SALES)
        assert [tuple(r) for r in sale_enrichment.enrich_sales(alone, no_changes, batches=3).collect()] == [("sale", 5, 3, 0, None, None, None)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_state_of_sales_is_written_by_plain_renames_and_once(spark):
    """Each version of the state is one file, without a file of sums beside it, which cost more than the rows where a start has many partitions."""
    at = sale_enrichment.shared_dir(spark).removeprefix("file:")
    before = {k: spark.conf.get(k, None) for k in sale_enrichment.STATE}
    old = set(glob(f"{at}/sale-stream-*"))
    sales, changes = shop(5, 20, 3, 24 * 20)
    frames = spark.createDataFrame([(*x, 0) for x in sales], SALES), spark.createDataFrame([(*x, "clash") for x in changes], CHANGES)
    assert sale_enrichment.enrich_sales(*frames, batches=3).where("rec = 'sale'").count() == len(sales)
    (home,) = set(glob(f"{at}/sale-stream-*")) - old
    assert glob(f"{home}/checkpoint/state/0/*/*.changelog") and not glob(f"{home}/checkpoint/**/*.crc", recursive=True)
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_sales_start_once_a_batch(spark):
    """What is emitted after the last batch comes from that batch's start: Spark leaves memory behind for each partition of each start."""
    at = sale_enrichment.shared_dir(spark).removeprefix("file:")
    old = set(glob(f"{at}/sale-stream-*"))
    sales, changes = shop(6, 60, 5, 24 * 150)
    frames = spark.createDataFrame([(*x, 0) for x in sales], SALES), spark.createDataFrame([(*x, "clash") for x in changes], CHANGES)
    for batches in (1, 3):
        got = sale_enrichment.enrich_sales(*frames, batches=batches, least_slice=7).collect()
        assert {r["batch"] for r in got if r["rec"] == "sale"} >= {batches}
        (home,) = set(glob(f"{at}/sale-stream-*")) - old
        old.add(home)
        assert len(glob(f"{home}/checkpoint/commits/[0-9]*")) == batches
