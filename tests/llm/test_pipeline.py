"""The pipeline over a small corpus, against the same decisions made by brute force."""

import random

from tests.llm.conftest import sentence
from tests.llm.test_operators import brute_components, brute_fingerprint, lowered

import corpus_pipeline
from pagewright.llm import common


def test_stages(spark, tmp_path):
    r = random.Random(5)
    items = [(k, sentence(r, 30)) for k in range(6)]
    texts = [sentence(r, 80) for _ in range(30)]
    texts += [texts[0], texts[1].upper(), None, "123 456", "", texts[2] + " end"]
    texts += [sentence(r, 20) + " " + items[k][1] + " " + sentence(r, 20) for k in range(3)]
    foreign = "".join(chr(0x0430 + r.randrange(32)) if r.random() < 0.8 else " " for _ in range(600))
    texts += [foreign, foreign[:100]]  # a language that no profile knows, and too little of it to tell
    greek = str.maketrans({chr(97 + k): chr(0x03B1 + k) for k in range(24)})
    texts += [sentence(r, 80).translate(greek) for _ in range(12)]
    lang = lambda t: "el" if t and "α" in t else "en" if t and t[0] <= "z" else None
    rows = [(i, t, lang(t), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    kept = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t) and t != foreign}
    last = {lowered(t): i for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if last[lowered(t)] == i}
    component = brute_components({i: brute_fingerprint(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if component[i] == i}
    kept = {i: t for i, t in kept.items() if not any(x in t for _, x in items)}
    before = common.stashes()
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, at).collect()}
    assert common.stashes() == before + 1  # of all that was written only the result is left
    assert set(got) == set(kept)
    tokens = {}
    for i, t in kept.items():
        tokens[f"s{i % 3}"] = tokens.get(f"s{i % 3}", 0) + len(t.split())
    total = sum(tokens.values())  # no source is four times as large as another, so the exponent is 0: equal weights
    assert max(tokens.values()) / min(tokens.values()) <= 4
    budget = 3 * max(tokens.values())
    for s, n in tokens.items():
        own = [got[i] for i in kept if f"s{i % 3}" == s]
        assert all(abs(x["weight"] - 1 / 3) < 1e-9 and x["n_tokens"] == len(kept[x["doc_id"]].split()) for x in own)
        used = sum(x["copies"] * x["n_tokens"] for x in own)
        assert budget / 3 - max(x["n_tokens"] for x in own) <= used <= budget / 3 and {x["copies"] for x in own} <= {budget // 3 // n, budget // 3 // n + 1}
    assert total == sum(x["n_tokens"] for x in got.values())


def test_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([(0, "nothing of the kind in here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
