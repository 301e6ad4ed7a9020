"""Models go to a worker once, and a saved model is the one that was trained."""

import os

import numpy as np
import pytest

from pagewright.operators import boosting, model, shipped

from .test_model import sample, vectors


def one_hot(data: bytes):
    """A scorer by the file's two lines: a folder in which each making leaves a file, and the class that is likeliest."""
    import uuid

    folder, k = data.decode().split("\n")
    open(os.path.join(folder, f"{os.getpid()}-{k}-{uuid.uuid4().hex}"), "w").close()
    return lambda x: np.tile(np.eye(11)[int(k)], (len(x), 1))


def test_two_queries_make_a_model_once_a_worker(spark, tmp_path):
    (tmp_path / "made").mkdir()
    at = tmp_path / "scorer"
    x = spark.createDataFrame([(i, 1, 1, [float(i)]) for i in range(64)], "doc_id long, page_number int, pos int, features array<float>").repartition(16)

    def best():
        return {int(np.argmax(r["p"])) for r in model.score_file(x, str(at), one_hot).collect()}

    at.write_text(f"{tmp_path}/made\n3")
    assert best() == best() == {3}  # 32 tasks
    made = [f.split("-")[0] for f in os.listdir(tmp_path / "made")]
    assert made and len(made) == len(set(made))
    at.write_text(f"{tmp_path}/made\n5")  # another version
    assert best() == {5}
    made = [tuple(f.split("-")[:2]) for f in os.listdir(tmp_path / "made")]
    assert len(made) == len(set(made)) and {k for _, k in made} == {"3", "5"}
    with pytest.raises(ValueError):
        shipped.read_bytes(spark, str(tmp_path / "made"))


def test_versions_used_last_are_kept():
    kept, made = type(shipped._made)(), []
    for k in [1, 2, 3, 4, 1, 5, 1, 2]:
        assert shipped._latest(kept, k, lambda k=k: made.append(k) or k) == k
    assert made == [1, 2, 3, 4, 5, 2] and list(kept) == [4, 5, 1, 2]


def test_boosted_models_are_saved(spark, tmp_path):
    x, y = sample(200, 6)
    trained = boosting.train(vectors(spark, x, y), 6, boosting.Settings(rounds=2, leaves=5, least_rows=5, classes=3))
    model.save_boosted(trained, spark.createDataFrame([(0, 0, 1.0)], "prev int, curr int, p double"), str(tmp_path))
    again, trans = model.load_boosted(spark, str(tmp_path))
    assert again.settings == trained.settings and trans.count() == 1 and again.to_bytes() == trained.to_bytes()
    rows = vectors(spark, x, y)
    p = {m: dict(boosting.predict(rows, m, ("doc_id",)).collect()) for m in (trained, again)}
    assert len(p[again]) == 200 and p[again] == p[trained]
    assert len({tuple(v) for v in p[again].values()}) > 3


def test_models_without_trees_or_features():
    for edges in ([], [np.zeros(0, np.float32), np.array([0.5], np.float32)]):
        m = boosting.Model(boosting.Bins(edges), np.zeros(3), boosting.Settings(classes=3))
        again = boosting.Model.of_bytes(m.to_bytes())
        assert again.rounds == [] and [e.tolist() for e in again.bins.edges] == [list(e) for e in edges]
