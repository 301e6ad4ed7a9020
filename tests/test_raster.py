import numpy as np
import pytest

from pagewright.functions import raster


def brute(mask, kw, kh, all_):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y in range(h):
        for x in range(w):
            win = mask[max(0, y - kh // 2) : y + kh - kh // 2, max(0, x - kw // 2) : x + kw - kw // 2]
            out[y, x] = win.all() if all_ else win.any()
    return out


def test_morphology():
    r = np.random.default_rng(0)
    for kw, kh in ((1, 3), (2, 2), (5, 1), (4, 7)):
        m = r.random((17, 23)) < 0.4
        assert (raster.dilate(m, kw, kh) == brute(m, kw, kh, False)).all()
        assert (raster.erode(m, kw, kh) == brute(m, kw, kh, True)).all()
        twice = brute(brute(m, kw, kh, False), kw, kh, False)
        assert (raster.dilate(m, kw, kh, 2) == twice).all()


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(diagonal):
    r = np.random.default_rng(1)
    for _ in range(30):
        m = r.random((12, 15)) < 0.45
        labels, boxes = raster.components(m, diagonal)
        seen = np.zeros(m.shape, int)
        n = 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            n += 1
            todo = [(y, x)]
            seen[y, x] = n
            while todo:
                a, b = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        c, d = a + dy, b + dx
                        if (diagonal or not dy or not dx) and 0 <= c < 12 and 0 <= d < 15 and m[c, d] and not seen[c, d]:
                            seen[c, d] = n
                            todo.append((c, d))
        assert (labels == seen).all()
        for k, (x, y, w, h, area) in enumerate(boxes, 1):
            ys, xs = np.nonzero(seen == k)
            assert (x, y, w, h, area) == (xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(ys))


def test_unruled_table():
    gray = np.full((120, 200), 255, np.uint8)
    for r in range(3):
        for c in range(4):
            gray[10 + r * 36 : 30 + r * 36, 10 + c * 48 : 40 + c * 48] = 20
    assert len(raster.table_cells(gray, "unbordered")) == 12


def test_ruled_table():
    gray = np.full((200, 300), 255, np.uint8)
    for y in (0, 66, 132, 198):
        gray[y : y + 2] = 0
    for x in (0, 100, 200, 298):
        gray[:, x : x + 2] = 0
    cells = [b for b in raster.table_cells(gray, "bordered") if 50 < b[2] < 270 and b[3] < 180]
    assert len(cells) == 9
    with pytest.raises(ValueError):
        raster.table_cells(gray, "other")
    with pytest.raises(ValueError):
        raster.table_cells(gray[:30], "bordered")


def test_partly_ruled_table():
    gray = np.full((160, 240), 255, np.uint8)
    for r in range(2):
        for c in range(2):
            gray[20 + r * 70 : 50 + r * 70 : 3, 20 + c * 110 : 90 + c * 110 : 2] = 20
    assert len([b for b in raster.table_cells(gray, "partially") if b[2] > 30]) == 4
    light = np.full((160, 240), 255, np.uint8)  # thin text on white has no inner light areas to turn
    light[40, 20:80:9] = light[100, 20:80:9] = 20
    assert raster.table_cells(light, "partially_color_inv") == raster.table_cells(light, "partially_color_inv")


def test_dark_blobs_and_edges():
    gray = np.full((400, 400), 255, np.uint8)
    gray[100:200, 80:280] = np.where((np.arange(100)[:, None] // 8 + np.arange(200)[None] // 8) % 2, 20, 150)
    found = raster.dark_blobs(gray, [], 72)
    assert [(f["left"], f["top"], f["width"], f["height"]) for f in found] == [(80, 100, 200, 100)]
    assert found[0]["fill_density"] == 1.0 and found[0]["h_lines"] == 100
    assert raster.dark_blobs(gray, [(70, 90, 300, 210)], 72) == []
    step = np.zeros((20, 20), np.uint8)
    step[:, 10:] = 200
    e = raster.edges(step)
    assert e.any(axis=1).all() and e.sum() == 20


def test_thresholds():
    g = np.concatenate([np.full(50, 30), np.full(50, 220)]).astype(np.uint8).reshape(10, 10)
    assert 30 <= raster.threshold_otsu(g) < 220
    assert not raster.threshold_mean(np.full((9, 9), 80, np.uint8), 5, 3).any()
    assert raster.threshold_gaussian(np.full((9, 9), 80, np.uint8), 5, 3).all()


def test_pages_are_drawn_one_at_a_time():
    import pandas as pd

    from pagewright.operators import images

    batch = pd.DataFrame({"doc_id": range(5), "page_number": 1, "page_width": 60, "page_height": 40, "regions": None, "boxes": None})
    assert [len(x) for x in images.drawn(iter([batch]))] == [1] * 5


def test_pages_are_drawn_and_looked_at_in_one_stage(spark):
    from pagewright.plans import queries

    text = "\n".join(f"Line {i}. more" for i in range(30))
    page = spark.createDataFrame([(1, 1, 612, 792)], "doc_id long, page_number int, page_width int, page_height int")
    reg = spark.createDataFrame([(1, 1, 0, 100, 100, 300, 220)], "doc_id long, page_number int, region_seq int, `left` int, top int, `right` int, bottom int")
    tok = spark.createDataFrame([(1, 1, 1, text, 0, 0, 9, 9)], "doc_id long, page_number int, pos int, content string, `left` int, top int, `right` int, bottom int")
    made = queries.OPERATORS["dark_blob_regions"](page=page, reg=reg, tok=tok)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1  # pixels stay where they are drawn
    assert [(r["left"], r["top"], r["width"], r["height"]) for r in made.collect()] == [(100, 100, 200, 120)]


def test_components_of_noise_take_no_step_a_run(monkeypatch):
    """Each round joins all roots that have a neighbour; a walk over runs would take as many steps as there are."""
    rounds, before = [], np.minimum
    mask = np.random.default_rng(2).random((600, 600)) < 0.4

    class Counted:
        def __call__(self, *a):
            rounds.append(len(a[0]))
            return before(*a)

        def __getattr__(self, name):
            return getattr(before, name)

    monkeypatch.setattr(np, "minimum", Counted())
    labels, boxes = raster.components(mask)
    assert 0 < len(rounds) < 30 and labels.max() == len(boxes) and sum(b[4] for b in boxes) == mask.sum()
