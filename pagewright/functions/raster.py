"""Raster operators of a page or a table crop, on boolean and uint8 numpy arrays.

These are what Catalyst can't see: they run inside one mapInPandas stage a page, and only boxes and statistics leave it.
Windows lie as a rectangle of k has its anchor at k // 2; what is outside the image doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Limits at 150 dpi of regions and lines, and gray values of dark content.
MIN_AREA, MIN_WIDTH, MIN_HEIGHT, BORDER, MASK_GROWTH, CLOSING, LINE_KERNEL, GRID_AREA = 2000, 60, 40, 50, 3, 3, 60, 5000
DARK, LEAST_FILL, LEAST_EDGE, PAGE_FRACTION, LINE_SHARE, ASPECTS = 180, 0.15, 0.02, 0.70, 0.35, (0.05, 20.0)
TABLE_TYPES = ("partially", "bordered", "unbordered", "partially_color_inv")


def scaled(value: int, dpi: int) -> int:
    return max(1, int(value * dpi / 150))


def _windows(mask: np.ndarray, before: int, after: int, axis: int, join: np.ufunc) -> np.ndarray:
    """Cells joined (np.logical_or or np.logical_and) over [i - before, i + after] along an axis; windows double until they are
    as wide."""
    if not before and not after:
        return mask
    m = mask if axis == 0 else mask.T
    n = len(m)
    before, after = min(before, n), min(after, n)
    joined = np.full((n + before + after, m.shape[1]), join is np.logical_and) if axis == 0 else np.full((m.shape[1], n + before + after), join is np.logical_and).T
    joined[before : before + n] = m
    wide, size = before + after + 1, 1
    while 2 * size <= wide:
        joined = join(joined[:-size], joined[size:])
        size *= 2
    joined = join(joined[:n], joined[wide - size : wide - size + n])
    return joined if axis == 0 else joined.T


def _reach(k: int, times: int) -> tuple[int, int]:
    return times * (k // 2), times * (k - 1 - k // 2)


def dilate(mask: np.ndarray, kw: int, kh: int, times: int = 1) -> np.ndarray:
    for k, axis in ((kh, 0), (kw, 1)):
        mask = _windows(mask, *_reach(k, times), axis, np.logical_or)
    return mask


def erode(mask: np.ndarray, kw: int, kh: int, times: int = 1) -> np.ndarray:
    for k, axis in ((kh, 0), (kw, 1)):
        mask = _windows(mask, *_reach(k, times), axis, np.logical_and)
    return mask


def threshold_mean(gray: np.ndarray, block: int, c: int) -> np.ndarray:
    """Cells at most the mean of their block less c; edges repeat."""
    r = block // 2
    padded = np.pad(gray.astype(np.int64), r, mode="edge")
    t = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = gray.shape
    mean = np.round((t[block : block + h, block : block + w] - t[:h, block : block + w] - t[block : block + h, :w] + t[:h, :w]) / block**2)
    return gray <= mean - c


def threshold_gaussian(gray: np.ndarray, block: int, c: int) -> np.ndarray:
    """Cells over the Gaussian mean of their block less c."""
    sigma, r = 0.3 * ((block - 1) * 0.5 - 1) + 0.8, block // 2
    k = np.exp(-((np.arange(block) - r) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(gray.astype(float), r, mode="edge")
    rows = sum(k[i] * p[i : i + len(gray)] for i in range(block))
    mean = np.round(sum(k[i] * rows[:, i : i + gray.shape[1]] for i in range(block)))
    return gray > mean - c


def threshold_otsu(gray: np.ndarray) -> int:
    """The value that parts the histogram with the largest variance between the parts."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    low, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * low - mass * n.sum()) ** 2 / (low * (n.sum() - low))
    return int(np.argmax(np.nan_to_num(between, posinf=0)))


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least one that it is connected to by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(a, b)
        np.minimum.at(root, np.maximum(a, b), least)  # a and b are roots: the larger joins its least neighbour
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        some = a != b
        a, b = a[some], b[some]
    return root


def _runs(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column behind the last, component) of the runs of cells, in reading order; components are numbered
    by their first run."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), bool)
    wide[:, 1:-1] = mask
    turns = np.flatnonzero(wide[:, 1:] != wide[:, :-1])  # a row's runs begin and end by turns
    y, x0, x1 = turns[::2] // (w + 1), turns[::2] % (w + 1), turns[1::2] % (w + 1)
    reach, span = int(diagonal), w + 3
    above = (y - 1) * span
    lo = np.searchsorted(y * span + x1, above + x0 - reach, "right")
    size = np.maximum(np.searchsorted(y * span + x0, above + x1 + reach, "left") - lo, 0)
    ends = np.cumsum(size)
    upper = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - size), size)
    root = _connected(len(y), upper, np.repeat(np.arange(len(y)), size))
    return y, x0, x1, np.unique(root, return_inverse=True)[1]


def _boxes(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of each component of runs."""
    order = np.argsort(number, kind="stable")
    first = np.flatnonzero(np.diff(number[order], prepend=-1))
    if not len(first):
        return []
    left, right = np.minimum.reduceat(x0[order], first), np.maximum.reduceat(x1[order], first)
    top, bottom = y[order][first], np.maximum.reduceat(y[order], first) + 1
    area = np.add.reduceat((x1 - x0)[order], first)
    return list(zip(*(c.tolist() for c in (left, top, right - left, bottom - top, area)), strict=True))


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """Labels (0: background) and (x, y, w, h, area) of each connected component, by first cell in reading order."""
    y, x0, x1, number = _runs(mask, diagonal)
    labels = np.zeros(mask.shape, np.int32)
    labels[mask] = np.repeat(number + 1, x1 - x0)
    return labels, _boxes(y, x0, x1, number)


def contour_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of the outer contours and, one cell wider, of the holes, from top to bottom, then left to right."""
    out = [b[:4] for b in _boxes(*_runs(mask, True))]
    h, w = mask.shape
    for x, y, bw, bh, _ in _boxes(*_runs(~np.pad(mask, 1), False)):
        if x > 0 and y > 0 and x + bw < w + 2 and y + bh < h + 2:
            out.append((x - 2, y - 2, bw + 2, bh + 2))
    return sorted(out, key=lambda b: (b[1], b[0]))


def edges(gray: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Canny edges: thin ridges of the gradient over `low` that connect to one over `high`."""
    p = np.pad(gray.astype(np.int16), 1, mode="edge")  # sums of the gradient are 2040 at most
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    ax, ay = np.abs(gx), np.abs(gy)
    size = np.pad(ax + ay, 1)
    at = lambda dy, dx: size[1 + dy : 1 + dy + gray.shape[0], 1 + dx : 1 + dx + gray.shape[1]]
    m = at(0, 0)
    flat, steep = ay < np.tan(np.pi / 8) * ax, ay > np.tan(3 * np.pi / 8) * ax
    same = (gx < 0) == (gy < 0)
    ridge = np.where(flat, (m > at(0, -1)) & (m >= at(0, 1)), np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(same, (m > at(-1, -1)) & (m > at(1, 1)), (m > at(-1, 1)) & (m > at(1, -1)))))
    weak = ridge & (m > low)
    _, x0, x1, number = _runs(weak, True)
    strong = np.zeros(len(number) + 1, bool)  # of each component
    of_cell = np.repeat(number, x1 - x0)
    strong[of_cell[(ridge & (m > high))[weak]]] = True
    out = np.zeros(gray.shape, bool)
    out[weak] = strong[of_cell]
    return out


def grid_lines(mask: np.ndarray, kernel: int) -> tuple[int, int]:
    """Rows and columns that hold a line over enough of the region."""
    h, w = mask.shape
    count = lambda opened, axis, extent: int((opened.sum(axis) >= int(extent * LINE_SHARE)).sum()) if int(extent * LINE_SHARE) >= 1 else 0
    return count(dilate(erode(mask, kernel, 1), kernel, 1), 1, w), count(dilate(erode(mask, 1, kernel), 1, kernel), 0, h)


#: Reach, at 150 dpi, over which strokes of text grow together.
TEXT_CLOSING = (50, 10)


def text_mask(ink: np.ndarray, dpi: int) -> np.ndarray:
    """Ink closed into blocks of text; what lies outside of them is no text. For pages whose text is thin."""
    kw, kh = (scaled(v, dpi) for v in TEXT_CLOSING)
    return erode(dilate(ink, kw, kh), kw, kh)


def token_mask(boxes: list[tuple[int, int, int, int]], shape: tuple[int, int], dpi: int) -> np.ndarray:
    """Cells under tokens (left, top, right, bottom in points), grown a little."""
    out, s = np.zeros(shape, bool), dpi / 72
    for left, top, right, bottom in boxes:
        out[max(0, int(top * s)) : max(0, int(bottom * s)), max(0, int(left * s)) : max(0, int(right * s))] = True
    k = scaled(MASK_GROWTH, dpi)
    return dilate(out, k, k) if boxes else out


def dark_blobs(gray: np.ndarray, boxes: list[tuple[int, int, int, int]], dpi: int, fill_denominator: str = "component") -> list[dict]:
    """Dark regions outside the text, with their statistics. fill_denominator: 'component' divides by the component's cells, so
    that fill is seldom under one; 'bbox' by the box's."""
    dark, edge = gray <= DARK, scaled(BORDER, dpi)
    dark[:edge], dark[-edge:], dark[:, :edge], dark[:, -edge:] = False, False, False, False
    dark &= ~token_mask(boxes, gray.shape, dpi)
    k = scaled(CLOSING, dpi)
    dark = erode(dilate(dark, k, k), k, k)
    out, s = [], dpi / 72
    for x, y, w, h, area in _boxes(*_runs(dark, True)):
        if area < scaled(MIN_AREA, dpi) or w < scaled(MIN_WIDTH, dpi) or h < scaled(MIN_HEIGHT, dpi) or not ASPECTS[0] <= w / h <= ASPECTS[1]:
            continue
        roi = gray[y : y + h, x : x + w]
        fill = float((roi < DARK).sum()) / max(area if fill_denominator == "component" else w * h, 1)
        edge_density = float(edges(roi).mean())
        if fill < LEAST_FILL or edge_density < LEAST_EDGE or area / gray.size >= PAGE_FRACTION:
            continue
        lines = grid_lines(dark[y : y + h, x : x + w], scaled(LINE_KERNEL, dpi)) if area >= scaled(GRID_AREA, dpi) else (0, 0)
        out.append({"left": int(x / s), "top": int(y / s), "width": int(w / s), "height": int(h / s), "area": area, "aspect_ratio": w / h, "fill_density": fill, "edge_density": edge_density, "color_variance": float(roi.var()), "h_lines": lines[0], "v_lines": lines[1]})
    return out


def _lines(ink: np.ndarray, wide: int, high: int, grow: int) -> tuple[np.ndarray, np.ndarray]:
    return dilate(erode(ink, 1, high, 3), 1, high, 4), dilate(erode(ink, wide, 1, 3), wide, 1, grow)


def table_cells(gray: np.ndarray, table_type: str = "partially") -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of a table's cells, from top to bottom. Ruled tables are parted by their lines, others by the white
    rivers between columns and rows; 'partially' joins both, and 'partially_color_inv' first turns dark cells light."""
    if table_type not in TABLE_TYPES:
        raise ValueError(f"unknown table type {table_type!r}; one of {', '.join(TABLE_TYPES)}")
    h, w = gray.shape
    if table_type == "bordered":
        if h < 50 or w < 50:
            raise ValueError("a ruled table needs 50 pixels each way")
        v, hz = _lines(~threshold_gaussian(gray, 5, 5), w // 50, h // 50, 4)
        return contour_boxes(erode(~(v | hz), 2, 2, 2))
    light = gray > (threshold_otsu(gray) if table_type == "unbordered" else 180)
    rivers = {"unbordered": (9, 9), "partially": (8, 3), "partially_color_inv": (9, 1)}[table_type]
    if table_type == "partially_color_inv":
        inner = [b for b in contour_boxes(light) if max(10, w / 30) < b[2] < 0.9 * w and max(10, h / 30) < b[3] < 0.9 * h]
        for x, y, bw, bh in inner:
            light[max(0, y) : y + bh, max(0, x) : x + bw] ^= True
        light = ~light if inner else light
    if table_type != "unbordered":
        inverse = table_type == "partially_color_inv"
        v, hz = _lines(~light, max(10, w // 50), max(10, h // 50), 5 if inverse else 4)
        light = light | dilate(v | hz, 2, 2, 3 if inverse else 5)
    down, across = erode(light, rivers[0], 2 * h), erode(light, 2 * w, rivers[1])
    return contour_boxes(erode(~(down | across), 2, 2, 2))


BOXES = "doc_id long, page_number int, region_seq int, seq int, x int, y int, w int, h int, img_w int, img_h int, error string"


def table_boxes(crops: DataFrame, table_type: str = "partially") -> DataFrame:
    """crops (doc_id, page_number, region_seq, img_w, img_h, gray binary) -> BOXES for the relational grid operators. A crop that
    fails gives one row with its error instead of being lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                key = (r.doc_id, r.page_number, r.region_seq)
                try:
                    found = table_cells(np.frombuffer(r.gray, np.uint8).reshape(r.img_h, r.img_w), table_type)
                    rows += [(*key, i, *b, r.img_w, r.img_h, None) for i, b in enumerate(found)]
                except ValueError as e:
                    rows.append((*key, None, None, None, None, None, r.img_w, r.img_h, str(e)))
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in BOXES.split(", ")])
            yield out.astype({c: "Int32" for c in ("seq", "x", "y", "w", "h")})

    return crops.mapInPandas(run, BOXES)


REGIONS = "doc_id long, page_number int, region_seq int, `left` int, top int, width int, height int, area int, aspect_ratio double, fill_density double, edge_density double, color_variance double, h_lines int, v_lines int"


#: Rows of a batch that is given out.
ROWS = 4096


def regions_of(batches: Iterator[pd.DataFrame], dpi: int = 100, fill_denominator: str = "component") -> Iterator[pd.DataFrame]:
    """REGIONS of batches of pages with their pixels."""
    names = [c.split(" ")[0].strip("`") for c in REGIONS.split(", ")]
    rows: list[tuple] = []
    for batch in batches:
        for r in batch.itertuples(index=False):
            gray = np.frombuffer(r.gray, np.uint8).reshape(r.img_h, r.img_w)
            boxes = [(b["left"], b["top"], b["right"], b["bottom"]) for b in (r.boxes if r.boxes is not None else ())]
            rows += [(r.doc_id, r.page_number, i, *x.values()) for i, x in enumerate(dark_blobs(gray, boxes, dpi, fill_denominator))]
            if len(rows) >= ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def detect_regions(pages: DataFrame, dpi: int = 100, fill_denominator: str = "component") -> DataFrame:
    """pages (doc_id, page_number, img_w, img_h, gray binary, boxes array<struct<left, top, right, bottom>>) -> REGIONS."""
    return pages.mapInPandas(lambda batches: regions_of(batches, dpi, fill_denominator), REGIONS)
