"""Raster stages as queries: pages and tables are drawn from the fixture relations, then read back from their pixels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from ..plans.dual import frame_operator


def _drawn_tables(cell: DataFrame) -> DataFrame:
    cells = cell.groupBy("doc_id", "page_number", "region_seq").agg(F.max(F.col("x") + F.col("w")).cast("int").alias("img_w"), F.max(F.col("y") + F.col("h")).cast("int").alias("img_h"), F.collect_list(F.struct("x", "y", "w", "h")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "page_number", "region_seq", "img_w", "img_h", "gray"]
        for batch in batches:
            for r in batch.itertuples(index=False):
                gray = np.full((r.img_h + 14, r.img_w + 14), 255, np.uint8)
                for c in r.cells:
                    x, y, w, h = (int(c[k]) for k in "xywh")
                    gray[y + 14 : y + h, x + 14 : x + w] = 40  # ink within, white between
                yield pd.DataFrame([(r.doc_id, r.page_number, r.region_seq, r.img_w + 14, r.img_h + 14, gray.tobytes())], columns=names)

    return cells.mapInPandas(run, "doc_id long, page_number int, region_seq int, img_w int, img_h int, gray binary")


@frame_operator("cell")
def tsr_boxes(cell: DataFrame) -> DataFrame:
    """Cells found in the pixels of drawn tables."""
    return raster.table_boxes(_drawn_tables(cell), "unbordered")


@lru_cache(4)
def _texture(height: int, width: int) -> np.ndarray:
    return ((np.arange(height)[:, None] // 8 + np.arange(width)[None] // 8) % 2 * 120 + 30).astype(np.uint8)


def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages with their pixels, one at a time: a batch of them can have any number of pages."""
    names = ["doc_id", "page_number", "img_w", "img_h", "gray", "boxes"]
    for batch in batches:
        for r in batch.itertuples(index=False):
            texture = _texture(r.page_height, r.page_width)
            gray = np.full((r.page_height, r.page_width), 255, np.uint8)
            for b in r.regions if r.regions is not None else ():
                at = np.s_[b["top"] : b["bottom"], b["left"] : b["right"]]
                gray[at] = texture[at]
            yield pd.DataFrame([(r.doc_id, r.page_number, r.page_width, r.page_height, gray.tobytes(), r.boxes)], columns=names)


def _pages(page: DataFrame, reg: DataFrame, tok: DataFrame) -> DataFrame:
    """Pages with their regions and the boxes of their tokens."""
    key = ["doc_id", "page_number"]
    box = F.struct("left", "top", "right", "bottom")
    regions = reg.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("region_seq", "left", "top", "right", "bottom"))).alias("regions"))
    return page.join(regions, key, "left").join(tok.groupBy(key).agg(F.collect_list(box).alias("boxes")), key, "left")


@frame_operator("page", "reg", "tok")
def dark_blob_regions(page: DataFrame, reg: DataFrame, tok: DataFrame) -> DataFrame:
    """Dark regions found in the pixels of pages drawn with all their regions, with their statistics. Pages are drawn and looked
    at in one stage, so that no pixels go from one to another."""
    return _pages(page, reg, tok).mapInPandas(lambda batches: raster.regions_of(drawn(batches), 72), raster.REGIONS)
