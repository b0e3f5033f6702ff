"""The six stages of page processing on pages as rows, and their composition.

Up to the content box a page needs nothing but itself, so these stages are one kernel: a
page goes in, its one or two cut, level pages with their ink come out, and no pixel is
shuffled. Margins need the common size of all pages: one row, joined back to each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from leafmill.operators import kernels as k, raster as r


def oriented(page: np.ndarray, degrees: int = 0) -> np.ndarray:
    """Stage 1: a page turned clockwise by quarter turns."""
    return np.rot90(page, -(degrees // 90) % 4)


def whitespace_cuts(pixels: DataFrame, min_ink: int, width: int) -> DataFrame:
    """Stage 2 on pixels: where each page is cut: the middle of its widest gap between inked columns, the first of equals, or its middle."""
    columns = pixels.groupBy("page_id", F.col("x").alias("i")).agg(F.sum("black").alias("ink"))
    bins = columns.withColumn("n", F.when(F.col("ink") >= min_ink, F.col("ink")).otherwise(0))
    spans = r.spans(bins, ["page_id"], 1, 1)
    gaps = spans.withColumn("next", F.lead("begin").over(Window.partitionBy("page_id").orderBy("begin"))).where("next is not null")
    best = gaps.groupBy("page_id").agg(F.max_by((F.col("end") + F.col("next")) / 2, F.struct(F.col("next") - F.col("end"), -F.col("end"))).alias("cut"))
    return pixels.select("page_id").distinct().join(best, "page_id", "left").select("page_id", F.coalesce("cut", F.lit(width / 2)).alias("cut"))


def cut_of(black: np.ndarray, min_ink: int) -> float:
    """The same cut of one page."""
    inked = np.flatnonzero(black.sum(axis=0) >= min_ink)
    gaps = np.diff(inked) - 1
    if not gaps.max(initial=0):
        return black.shape[1] / 2
    i = int(np.argmax(gaps))
    return (inked[i] + 1 + inked[i + 1]) / 2


def split(page: np.ndarray, cut: float) -> list[np.ndarray]:
    """Two pages of one; a side without columns has none."""
    at = int(np.ceil(cut))
    return [page[:, :at], page[:, at:]]


def deskewed(black: np.ndarray) -> np.ndarray:
    """Stage 3: (y, x) of the ink, its columns moved so that lines are level; what leaves the page is cut."""
    angle = k.skew_angle(black)
    y, x = np.nonzero(black)
    by = np.tan(np.radians(angle)) * (x - black.shape[1] / 2)
    y = y - (np.sign(by) * np.floor(np.abs(by) + 0.5)).astype(int)
    inside = (y >= 0) & (y < black.shape[0])
    return np.stack((y[inside], x[inside]))


def prepared(pages: DataFrame, degrees: int = 0, min_ink: int = 3) -> DataFrame:
    """Stages 1 to 4: (page_id, left, top, right, bottom, y, x): content box and ink of the pages 2 * page_id and 2 * page_id + 1, if they have any."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, page in k.pages_of(batch):
                page = oriented(page, degrees)
                for side, half in enumerate(split(page, cut_of(page, min_ink))):
                    y, x = deskewed(half) if half.size else (np.empty(0, int), np.empty(0, int))
                    if len(y):
                        order = np.lexsort((x, y))
                        rows.append((2 * batch.column(0)[i].as_py() + side, x.min(), y.min(), x.max(), y.max(), y[order], x[order]))
            kinds = (pa.int64(), *[pa.int32()] * 4, *[pa.list_(pa.int32())] * 2)
            names = ["page_id", "left", "top", "right", "bottom", "y", "x"]
            yield pa.RecordBatch.from_arrays([pa.array([row[j] for row in rows], kind) for j, kind in enumerate(kinds)], names)

    schema = "page_id long, `left` int, top int, `right` int, bottom int, y array<int>, x array<int>"
    return pages.select("page_id", "height", "width", "black").mapInArrow(run, schema)


def with_margins(boxes: DataFrame, margin: int) -> DataFrame:
    """Stage 5: every page at the common size, its content in the middle."""
    sized = boxes.withColumns({"w": F.col("right") - F.col("left") + 1 + 2 * margin, "h": F.col("bottom") - F.col("top") + 1 + 2 * margin})
    common = sized.agg(F.max("w").alias("page_w"), F.max("h").alias("page_h"))
    j = sized.crossJoin(F.broadcast(common))  # one row
    return j.withColumns({"dx": F.floor((F.col("page_w") - F.col("w")) / 2 + margin).cast("int"), "dy": F.floor((F.col("page_h") - F.col("h")) / 2 + margin).cast("int")})


def output(layout: DataFrame) -> DataFrame:
    """Stage 6: the ink of each page moved to its place."""
    ink = layout.select("page_id", "left", "top", "dx", "dy", "page_w", "page_h", F.inline(F.arrays_zip("y", "x")))
    return ink.select("page_id", (F.col("y") - F.col("top") + F.col("dy")).alias("y"), (F.col("x") - F.col("left") + F.col("dx")).alias("x"), "page_w", "page_h")


def process(pages: DataFrame, margin: int = 1) -> DataFrame:
    """Black pixels of all output pages, with the common size. What the kernels find is kept for both the common size and the output, on disk where memory is short."""
    return output(with_margins(prepared(pages).persist(StorageLevel.MEMORY_AND_DISK), margin))
