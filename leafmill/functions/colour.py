"""Colours as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.functions.geometry import smoothstep
from leafmill.operators.raster import gray_of

__all__ = ["between", "paper_colour", "smoothstep", "to_lab"]


def between(a: Column, b: Column, share: float) -> Column:
    return a + (b - a) * share


def to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab of an sRGB colour, for the D65 white."""
    def linear(c: Column) -> Column:
        return F.when(c <= 10, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))

    def bent(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3))).otherwise(7.787 * t + 16.0 / 116)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = bent((0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047)
    y = bent(0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb)
    z = bent((0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def paper_colour(pixels: DataFrame, brightness: int, darkest: int) -> DataFrame:
    """(page_id, pr, pg, pb): channel medians of the brightest quarter of the bright pixels; no row where that is too dark."""
    bright = pixels.withColumn("gray", gray_of(F.col("r"), F.col("g"), F.col("b"))).where(F.col("gray") >= brightness)
    q = F.ntile(4).over(Window.partitionBy("page_id").orderBy(F.col("gray").desc(), "y", "x"))
    top = bright.withColumn("q", q).where("q = 1")
    median = lambda c: F.percentile_approx(c, 0.5, 1_000_000).alias(f"p{c}")
    return top.groupBy("page_id").agg(median("r"), median("g"), median("b")).where(F.least("pr", "pg", "pb") >= darkest)
