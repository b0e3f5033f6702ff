"""Tones and colours as expressions over pixels: adjustments, posterising, brightness, and threshold maps that need no page kernel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.operators import raster as r


def half_up(x: Column) -> Column:
    """Rounded to a byte."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def adjusted(v: Column, exposure: float = 0.0, contrast: float = 0.0, highlights: float = 0.0, shadows: float = 0.0, whites: float = 0.0, blacks: float = 0.0) -> Column:
    """A tone from 0 to 1, adjusted: exposure in stops, the others from -100 to 100.

    In this order: brightness; contrast about the middle gray; the light and the dark part
    lifted by up to 0.4; white and black points moved by up to a quarter.
    """
    # Each step is a lambda's variable, so a long chain doesn't repeat what came before.
    steps = []
    if exposure:
        steps.append(lambda x: x * 2.0**exposure)
    if contrast:
        steps.append(lambda x: 0.5 + (x - 0.5) * 2.0 ** (1.3 * contrast / 100))
    if highlights:
        steps.append(lambda x: x + 0.4 * highlights / 100 * smoothstep(0.25, 1.0, x))
    if shadows:
        steps.append(lambda x: x + 0.4 * shadows / 100 * (1 - smoothstep(0.0, 0.75, x)))
    if whites:
        white = 0.25 * whites / 100
        steps.append(lambda x: x + white * ((1 - x) if white > 0 else x) * smoothstep(0.5, 1.0, x))
    if blacks:
        black = 0.25 * blacks / 100
        steps.append(lambda x: black + x * (1 - black) if black > 0 else F.greatest(F.lit(0.0), x + black) / (1 + black))
    out = F.array(v.cast("double"))
    for step in steps:
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def photo_adjusted(c: Column, tone: dict[str, float], temperature: float = 0.0, tint: float = 0.0, channel: str = "gray") -> Column:
    """A byte of one channel after tones, warmth (more red, less blue) and tint (less green)."""
    shown = half_up(adjusted(c / 255.0, **tone) * 255)
    factor = {"gray": 1.0, "red": 1 + 0.3 * temperature / 100, "blue": 1 - 0.3 * temperature / 100, "green": 1 - 0.3 * tint / 100}[channel]
    return shown if channel == "gray" else half_up(shown * factor)


#: Share of a page's pixels from which a level counts when the range of tones is measured.
LEAST_SHARE = 0.0005


def posterized(pixels: DataFrame, levels: int, normalize: bool = False) -> DataFrame:
    """v as the commonest tone of its group, after the page's range has been spread: groups are `levels` equal parts of the range.

    Black and white keep themselves. Of tones as common the darkest stands for the group.
    The palette is at most 256 rows a page, so the map is joined to a page's pixels by page
    and tone.
    """
    h = r.histogram(pixels)
    page = Window.partitionBy("page_id")
    counted = F.col("n") >= LEAST_SHARE * F.sum("n").over(page)
    h = h.withColumn("counted", counted).withColumns({"low": F.min(F.when(F.col("counted"), F.col("v"))).over(page), "high": F.max(F.when(F.col("counted"), F.col("v"))).over(page)})
    spread = F.when(F.col("v").isin(0, 255) | (F.col("high") <= F.col("low")), F.col("v")).otherwise(half_up((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * 255))
    h = h.withColumn("spread", spread).withColumn("group", F.floor(F.col("spread") / (255.0 / levels)))
    best = F.max(F.struct("n", -F.col("v"), "v", "spread")).over(Window.partitionBy("page_id", "group"))
    chosen = h.withColumn("best", best).select("page_id", "v", (F.col("best.spread") if normalize else F.col("best.v")).alias("tone"))
    return pixels.join(chosen, ["page_id", "v"]).select("page_id", "y", "x", F.col("tone").alias("v"))


def with_brightness(red: Column, green: Column, blue: Column, brightness: Column, wr: float = 0.299, wb: float = 0.114) -> tuple[Column, Column, Column]:
    """A colour with its luma replaced and its colour differences kept."""
    luma = wr * red + (1 - wr - wb) * green + wb * blue
    r2, b2 = brightness + (red - luma), brightness + (blue - luma)
    g2 = (brightness - r2 * wr - b2 * wb) / (1 - wr - wb)
    cut = lambda x: F.least(F.greatest((x + 0.5).cast("int"), F.lit(0)), F.lit(255))
    return cut(r2), cut(g2), cut(b2)


def scaled_colour(c: Column, gray: Column, filtered: Column) -> Column:
    """A channel after its gray has been filtered: scaled as the gray was, less what that would shift."""
    scale = (filtered + 1) / (gray + 1)
    return half_up(c * scale + filtered - gray * scale)


def singh(k: float, delta: float = 0.0) -> Column:
    """Threshold from the rounded local mean and how far the pixel is from it."""
    mean = F.floor(F.least(F.greatest(F.col("mean") + 0.5, F.lit(0.0)), F.lit(255.0)))
    apart = F.col("v") - mean
    part = 0.5 * (1 - (apart / (256 - apart) + delta / 128))
    return F.floor(F.least(F.greatest(mean * (1 - k * part), F.lit(0.0)), F.lit(255.0)))


def framed(width: Column, height: Column, inner: int, frame: int) -> Column:
    """Pixels of a page of one tone with a frame of another, row by row; none without a size."""
    edge = lambda i: (i % width == 0) | (i % width == width - 1) | (F.floor(i / width) == 0) | (F.floor(i / width) == height - 1)
    made = F.transform(F.sequence(F.lit(0), width * height - 1), lambda i: F.when(edge(i), frame).otherwise(inner))
    return F.when((width > 0) & (height > 0), made).otherwise(F.expr("cast(array() as array<int>)"))
