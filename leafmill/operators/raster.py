"""Operators on pages as relations of pixels: (page_id, y, x, v) or (page_id, y, x, black).

Every operator keeps a page together by page_id and nothing else: windows of one page are
partitioned by page_id first, so the first one deals pages out and the others reuse that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F



def clamp_byte(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int")


def gray_of(r: Column, g: Column, b: Column) -> Column:
    """Gray of a colour: 11, 16 and 5 parts of 32."""
    return F.floor((r * 11 + g * 16 + b * 5) / 32).cast("int")


def histogram(pixels: DataFrame, value: str = "v", mask: Column | None = None) -> DataFrame:
    """(page_id, v, n) of the values that occur, counting masked pixels only."""
    n = F.count("*") if mask is None else F.count_if(mask)
    return pixels.groupBy("page_id", F.col(value).alias("v")).agg(n.alias("n"))


def dense_histogram(pixels: DataFrame) -> DataFrame:
    """(page_id, h): 256 counts a page, as an array. Partial counts are 256 numbers a page, whatever its size."""
    h = histogram(pixels).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    return h.select("page_id", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("h"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(page_id, threshold): pixels darker than it are black. 0 for a page of one tone.

    Between-class variance at each level; the middle between the first and the last of the
    best ones. Runs on the histogram, at most 256 rows a page.
    """
    h = histogram(pixels)
    upto = Window.partitionBy("page_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = Window.partitionBy("page_id")
    s = h.withColumns({"nb": F.sum("n").over(upto), "mb": F.sum(F.col("n") * F.col("v")).over(upto), "nn": F.sum("n").over(page), "mm": F.sum(F.col("n") * F.col("v")).over(page), "next_v": F.lead("v", 1, 256).over(page.orderBy("v"))})
    na, ma = F.col("nn") - F.col("nb"), F.col("mm") - F.col("mb")
    apart = F.col("mb") / F.col("nb") - ma / na
    s = s.withColumn("var", F.when(na > 0, apart * apart * F.col("nb").cast("double") * na.cast("double")))
    s = s.withColumn("best", F.max("var").over(page))
    # A level without pixels has the variance of the one before.
    hit = F.col("var") == F.col("best")
    first, last = F.min(F.when(hit, F.col("v"))), F.max(F.when(hit, F.col("next_v") - 1))
    g = s.groupBy("page_id").agg(F.coalesce(first, F.lit(-1)).alias("a"), F.coalesce(last, F.lit(-1)).alias("b"))
    return g.select("page_id", F.floor((F.col("a") + F.col("b") + 2) / 2).cast("int").alias("threshold"))


def threshold(pixels: DataFrame, cuts: DataFrame) -> DataFrame:
    """black by a threshold of each page."""
    return pixels.join(cuts, "page_id").select("page_id", "y", "x", "v", F.when(F.col("v") < F.col("threshold"), 1).otherwise(0).alias("black"))


def projections(pixels: DataFrame) -> DataFrame:
    """(page_id, axis, i, n): black pixels of each row and column, in one pass."""
    sets = pixels.groupingSets([["page_id", "y"], ["page_id", "x"]], "page_id", "y", "x").agg(F.sum("black").alias("n"), F.grouping_id().alias("g"))
    return sets.select("page_id", F.when(F.col("x").isNull(), "row").otherwise("column").alias("axis"), F.coalesce("y", "x").alias("i"), "n")


def bounding_box(ink: DataFrame) -> DataFrame:
    return ink.where("black = 1").groupBy("page_id").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"), F.count("*").alias("ink"))


def spans(bins: DataFrame, keys: list[str], min_gap: int, min_length: int) -> DataFrame:
    """(keys, begin, end) of runs of bins with n > 0: gaps shorter than min_gap are bridged, then short spans go."""
    w = Window.partitionBy(*keys).orderBy("i")
    full = bins.where("n > 0").withColumn("gap", F.col("i") - F.lag("i").over(w) - 1)
    new = F.when(F.col("gap").isNull() | (F.col("gap") >= min_gap), 1).otherwise(0)
    # A gap of zero is none, even where every gap parts spans.
    new = F.when(F.col("gap") == 0, 0).otherwise(new)
    island = full.withColumn("span", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*keys, "span").agg(F.min("i").alias("begin"), (F.max("i") + 1).alias("end"))
    return out.where(F.col("end") - F.col("begin") >= min_length).drop("span")


def reach(size: int) -> tuple[int, int]:
    """Frame of a window of that size: half of it before, the rest after."""
    return -(size >> 1), size - (size >> 1) - 1


def along(axis: str) -> "Window":
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("page_id", other).orderBy(axis)


def frame(agg, value: str, name: str, x: tuple[int, int], y: tuple[int, int], df: DataFrame) -> DataFrame:
    """agg of value over a box of pixels, one axis after the other; the page's edges clip the box."""
    df = df.withColumn("__f", agg(value).over(along("x").rangeBetween(*x)))
    return df.withColumn(name, agg("__f").over(along("y").rangeBetween(*y))).drop("__f")


def local_stats(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """mean and sd of the box around each pixel, population sd, over the clipped area."""
    across, down = along("x").rangeBetween(*reach(width)), along("y").rangeBetween(*reach(height))
    one = {"__s": F.col("v").cast("long"), "__sq": (F.col("v") * F.col("v")).cast("long"), "__n": F.lit(1).cast("long")}
    # All three sums of an axis share a window, and so an exchange.
    df = pixels.withColumns(one)
    for window in (across, down):
        df = df.withColumns({name: F.sum(name).over(window) for name in one})
    r = 1.0 / F.col("__n")
    df = df.withColumn("mean", F.col("__s") * r)
    return df.withColumn("sd", F.sqrt(F.abs(F.col("__sq") * r - F.col("mean") * F.col("mean")))).drop("__s", "__sq", "__n")


def integral(pixels: DataFrame) -> DataFrame:
    """sum of all values above and left of each pixel, itself included."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    df = pixels.withColumn("__r", F.sum("v").over(along("x").rowsBetween(*upto)))
    return df.withColumn("total", F.sum("__r").over(along("y").rowsBetween(*upto))).drop("__r")


def brick(size: int) -> tuple[int, int]:
    """Reach of a brick of that size, as the frame that is sampled: the brick turned around."""
    low, high = -(size >> 1), size - 1 - (size >> 1)
    return -high, -low


def dilate(df: DataFrame, w: int, h: int, value: str = "black", out: str = "black", flipped: bool = False, gray: bool = False) -> DataFrame:
    """Black spreads over the brick: the maximum of black, the minimum of gray. Surroundings are white."""
    return _morph(df, w, h, value, out, flipped, F.min if gray else F.max)


def erode(df: DataFrame, w: int, h: int, value: str = "black", out: str = "black", flipped: bool = False, gray: bool = False) -> DataFrame:
    """White spreads over the brick. Surroundings are black."""
    return _morph(df, w, h, value, out, flipped, F.max if gray else F.min)


def _morph(df, w, h, value, out, flipped, agg):
    """A box maximum or minimum; the page's edges clip the box, so surroundings are neutral."""
    turn = lambda t: (-t[1], -t[0]) if flipped else t
    return frame(agg, value, "__m", turn(brick(w)), turn(brick(h)), df).withColumn(out, F.col("__m")).drop("__m")


def padded(df: DataFrame, dx: int, dy: int, value: str, fill: int) -> DataFrame:
    """Pages with a frame of fill around them, dx and dy pixels wide; __page tells the page's own pixels."""
    ends = df.groupBy("page_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    wide = ends.select("*", F.explode(F.sequence(F.col("y0") - dy, F.col("y1") + dy)).alias("y"))
    ring = wide.select("*", F.explode(F.sequence(F.col("x0") - dx, F.col("x1") + dx)).alias("x")).where("not (x between x0 and x1 and y between y0 and y1)")
    ring = ring.select("page_id", "y", "x", F.lit(fill).alias(value), F.lit(False).alias("__page"))
    return df.withColumn("__page", F.lit(True)).unionByName(ring, allowMissingColumns=True)


def opened(df: DataFrame, w: int, h: int, value: str = "black", out: str = "black", gray: bool = False) -> DataFrame:
    """Erosion, then dilation by the brick turned around, amid white."""
    p = padded(df, 2 * w, 2 * h, value, 255 if gray else 0)
    return dilate(erode(p, w, h, value, "__o", gray=gray), w, h, "__o", out, True, gray).where("__page").drop("__o", "__page")


def closed(df: DataFrame, w: int, h: int, value: str = "black", out: str = "black", gray: bool = False) -> DataFrame:
    """Dilation, then erosion by the brick turned around, amid white."""
    p = padded(df, 2 * w, 2 * h, value, 255 if gray else 0)
    return erode(dilate(p, w, h, value, "__c", gray=gray), w, h, "__c", out, True, gray).where("__page").drop("__c", "__page")


def hit_miss(df: DataFrame, hits: list[tuple[int, int]], misses: list[tuple[int, int]]) -> DataFrame:
    """match: all hits, at (dx, dy) from a pixel, are black and all misses white; outside of the page is white."""
    rows = {dy for _, dy in hits + misses}
    df = df.withColumns({f"__r{dy}": F.lag("black", -dy, 0).over(along("y")) if dy else F.col("black") for dy in rows})
    ok = F.lit(True)
    for places, want in ((hits, 1), (misses, 0)):
        for dx, dy in places:
            cell = F.coalesce(F.lag(f"__r{dy}", -dx).over(along("x")), F.lit(0)) if dx else F.col(f"__r{dy}")
            ok = ok & (cell == want)
    return df.withColumn("match", ok).drop(*(f"__r{dy}" for dy in rows))


def sobel(df: DataFrame) -> DataFrame:
    """gx and gy; beyond the edges pixels repeat."""
    at = lambda c, axis, d: F.coalesce(F.lag(c, -d).over(along(axis)), F.col(c))
    df = df.withColumns({"__sx": at("v", "y", -1) + 2 * F.col("v") + at("v", "y", 1), "__dy": at("v", "y", 1) - at("v", "y", -1)})
    df = df.withColumns({"gx": at("__sx", "x", 1) - at("__sx", "x", -1), "gy": at("__dy", "x", -1) + 2 * F.col("__dy") + at("__dy", "x", 1)})
    return df.drop("__sx", "__dy")


def reduced(df: DataFrame, at_least: int) -> DataFrame:
    """Half the size each way; black where that many of four pixels are. A last odd row or column goes."""
    side = df.groupBy("page_id").agg((F.floor((F.max("x") + 1) / 2)).alias("w"), (F.floor((F.max("y") + 1) / 2)).alias("h"))
    g = df.groupBy("page_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.when(F.sum("black") >= at_least, 1).otherwise(0).alias("black"))
    return g.join(side, "page_id").where("x < w and y < h").drop("w", "h")


def block_mean(df: DataFrame, factor: int) -> DataFrame:
    n = F.count("*")
    s = F.sum("v") + F.floor(n / 2)
    return df.groupBy("page_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.floor(s / n).cast("int").alias("v"))


def upscaled(df: DataFrame, k: int) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    d = df.select("*", F.explode(steps).alias("__i")).select("*", F.explode(steps).alias("__j"))
    return d.select("page_id", (F.col("y") * k + F.col("__i")).alias("y"), (F.col("x") * k + F.col("__j")).alias("x"), "v")


def rotated(df: DataFrame, degrees: int, width: int, height: int) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    to = {0: (x, y), 90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}[degrees % 360]
    return df.select("page_id", to[1].alias("y"), to[0].alias("x"), "v")


def dominant_level(h: Column) -> Column:
    """Median of the ten neighbouring levels that hold most pixels, from an array of 256 counts."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(246)), lambda i: F.aggregate(F.slice(h, i + 1, F.lit(10)), F.lit(0).cast("long"), lambda a, n: a + n))
    best = F.array_max(sums)
    start = (F.array_position(sums, best) - 1).cast("int")
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("steps"))
    step = lambda a, n: F.struct((a["sum"] + n).alias("sum"), (a["steps"] + F.when(a["sum"] + n >= F.floor(best / 2), 0).otherwise(1)).alias("steps"))
    return start + F.aggregate(F.slice(h, start + 1, F.lit(10)), zero, step, lambda a: a["steps"])


def peak_threshold(h: Column) -> Column:
    """Three quarters of the way from the lowest peak to the highest one; a peak ends where a level falls below 66 % of it."""
    def peak(counts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("most"), F.lit(0).alias("where"), F.lit(0).alias("i"), F.lit(False).alias("done"))

        def step(a: Column, n: Column) -> Column:
            up = ~a["done"] & (n > a["most"])
            over = a["done"] | (~up & (n < a["most"] * 0.66))
            return F.struct(F.when(up, n).otherwise(a["most"]).alias("most"), F.when(up, a["i"]).otherwise(a["where"]).alias("where"), (a["i"] + 1).alias("i"), over.alias("done"))

        return F.aggregate(counts, zero, step, lambda a: a["where"])

    left, right = peak(h), 255 - peak(F.reverse(h))
    return F.floor(left + (right - left) * 0.75).cast("int")


def stretched(df: DataFrame, black_clip: float, white_clip: float) -> DataFrame:
    """Gray range stretched so that those shares of pixels end at black and white."""
    h = histogram(df)
    page = Window.partitionBy("page_id")
    up = page.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    down = page.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({"below": F.coalesce(F.sum("n").over(up), F.lit(0)), "above": F.coalesce(F.sum("n").over(down), F.lit(0)), "all": F.sum("n").over(page)})
    clip = lambda share: F.round(F.col("all") * F.lit(share)).cast("long")
    ends = h.groupBy("page_id").agg(F.min(F.when(clip(black_clip) - F.col("below") < F.col("n"), F.col("v"))).alias("low"), F.max(F.when(clip(white_clip) - F.col("above") < F.col("n"), F.col("v"))).alias("high"))
    j = df.join(ends, "page_id")
    d = F.col("high") - F.col("low")
    within = F.least(F.greatest(F.col("v"), F.col("low")), F.col("high"))
    two = F.when(F.col("v") < F.floor((F.col("low") + F.col("high")) / 2), 0).otherwise(255)
    v = F.when(d > 0, F.floor((255 * (within - F.col("low")) + F.floor(d / 2)) / d)).otherwise(two)
    return j.select("page_id", "y", "x", v.cast("int").alias("v"))
