"""Local threshold methods, on pixels that carry the mean and sd of the window around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _page(c: Column) -> Column:
    return c.over(Window.partitionBy("page_id"))


def _sauvola(k: float, delta: float) -> Column:
    return F.col("mean") * (1 - k * (1 - (F.col("sd") / 128 + delta / 128)))


def _wolf(k: float, delta: float) -> Column:
    low, most = _page(F.min("v")), _page(F.max("sd"))
    return (F.col("mean") - low) * (1 - k * (1 - (F.col("sd") / F.when(most == 0, 1.0).otherwise(most) + delta / 128))) + low


def _apart() -> Column:
    d = F.col("v") - F.col("mean")
    return d / (256 - d)


def _fox(k: float, delta: float) -> Column:
    low, most = _page(F.min("v")), _page(F.max(_apart()))
    return (F.col("mean") - low) * (1 - 0.5 * k * (1 - (_apart() / F.when(most == 0, 1.0).otherwise(most) + delta / 128))) + low


def _window(k: float, delta: float) -> Column:
    page_mean = F.floor(_page(F.avg("v")))
    low, most = _page(F.min("sd")), _page(F.max("sd"))
    md = (F.col("mean") + 1 - delta) / (page_mean + F.col("sd") + 1)
    share = F.when(most > low, (F.col("sd") - low) / (most - low)).otherwise(1.0)
    return F.col("mean") * (1 - 3 * k * md / (1 + (2 * page_mean + 1) / (F.col("sd") + 1) * share))


def _bradley(k: float, delta: float) -> Column:
    return (F.col("mean") * (1 - k) if k < 1 else F.lit(0.0)) + delta


def _grad(k: float, delta: float) -> Column:
    m = F.floor(F.least(F.greatest(F.col("mean") + 0.5 + delta, F.lit(0.0)), F.lit(255.0)))
    g = F.abs(m - F.col("v"))
    total = _page(F.sum(g))
    level = F.when(total == 0, 127.5).otherwise(_page(F.sum(g * F.col("v"))) / total)
    return level * (1 - k) + m * k


def _nick(k: float, delta: float) -> Column:
    t = F.col("mean") - k * F.sqrt(F.col("sd") * F.col("sd") + ((50 - delta) / 100) * F.col("mean") * F.col("mean"))
    return F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(255.0)))


#: Methods with their usual coefficient.
METHODS = {"sauvola": (_sauvola, 0.34), "wolf": (_wolf, 0.3), "fox": (_fox, 0.3), "window": (_window, 0.2), "bradley": (_bradley, 0.2), "grad": (_grad, 0.75), "nick": (_nick, 0.2)}


def thresholds(stats: DataFrame, method: str, k: float | None = None, delta: float = 0.0) -> DataFrame:
    """t: the threshold of each pixel by the method; black is what is darker."""
    f, usual = METHODS[method]
    return stats.withColumn("t", f(usual if k is None else k, delta))


def binarized(stats: DataFrame, method: str, k: float | None = None, delta: float = 0.0, low: int = 0, high: int = 255) -> DataFrame:
    """black by a method within bounds: always below low, never above high."""
    t = thresholds(stats, method, k, delta)
    v = F.col("v")
    return t.withColumn("black", F.when((v < low) | ((v <= high) & (v < F.col("t"))), 1).otherwise(0)).drop("t")


def squared_distances(pixels: DataFrame) -> DataFrame:
    """squared: distance of each pixel to the nearest black one of its page; none on a page without ink.

    Down the columns by windows; then along the rows, whose length bounds the join.
    """
    column = Window.partitionBy("page_id", "x").orderBy("y")
    at = F.when(F.col("black") == 1, F.col("y"))
    up = F.last(at, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(at, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    d = F.least(F.col("y") - up, down - F.col("y"))
    rows = pixels.select("page_id", "y", "x", d.alias("d"))
    lines = rows.groupBy("page_id", "y").agg(F.collect_list(F.struct("x", "d")).alias("line"))
    lines = lines.withColumn("near", F.filter("line", lambda c: c["d"].isNotNull())).where(F.size("near") > 0)
    best = F.transform("line", lambda c: F.struct(c["x"].alias("x"), F.array_min(F.transform("near", lambda o: o["d"] * o["d"] + (c["x"] - o["x"]) * (c["x"] - o["x"]))).alias("squared")))
    return lines.select("page_id", "y", F.inline(best)).select("page_id", "y", "x", "squared")


def edge_divided(stats: DataFrame, edge: float, blur: float) -> DataFrame:
    """v with edges raised, divided by the blurred page, or both; its threshold is then a global one."""
    v, mean = F.col("v"), F.col("mean")
    r = edge * v * ((v + 1) / (mean + 1) - 0.5) + (1 - edge) * v if edge > 0 else v.cast("double")
    stats = stats.withColumn("__r", r)
    q = blur * ((mean + 1) / (F.col("__r") + 1) - 0.5) + (1 - blur)
    out = F.when(q > 0, F.col("__r") / q).otherwise(F.col("__r")) if blur > 0 else F.col("__r")
    return stats.withColumn("v", F.floor(F.least(F.greatest(out, F.lit(0.0)), F.lit(255.0)) + 1e-9).cast("int")).drop("__r")


def mokji(pixels: DataFrame, edge: int, magnitude: int) -> DataFrame:
    """Threshold between dark and light sides of edges: pairs of a pixel and the darkest around it that are magnitude apart."""
    from leafmill.operators.raster import frame

    page = Window.partitionBy("page_id")
    p = frame(F.min, "v", "dark", (-edge, edge), (-edge, edge), pixels).withColumns({"w": F.max("x").over(page), "h": F.max("y").over(page)})
    inside = F.col("x").between(edge, F.col("w") - edge) & F.col("y").between(edge, F.col("h") - edge) & (F.col("v") - F.col("dark") >= magnitude)
    g = p.groupBy("page_id").agg(F.sum(F.when(inside, F.col("dark") + F.col("v"))).alias("s"), F.count_if(inside).alias("n"))
    return g.select("page_id", F.coalesce(F.when(F.col("n") > 0, F.floor(0.5 * F.col("s") / F.col("n") + 0.5)), F.lit(128)).cast("int").alias("threshold"))


#: All methods by name: how a page's threshold or map is made.
GLOBAL, KERNEL = ("otsu", "mokji", "peak", "bimodal"), ("gatos", "robust", "multi_scale")
EDGES = {"edge_plus": (0.75, 0.0), "blur_div": (0.0, 0.75), "edge_div": (0.75, 0.75)}
ALL_METHODS = (*GLOBAL, *METHODS, "singh", *EDGES, *KERNEL)


def black_by(pixels: DataFrame, method: str, window: int = 51, k: float | None = None, delta: float = 0.0, low: int = 0, high: int = 255) -> DataFrame:
    """(page_id, y, x, black) by any of ALL_METHODS: darker than the threshold, always black below low and never above high."""
    from leafmill.operators import kernels, raster, tones

    if method not in ALL_METHODS:
        raise ValueError(f"no method {method}; there are {', '.join(ALL_METHODS)}")
    radius = max(1, window // 2)
    if method in KERNEL or method == "bimodal":
        shift = int(delta)
        made = {
            "gatos": lambda a: kernels.gatos(a, radius, 0.2 if k is None else k, shift),
            "robust": lambda a: (x := kernels.robust(a, radius, 0.2 if k is None else k)) < kernels.two_tones(x, shift, low, high),
            "multi_scale": lambda a: a < kernels.multi_scale(a, radius, 0.5 if k is None else k) + shift,
            "bimodal": lambda a: a < kernels.two_tones(a, shift, low, high),
        }[method]
        bounded = lambda a: ((a < low) | ((a <= high) & (made(a) > 0))).astype(int)
        return kernels.per_page(pixels, bounded, "v", "black")
    if method in GLOBAL or method in EDGES:
        # A filtered page has its threshold by itself; bounds are on the page as it was.
        read = edge_divided(raster.local_stats(pixels, window, window).withColumn("own", F.col("v")), *EDGES[method]) if method in EDGES else pixels.withColumn("own", F.col("v"))
        if method == "mokji":
            cuts = mokji(read, max(1, radius // 10), 20)
        elif method == "peak":
            cuts = raster.dense_histogram(read).select("page_id", raster.peak_threshold(F.col("h")).alias("threshold"))
        else:
            cuts = raster.otsu(read)
        t = read.join(cuts, "page_id").withColumn("t", F.col("threshold") + delta)
    else:
        stats = raster.local_stats(pixels, window, window).withColumn("own", F.col("v"))
        t = stats.withColumn("t", tones.singh(0.2 if k is None else k, delta)) if method == "singh" else thresholds(stats, method, k, delta)
    black = (F.col("own") < low) | ((F.col("own") <= high) & (F.col("v") < F.col("t")))
    return t.select("page_id", "y", "x", F.when(black, 1).otherwise(0).alias("black"))
