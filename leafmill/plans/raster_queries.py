"""Queries over pixels, each with the SQL it is compared with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from leafmill.operators import binarize as bz
from leafmill.operators import kernels as k, raster as r
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import Registry

reg = Registry()
V, T, C = f"WITH {fx.VECTOR_PIXELS}", f"WITH {fx.TEXT_PIXELS}", f"WITH {fx.COLOUR_PIXELS}"
HIST = "hist AS (SELECT page_id, v, count(*) AS n FROM {t} GROUP BY 1, 2)"


def box(agg: str, value: str, x: tuple[int, int], y: tuple[int, int], name: str, source: str, out: str = "f") -> str:
    """Two common table expressions that end in `name`: the box aggregate of value in a column out."""
    b = lambda t: f"RANGE BETWEEN {-t[0]} PRECEDING AND {t[1]} FOLLOWING" if t[0] <= 0 <= t[1] else None
    return f"""{name}_x AS (SELECT *, {agg}({value}) OVER (PARTITION BY page_id, y ORDER BY x {b(x)}) AS f_x FROM {source}),
{name} AS (SELECT * EXCLUDE (f_x), {agg}(f_x) OVER (PARTITION BY page_id, x ORDER BY y {b(y)}) AS {out} FROM {name}_x)"""


@reg.add(f"{T}, {HIST.format(t='text_pixels')} SELECT * FROM hist")
def gray_histogram(spark, sf):
    return r.histogram(fx.text_pixels(spark, sf))


@reg.add(f"{T} SELECT page_id, v, count(*) FILTER (WHERE y % 2 = 0 AND black = 1) AS n FROM text_pixels GROUP BY 1, 2")
def masked_histogram(spark, sf):
    return r.histogram(fx.text_pixels(spark, sf), "v", (F.col("y") % 2 == 0) & (F.col("black") == 1))


@reg.add(f"{C} SELECT page_id, channel, level, count(*) AS n FROM (SELECT page_id, unnest(['r', 'g', 'b']) AS channel, unnest([r, g, b]) AS level FROM colours) GROUP BY ALL")
def rgb_histogram(spark, sf):
    c = fx.colour_pixels(spark, sf).select("page_id", F.expr("stack(3, 'r', r, 'g', g, 'b', b) AS (channel, level)"))
    return c.groupBy("page_id", "channel", "level").agg(F.count("*").alias("n"))


@reg.add(f"{T} SELECT page_id, 'row' AS axis, y AS i, sum(black) AS n FROM text_pixels GROUP BY 1, 3 UNION ALL SELECT page_id, 'column', x, sum(black) FROM text_pixels GROUP BY 1, 3")
def row_and_column_projections(spark, sf):
    return k.map_texts(fx.text_pages(spark, sf), k.ink_projections, "axis string, i int, n long")


@reg.add(f"{T} SELECT page_id, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom, count(*) AS ink FROM text_pixels WHERE black = 1 GROUP BY 1")
def content_bounding_box(spark, sf):
    return r.bounding_box(fx.text_pixels(spark, sf))


@reg.add(f"{T} SELECT page_id, count(*) FILTER (WHERE black = 1 AND x BETWEEN 8 AND 55) AS black_in, count(*) FILTER (WHERE black = 0 AND x BETWEEN 8 AND 55) AS white_in, min(v) AS darkest, min(v) FILTER (WHERE v > 0) AS min_level FROM text_pixels GROUP BY 1")
def counts_in_rectangle(spark, sf):
    inside = F.col("x").between(8, 55)
    return fx.text_pixels(spark, sf).groupBy("page_id").agg(F.count_if((F.col("black") == 1) & inside).alias("black_in"), F.count_if((F.col("black") == 0) & inside).alias("white_in"), F.min("v").alias("darkest"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("min_level"))


OTSU = """cum AS (SELECT *, sum(n) OVER u AS nb, sum(n * v) OVER u AS mb, sum(n) OVER p AS nn, sum(n * v) OVER p AS mm, lead(v, 1, 256) OVER (PARTITION BY page_id ORDER BY v) AS next_v FROM hist
 WINDOW u AS (PARTITION BY page_id ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY page_id)),
vars AS (SELECT *, CASE WHEN nn > nb THEN (CAST(mb AS DOUBLE) / nb - CAST(mm - mb AS DOUBLE) / (nn - nb)) * (CAST(mb AS DOUBLE) / nb - CAST(mm - mb AS DOUBLE) / (nn - nb)) * CAST(nb AS DOUBLE) * CAST(nn - nb AS DOUBLE) END AS var FROM cum),
best AS (SELECT *, max(var) OVER (PARTITION BY page_id) AS top FROM vars),
otsu AS (SELECT page_id, CAST((coalesce(min(v) FILTER (WHERE var = top), -1) + coalesce(max(next_v - 1) FILTER (WHERE var = top), -1) + 2) // 2 AS INT) AS threshold FROM best GROUP BY 1)"""


@reg.add(f"{T}, {HIST.format(t='text_pixels')}, {OTSU} SELECT * FROM otsu")
def otsu_threshold(spark, sf):
    return k.map_texts(fx.text_pages(spark, sf), lambda v: {"threshold": np.array([k.otsu_level(v)])}, "threshold int")


@reg.add(f"{T}, {HIST.format(t='text_pixels')}, {OTSU} SELECT page_id, threshold, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom, count(*) AS ink FROM text_pixels JOIN otsu USING (page_id) WHERE v < threshold GROUP BY 1, 2")
def content_box_of_pages(spark, sf):
    return k.map_texts(fx.text_pages(spark, sf), k.content_box, "threshold int, `left` int, top int, `right` int, bottom int, ink long")


@reg.add(f"{V}, {HIST.format(t='pixels')}, {OTSU} SELECT page_id, y, x, CASE WHEN v < least(greatest(threshold + 10, 30), 225) THEN 1 ELSE 0 END AS black FROM pixels JOIN otsu USING (page_id)")
def adjusted_otsu_pages(spark, sf):
    p = fx.vector_pixels(spark, sf)
    cuts = r.otsu(p).withColumn("threshold", F.least(F.greatest(F.col("threshold") + 10, F.lit(30)), F.lit(225)))
    return r.threshold(p, cuts).select("page_id", "y", "x", "black")


@reg.add(f"""{T}, rows AS (SELECT page_id, y AS i, sum(black) AS n FROM text_pixels GROUP BY 1, 2), f AS (SELECT *, i - lag(i) OVER (PARTITION BY page_id ORDER BY i) - 1 AS gap FROM rows WHERE n > 0),
 s AS (SELECT *, sum(CASE WHEN gap = 0 THEN 0 WHEN gap IS NULL OR gap >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM f)
 SELECT page_id, min(i) AS "begin", max(i) + 1 AS "end" FROM s GROUP BY page_id, span HAVING max(i) + 1 - min(i) >= 2""")
def content_spans(spark, sf):
    rows = fx.text_pixels(spark, sf).groupBy("page_id", F.col("y").alias("i")).agg(F.sum("black").alias("n"))
    return r.spans(rows, ["page_id"], 1, 2)


@reg.add(f"{V} SELECT page_id, y, x, sum(t) OVER (PARTITION BY page_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT *, sum(v) OVER (PARTITION BY page_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS t FROM pixels)")
def integral_image(spark, sf):
    return r.integral(fx.vector_pixels(spark, sf)).select("page_id", "y", "x", "total")


STATS = """src AS (SELECT *, CAST(v AS BIGINT) AS v1, CAST(v * v AS BIGINT) AS v2, CAST(1 AS BIGINT) AS one FROM pixels),
{a}, {b}, {c}, stats AS (SELECT page_id, y, x, v, s * (1.0::DOUBLE / n) AS mean, sqrt(abs(sq * (1.0::DOUBLE / n) - (s * (1.0::DOUBLE / n)) * (s * (1.0::DOUBLE / n)))) AS sd FROM b3)"""
STATS = STATS.format(a=box("sum", "v1", r.reach(5), r.reach(3), "b1", "src", "s"), b=box("sum", "v2", r.reach(5), r.reach(3), "b2", "b1", "sq"), c=box("sum", "one", r.reach(5), r.reach(3), "b3", "b2", "n"))


def stats(spark, sf):
    return r.local_stats(fx.vector_pixels(spark, sf), 5, 3)


@reg.add(f"{V}, {STATS} SELECT page_id, y, x, round(mean, 6) AS mean, round(sd, 5) AS sd FROM stats")
def local_mean_and_deviation(spark, sf):
    return stats(spark, sf).select("page_id", "y", "x", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"))


def method(name: str, sql_threshold: str, extra: str = ""):
    """One local threshold method on vector pages: black pixels a page and of the whole threshold map."""
    sql = f"""{V}, {STATS}, page AS (SELECT page_id, min(v) AS lo, avg(v) AS pm, CAST(floor(avg(v)) AS INT) AS im, max(sd) AS smax, min(sd) AS smin FROM stats GROUP BY 1){extra},
 th AS (SELECT s.*, {sql_threshold} AS t FROM stats s JOIN page p USING (page_id){' JOIN more m USING (page_id)' if extra else ''})
 SELECT page_id, sum(CASE WHEN v < t THEN 1 ELSE 0 END) AS black, round(avg(t), 8) AS level FROM th GROUP BY 1"""

    def query(spark, sf):
        t = bz.thresholds(stats(spark, sf), name)
        return t.groupBy("page_id").agg(F.sum(F.when(F.col("v") < F.col("t"), 1).otherwise(0)).alias("black"), F.round(F.avg("t"), 8).alias("level"))

    query.__name__ = f"binarize_{name}"
    reg.add(sql)(query)


D = "(v - mean) / (256 - (v - mean))"
method("sauvola", "mean * (1 - 0.34 * (1 - (sd / 128 + 0.0 / 128)))")
method("wolf", "(mean - lo) * (1 - 0.3 * (1 - (sd / CASE WHEN smax = 0 THEN 1 ELSE smax END + 0.0 / 128))) + lo")
method("fox", f"(mean - lo) * (1 - 0.5 * 0.3 * (1 - ({D} / CASE WHEN dmax = 0 THEN 1 ELSE dmax END + 0.0 / 128))) + lo", f", more AS (SELECT page_id, max({D}) AS dmax FROM stats GROUP BY 1)")
method("window", "mean * (1 - 3 * 0.2 * ((mean + 1 - 0.0) / (im + sd + 1)) / (1 + (2 * im + 1) / (sd + 1) * CASE WHEN smax > smin THEN (sd - smin) / (smax - smin) ELSE 1 END))")
method("bradley", "mean * (1 - 0.2)")
method("grad", "g * (1 - 0.75) + floor(least(greatest(mean + 0.5, 0), 255)) * 0.75", ", more AS (SELECT page_id, CASE WHEN sum(abs(floor(least(greatest(mean + 0.5, 0), 255)) - v)) = 0 THEN 127.5 ELSE sum(abs(floor(least(greatest(mean + 0.5, 0), 255)) - v) * v) / sum(abs(floor(least(greatest(mean + 0.5, 0), 255)) - v)) END AS g FROM stats GROUP BY 1)")
method("nick", "floor(least(greatest(mean - 0.2 * sqrt(sd * sd + ((50 - 0) / 100.0::DOUBLE) * mean * mean), 0), 255))")

BRICK = {"dilated": (("dilate", False),), "eroded": (("erode", False),), "opened": (("erode", False), ("dilate", True)), "closed": (("dilate", False), ("erode", True))}
AGG = {("dilate", "black"): "max", ("erode", "black"): "min", ("dilate", "v"): "min", ("erode", "v"): "max"}


def morph_sql(kind: str, value: str, w: int = 3, h: int = 2) -> str:
    parts, source, col = [], "pixels", value
    if len(BRICK[kind]) > 1:
        parts.append(f"padded AS (SELECT g.page_id, g.y, g.x, coalesce(v, 255) AS v, coalesce(black, 0) AS black, v IS NOT NULL AS own FROM (SELECT DISTINCT page_id, y, x FROM (SELECT DISTINCT page_id FROM pixels), range({-2 * h}, {8 + 2 * h}) a(y), range({-2 * w}, {8 + 2 * w}) b(x)) g LEFT JOIN pixels USING (page_id, y, x))")
        source = "padded"
    for i, (step, flip) in enumerate(BRICK[kind]):
        x, y = r.brick(w), r.brick(h)
        if flip:
            x, y = (-x[1], -x[0]), (-y[1], -y[0])
        parts.append(box(AGG[step, value], col, x, y, f"m{i}", source, f"o{i}"))
        source, col = f"m{i}", f"o{i}"
    return ",\n".join(parts) + f", morphed AS (SELECT page_id, y, x, v, black, {col} AS out FROM {source}{' WHERE own' if len(BRICK[kind]) > 1 else ''})"


def morph(kind: str, value: str):
    run = {"dilated": r.dilate, "eroded": r.erode, "opened": r.opened, "closed": r.closed}[kind]

    def query(spark, sf):
        return run(fx.vector_pixels(spark, sf), 3, 2, value, "out", gray=value == "v").select("page_id", "y", "x", "out")

    query.__name__ = f"{'black' if value == 'black' else 'gray'}_{kind}"
    reg.add(f"{V}, {morph_sql(kind, value)} SELECT page_id, y, x, out FROM morphed")(query)


for _kind in BRICK:
    for _value in ("black", "v"):
        morph(_kind, _value)


@reg.add(f"{V}, {morph_sql('opened', 'black')} SELECT page_id, y, x FROM morphed WHERE black = 1 AND out = 0")
def white_top_hat(spark, sf):
    return r.opened(fx.vector_pixels(spark, sf), 3, 2, "black", "out").where("black = 1 and out = 0").select("page_id", "y", "x")


@reg.add(f"{V}, {morph_sql('closed', 'black')} SELECT page_id, y, x FROM morphed WHERE black = 0 AND out = 1")
def black_top_hat(spark, sf):
    return r.closed(fx.vector_pixels(spark, sf), 3, 2, "black", "out").where("black = 0 and out = 1").select("page_id", "y", "x")


@reg.add(f"{V}, {box('max', 'v', (-1, 1), (-1, 1), 'hi', 'pixels', 'most')}, {box('min', 'v', (-1, 1), (-1, 1), 'lo', 'hi', 'least')} SELECT page_id, y, x, most - v AS light_side, v - least AS dark_side, v = most AS peak FROM lo")
def gradients_and_peaks(spark, sf):
    p = r.frame(F.max, "v", "most", (-1, 1), (-1, 1), fx.vector_pixels(spark, sf))
    p = r.frame(F.min, "v", "least", (-1, 1), (-1, 1), p)
    return p.select("page_id", "y", "x", (F.col("most") - F.col("v")).alias("light_side"), (F.col("v") - F.col("least")).alias("dark_side"), (F.col("v") == F.col("most")).alias("peak"))


@reg.add(f"""{V}, n AS (SELECT *, coalesce(lag(black) OVER (PARTITION BY page_id, y ORDER BY x), 0) AS l, coalesce(lead(black) OVER (PARTITION BY page_id, y ORDER BY x), 0) AS r, coalesce(lag(black) OVER (PARTITION BY page_id, x ORDER BY y), 0) AS u FROM pixels)
 SELECT page_id, y, x FROM n WHERE black = 1 AND r = 1 AND l = 0 AND u = 0""")
def hit_miss_corners(spark, sf):
    return r.hit_miss(fx.vector_pixels(spark, sf), [(0, 0), (1, 0)], [(-1, 0), (0, -1)]).where("match").select("page_id", "y", "x")


@reg.add(f"""{V}, e AS (SELECT *, coalesce(lag(v) OVER c, v) AS up, coalesce(lead(v) OVER c, v) AS dn FROM pixels WINDOW c AS (PARTITION BY page_id, x ORDER BY y)), s AS (SELECT *, up + 2 * v + dn AS sx, dn - up AS dy FROM e)
 SELECT page_id, y, x, coalesce(lead(sx) OVER w, sx) - coalesce(lag(sx) OVER w, sx) AS gx, coalesce(lag(dy) OVER w, dy) + 2 * dy + coalesce(lead(dy) OVER w, dy) AS gy FROM s WINDOW w AS (PARTITION BY page_id, y ORDER BY x)""")
def sobel_gradients(spark, sf):
    return r.sobel(fx.vector_pixels(spark, sf)).select("page_id", "y", "x", "gx", "gy")


@reg.add(f"{V} SELECT page_id, y // 2 AS y, x // 2 AS x, CASE WHEN sum(black) >= 2 THEN 1 ELSE 0 END AS black FROM pixels GROUP BY 1, 2, 3")
def threshold_reduction(spark, sf):
    return r.reduced(fx.vector_pixels(spark, sf), 2)


@reg.add(f"{V} SELECT page_id, y // 3 AS y, x // 3 AS x, CAST((sum(v) + count(*) // 2) // count(*) AS INT) AS v FROM pixels GROUP BY 1, 2, 3")
def block_means(spark, sf):
    return r.block_mean(fx.vector_pixels(spark, sf), 3)


@reg.add(f"{V} SELECT page_id, y * 2 + i AS y, x * 2 + j AS x, v FROM pixels, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)")
def upscaled_pages(spark, sf):
    return r.upscaled(fx.vector_pixels(spark, sf), 2)


@reg.add(f"{V} SELECT page_id, x AS y, 7 - y AS x, v FROM pixels")
def rotated_pages(spark, sf):
    return r.rotated(fx.vector_pixels(spark, sf), 90, 8, 8)


@reg.add(f"{V} SELECT page_id, y, x + CAST(round(0.25 * (y - 4)) AS INT) AS x, v FROM pixels WHERE x + CAST(round(0.25 * (y - 4)) AS INT) BETWEEN 0 AND 7")
def sheared_pages(spark, sf):
    x = F.col("x") + F.round(0.25 * (F.col("y") - 4)).cast("int")
    return fx.vector_pixels(spark, sf).withColumn("x", x).where("x between 0 and 7").select("page_id", "y", "x", "v")


@reg.add(f"""{V}, a AS (SELECT page_id, y, x FROM pixels WHERE black = 1), b AS (SELECT page_id, y, x FROM pixels WHERE v % 3 = 0)
 SELECT 'and' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'subtract', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
 UNION ALL SELECT 'xor', * FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) UNION ALL SELECT 'not', page_id, y, x FROM pixels WHERE black = 0""")
def raster_set_operations(spark, sf):
    p = fx.vector_pixels(spark, sf)
    # Both sides come from one relation, so membership is two flags of a pixel and no shuffle.
    a, b = F.col("black") == 1, F.col("v") % 3 == 0
    ops = {"and": a & b, "or": a | b, "subtract": a & ~b, "xor": a != b, "not": ~a}
    return p.select("page_id", "y", "x", F.explode(F.filter(F.array(*(F.when(c, k) for k, c in ops.items())), lambda o: o.isNotNull())).alias("op"))


@reg.add(f"{V}, o AS (SELECT page_id, y, x + 1 AS x, v AS w FROM pixels) SELECT page_id, y, x, least(v, w) AS low, greatest(v, w) AS high, least(v + w, 255) AS total, greatest(v - w, 0) AS rest FROM pixels JOIN o USING (page_id, y, x)")
def gray_raster_operations(spark, sf):
    p = fx.vector_pixels(spark, sf)
    w = F.lag("v").over(r.along("x"))
    p = p.withColumn("w", w).where("w is not null")
    return p.select("page_id", "y", "x", F.least("v", "w").alias("low"), F.greatest("v", "w").alias("high"), F.least(F.col("v") + F.col("w"), F.lit(255)).alias("total"), F.greatest(F.col("v") - F.col("w"), F.lit(0)).alias("rest"))


@reg.add(f"{C} SELECT page_id, y, x, (r * 11 + g * 16 + b * 5) // 32 AS gray, greatest(r, g, b) - least(r, g, b) >= 40 AND greatest(r, g, b) >= 60 AS coloured FROM colours")
def colour_to_gray(spark, sf):
    c = F.col
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return fx.colour_pixels(spark, sf).select("page_id", "y", "x", r.gray_of(c("r"), c("g"), c("b")).alias("gray"), ((most - least >= 40) & (most >= 60)).alias("coloured"))


@reg.add(f"""{V}, {HIST.format(t='pixels')}, k AS (SELECT *, sum(n) OVER (PARTITION BY page_id) AS total, coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
 coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM hist),
 e AS (SELECT page_id, min(v) FILTER (WHERE CAST(round(total * 0.05) AS BIGINT) - below < n) AS lo, max(v) FILTER (WHERE CAST(round(total * 0.05) AS BIGINT) - above < n) AS hi FROM k GROUP BY 1)
 SELECT page_id, y, x, CAST(CASE WHEN hi > lo THEN (255 * (least(greatest(v, lo), hi) - lo) + (hi - lo) // 2) // (hi - lo) WHEN v < (lo + hi) // 2 THEN 0 ELSE 255 END AS INT) AS v FROM pixels JOIN e USING (page_id)""")
def stretched_gray(spark, sf):
    return r.stretched(fx.vector_pixels(spark, sf), 0.05, 0.05)


@reg.add(f"""{C}, m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (r * 11 + g * 16 + b * 5) // 32 AS gray FROM colours)
 SELECT page_id, y, x, CASE WHEN gray = 0 THEN 1 WHEN gray = 255 THEN 254 ELSE gray END AS reserved, CASE WHEN hi - gray < 1 THEN 255 ELSE (255 * gray + hi // 2) // hi END AS raised, 255 - gray AS inverted, bit_count(gray) AS bits, round(gray + (hi - gray) * 0.25, 6) AS dimmed FROM m""")
def pixel_scalars(spark, sf):
    c = F.col
    p = fx.colour_pixels(spark, sf).select("page_id", "y", "x", F.greatest("r", "g", "b").alias("hi"), r.gray_of(c("r"), c("g"), c("b")).alias("gray"))
    return p.select("page_id", "y", "x", F.when(c("gray") == 0, 1).when(c("gray") == 255, 254).otherwise(c("gray")).alias("reserved"), F.when(c("hi") - c("gray") < 1, 255).otherwise(F.floor((255 * c("gray") + F.floor(c("hi") / 2)) / c("hi"))).cast("int").alias("raised"), (255 - c("gray")).alias("inverted"), F.bit_count("gray").alias("bits"), F.round(c("gray") + (c("hi") - c("gray")) * 0.25, 6).alias("dimmed"))


@reg.add(f"{V}, rows AS (SELECT page_id, y, sum(black) AS n FROM pixels GROUP BY 1, 2) SELECT page_id, sum(d * d) AS score FROM (SELECT page_id, n - lag(n) OVER (PARTITION BY page_id ORDER BY y) AS d FROM rows) GROUP BY 1")
def skew_score(spark, sf):
    rows = fx.vector_pixels(spark, sf).groupBy("page_id", "y").agg(F.sum("black").alias("n"))
    d = rows.select("page_id", (F.col("n") - F.lag("n").over(Window.partitionBy("page_id").orderBy("y"))).alias("d"))
    return d.groupBy("page_id").agg(F.sum(F.col("d") * F.col("d")).alias("score"))


@reg.add(f"{V}, t AS (SELECT page_id, x, min(y) AS y FROM pixels WHERE black = 1 GROUP BY 1, 2) SELECT page_id, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) + 0.0 AS intercept FROM t GROUP BY 1 HAVING count(*) >= 2")
def top_edge_fit(spark, sf):
    t = fx.vector_pixels(spark, sf).where("black = 1").groupBy("page_id", "x").agg(F.min("y").alias("y"))
    g = t.groupBy("page_id").agg((F.round(F.regr_slope("y", "x"), 6) + 0.0).alias("slope"), (F.round(F.regr_intercept("y", "x"), 6) + 0.0).alias("intercept"), F.count("*").alias("k"))
    return g.where("k >= 2").drop("k")


@reg.add(f"{V}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY v, y, x) - 1 AS i, count(*) OVER (PARTITION BY page_id) AS n FROM pixels) SELECT page_id, max(v) FILTER (WHERE i = n // 2) AS median, round(avg(v) FILTER (WHERE i >= n // 4 AND i < n - n // 4), 6) AS trimmed FROM o GROUP BY 1")
def upper_median_and_trimmed_mean(spark, sf):
    page = Window.partitionBy("page_id")
    o = fx.vector_pixels(spark, sf).withColumns({"i": F.row_number().over(page.orderBy("v", "y", "x")) - 1, "n": F.count("*").over(page)})
    quarter = F.floor(F.col("n") / 4)
    return o.groupBy("page_id").agg(F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("v"))).alias("median"), F.round(F.avg(F.when((F.col("i") >= quarter) & (F.col("i") < F.col("n") - quarter), F.col("v"))), 6).alias("trimmed"))


@reg.add(f"{V}, b AS (SELECT page_id, v // 16 AS bin, count(*) AS n FROM pixels GROUP BY 1, 2), p AS (SELECT page_id, n / sum(n) OVER (PARTITION BY page_id) AS p FROM b) SELECT page_id, round(-sum(p * log2(p)) / 4, 6) AS entropy FROM p GROUP BY 1")
def tone_entropy(spark, sf):
    b = fx.vector_pixels(spark, sf).groupBy("page_id", F.floor(F.col("v") / 16).alias("bin")).agg(F.count("*").alias("n"))
    p = b.select("page_id", (F.col("n") / F.sum("n").over(Window.partitionBy("page_id"))).alias("p"))
    return p.groupBy("page_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")) / 4, 6).alias("entropy"))


@reg.add(f"{V} SELECT page_id, y // 4 AS cy, x // 4 AS cx, sum(CASE WHEN v BETWEEN 64 AND 191 THEN 1 ELSE 0 END) AS midtones, avg(v) AS mean, max(v) - min(v) AS spread FROM pixels GROUP BY 1, 2, 3")
def cell_evidence(spark, sf):
    return fx.vector_pixels(spark, sf).groupBy("page_id", F.floor(F.col("y") / 4).alias("cy"), F.floor(F.col("x") / 4).alias("cx")).agg(F.count_if(F.col("v").between(64, 191)).alias("midtones"), F.avg("v").alias("mean"), (F.max("v") - F.min("v")).alias("spread"))


DENSE = "dense AS (SELECT page_id, list_transform(range(256), lambda i: coalesce(list_sum(list_filter(c, lambda s: s.v = i).list_transform(lambda s: s.n)), 0)) AS h FROM (SELECT page_id, list({'v': v, 'n': n}) AS c FROM hist GROUP BY 1))"


@reg.add(f"""{V}, {HIST.format(t='pixels')}, grid AS (SELECT page_id, g AS v FROM (SELECT DISTINCT page_id FROM pixels), range(256) t(g)), h AS (SELECT page_id, v, coalesce(n, 0) AS n FROM grid LEFT JOIN hist USING (page_id, v)),
 w AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY v ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM h), b AS (SELECT page_id, arg_max(v, s * 1000 - v) AS start, max(s) AS best FROM w WHERE v <= 246 GROUP BY 1),
 c AS (SELECT h.page_id, h.v, best, sum(n) OVER (PARTITION BY h.page_id ORDER BY h.v ROWS UNBOUNDED PRECEDING) AS run FROM h JOIN b ON b.page_id = h.page_id AND h.v BETWEEN start AND start + 9) SELECT page_id, CAST(min(v) AS INT) AS level FROM c WHERE run >= best // 2 GROUP BY 1""")
def dominant_levels(spark, sf):
    return r.dense_histogram(fx.vector_pixels(spark, sf)).select("page_id", r.dominant_level(F.col("h")).cast("int").alias("level"))


@reg.add(None)
def peak_thresholds(spark, sf):
    return r.dense_histogram(fx.text_pixels(spark, sf)).select("page_id", r.peak_threshold(F.col("h")).alias("threshold"))


@reg.add(f"{V}, e AS (SELECT page_id, x, y, (y * 0.5 + 3) AS edge FROM pixels) SELECT page_id, y, x, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN 1 ELSE black END AS filled, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN black ELSE 0 END AS outside_cleared, CASE WHEN (x < 1 OR x > 6 OR y < 1 OR y > 6) THEN 0 ELSE black END AS framed, (1 - black) * 255 AS gray, x < edge AS left_of FROM pixels JOIN e USING (page_id, x, y)")
def rectangle_fills(spark, sf):
    c = F.col
    inside = c("x").between(2, 5) & c("y").between(2, 5)
    ring = (c("x") < 1) | (c("x") > 6) | (c("y") < 1) | (c("y") > 6)
    return fx.vector_pixels(spark, sf).select("page_id", "y", "x", F.when(inside, 1).otherwise(c("black")).alias("filled"), F.when(inside, c("black")).otherwise(0).alias("outside_cleared"), F.when(ring, 0).otherwise(c("black")).alias("framed"), ((1 - c("black")) * 255).alias("gray"), (c("x") < c("y") * 0.5 + 3).alias("left_of"))


@reg.add(f"{V} SELECT page_id, y, count(DISTINCT black) = 1 AS monotone FROM pixels GROUP BY 1, 2")
def monotone_lines(spark, sf):
    return fx.vector_pixels(spark, sf).groupBy("page_id", "y").agg((F.min("black") == F.max("black")).alias("monotone"))


@reg.add(f"{V}, {STATS}, w AS (SELECT *, sd * sd AS var FROM stats) SELECT page_id, y, x, CAST(least(greatest(floor(CASE WHEN var > 1e-6 THEN mean + (v - mean) * greatest(0, var - 400) / var ELSE mean END + 1e-9), 0), 255) AS INT) AS v FROM w")
def wiener_filtered(spark, sf):
    var = F.col("sd") * F.col("sd")
    v = F.when(var > 1e-6, F.col("mean") + (F.col("v") - F.col("mean")) * F.greatest(F.lit(0.0), var - 400) / var).otherwise(F.col("mean"))
    return stats(spark, sf).select("page_id", "y", "x", r.clamp_byte(F.floor(v + 1e-9)).alias("v"))


@reg.add(f"{V}, s AS (SELECT page_id, y, x, v, 3 + 0.5 * x + 0.25 * y + 0.125 * x * y AS surface FROM pixels) SELECT page_id, y, x, round(surface, 6) AS surface, CAST(least(greatest(round(v - surface), 0), 255) AS INT) AS flat FROM s")
def polynomial_surface(spark, sf):
    s = 3 + 0.5 * F.col("x") + 0.25 * F.col("y") + 0.125 * F.col("x") * F.col("y")
    return fx.vector_pixels(spark, sf).select("page_id", "y", "x", F.round(s, 6).alias("surface"), r.clamp_byte(F.round(F.col("v") - s)).alias("flat"))


@reg.add(f"""{V}, ink AS (SELECT page_id, x, y FROM pixels WHERE black = 1), col AS (SELECT p.page_id, p.x, p.y, min((p.y - i.y) * (p.y - i.y)) AS d FROM pixels p JOIN ink i ON i.page_id = p.page_id AND i.x = p.x GROUP BY 1, 2, 3)
 SELECT p.page_id, p.y, p.x, min(c.d + (p.x - c.x) * (p.x - c.x)) AS squared FROM pixels p JOIN col c ON c.page_id = p.page_id AND c.y = p.y GROUP BY 1, 2, 3""")
def squared_distances(spark, sf):
    return k.map_pages(fx.vector_pages(spark, sf), lambda b: k.nearest(b)[0], "black", "squared", "long", where=np.isfinite)
