"""Queries on colours, tones, further thresholds, zones and geometry, with the SQL they are compared with."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window, functions as F

from leafmill.functions import colour as co
from leafmill.operators import binarize as bz, kernels as k, raster as r
from leafmill.plans import fixtures as fx
from leafmill.plans.raster_queries import C, HIST, OTSU, STATS, V, box, stats
from leafmill.plans.registry import Registry

reg = Registry()
G = "(r * 11 + g * 16 + b * 5) // 32"
LAB = """WITH RECURSIVE {c}, lin AS (SELECT page_id, y, x, {r} AS lr, {g} AS lg, {b} AS lb FROM colours), xyz AS (SELECT page_id, y, x, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS fx, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS fy, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS fz FROM lin),
 f AS (SELECT page_id, y, x, {x} AS fx, {yy} AS fy, {z} AS fz FROM xyz) SELECT page_id, y, x, round(116 * fy - 16, 4) + 0.0 AS l, round(500 * (fx - fy), 4) + 0.0 AS a, round(200 * (fy - fz), 4) + 0.0 AS b FROM f"""
_lin = lambda c: f"CASE WHEN {c} <= 10 THEN {c} / 255.0::DOUBLE / 12.92 ELSE power(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_cbrt = lambda c: f"CASE WHEN {c} > 0.008856 THEN power({c}, 1.0::DOUBLE / 3) ELSE 7.787 * {c} + 16.0::DOUBLE / 116 END"


@reg.add(LAB.format(c=fx.COLOUR_PIXELS, r=_lin("r"), g=_lin("g"), b=_lin("b"), x=_cbrt("fx"), yy=_cbrt("fy"), z=_cbrt("fz")))
def lab_colours(spark, sf):
    lab = co.to_lab(F.col("r"), F.col("g"), F.col("b"))
    return fx.colour_pixels(spark, sf).select("page_id", "y", "x", *((F.round(c, 4) + 0.0).alias(n) for n, c in zip("lab", lab, strict=True)))


@reg.add(f"""{C}, bright AS (SELECT *, {G} AS gray FROM colours WHERE {G} >= 96), ranked AS (SELECT *, ntile(4) OVER (PARTITION BY page_id ORDER BY gray DESC, y, x) AS q FROM bright), top AS (SELECT * FROM ranked WHERE q = 1),
 med AS (SELECT page_id, quantile_disc(r, 0.5) AS pr, quantile_disc(g, 0.5) AS pg, quantile_disc(b, 0.5) AS pb FROM top GROUP BY 1) SELECT * FROM med WHERE least(pr, pg, pb) >= 60""")
def paper_colours(spark, sf):
    return co.paper_colour(fx.colour_pixels(spark, sf), 96, 60)


@reg.add(f"""{C}, p AS (SELECT page_id, max(r) AS pr, max(g) AS pg, max(b) AS pb FROM colours GROUP BY 1) SELECT page_id, y, x, CAST(least(round(r * 255.0::DOUBLE / greatest(pr, 1)), 255) AS INT) AS r, CAST(least(round(g * 255.0::DOUBLE / greatest(pg, 1)), 255) AS INT) AS g, CAST(least(round(b * 255.0::DOUBLE / greatest(pb, 1)), 255) AS INT) AS b FROM colours JOIN p USING (page_id)""")
def white_balanced(spark, sf):
    page = Window.partitionBy("page_id")
    to = lambda c: F.least(F.round(F.col(c) * 255.0 / F.greatest(F.max(c).over(page), F.lit(1))), F.lit(255)).cast("int").alias(c)
    return fx.colour_pixels(spark, sf).select("page_id", "y", "x", to("r"), to("g"), to("b"))


@reg.add(f"""{C} SELECT page_id, y, x, round(r + (b - r) * 0.3, 6) AS between, round(CASE WHEN g <= 64 THEN 0 WHEN g >= 192 THEN 1 ELSE ((g - 64) / 128.0::DOUBLE) * ((g - 64) / 128.0::DOUBLE) * (3 - 2 * ((g - 64) / 128.0::DOUBLE)) END, 6) AS smooth, CAST(least(greatest(round(r + 0.5 * (g - {G})), 0), 255) AS INT) AS brighter FROM colours""")
def colour_scalars(spark, sf):
    c = F.col
    gray = r.gray_of(c("r"), c("g"), c("b"))
    return fx.colour_pixels(spark, sf).select("page_id", "y", "x", F.round(co.between(c("r"), c("b"), 0.3), 6).alias("between"), F.round(co.smoothstep(64, 192, c("g")), 6).alias("smooth"), r.clamp_byte(F.round(c("r") + 0.5 * (c("g") - gray))).alias("brighter"))


@reg.add(f"""{V}, {STATS}, e AS (SELECT *, 0.5 * v * ((v + 1) / (mean + 1) - 0.5) + 0.5 * v AS r1 FROM stats), d AS (SELECT *, 0.5 * ((mean + 1) / (r1 + 1) - 0.5) + 0.5 AS q FROM e),
 o AS (SELECT page_id, y, x, CAST(floor(least(greatest(CASE WHEN q > 0 THEN r1 / q ELSE r1 END, 0), 255) + 1e-9) AS INT) AS v FROM d), {HIST.format(t='o')}, {OTSU} SELECT page_id, threshold FROM otsu""")
def binarize_edge_div(spark, sf):
    return r.otsu(bz.edge_divided(stats(spark, sf), 0.5, 0.5)).select("page_id", "threshold")


@reg.add(f"""{V}, {box('min', 'v', (-2, 2), (-2, 2), 'd', 'pixels', 'dark')}, i AS (SELECT page_id, dark, v, count(*) AS c FROM d WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AND v - dark >= 20 GROUP BY 1, 2, 3),
 t AS (SELECT page_id, CAST(floor(0.5 * sum((dark + v) * c) / sum(c) + 0.5) AS INT) AS threshold FROM i GROUP BY 1) SELECT p.page_id, coalesce(threshold, 128) AS threshold FROM (SELECT DISTINCT page_id FROM pixels) p LEFT JOIN t USING (page_id)""")
def mokji_thresholds(spark, sf):
    return bz.mokji(fx.vector_pixels(spark, sf), 2, 20)


@reg.add(f"""{V}, {HIST.format(t='pixels')}, {OTSU} SELECT page_id, 2 * sum(CASE WHEN v < threshold THEN 1 ELSE 0 END) <= count(*) AS black_on_white FROM pixels JOIN otsu USING (page_id) GROUP BY 1""")
def black_on_white(spark, sf):
    p = fx.vector_pixels(spark, sf)
    return r.threshold(p, r.otsu(p)).groupBy("page_id").agg((2 * F.sum("black") <= F.count("*")).alias("black_on_white"))


@reg.add(f"""{V}, ink AS (SELECT page_id, x, y FROM pixels WHERE black = 1), bins AS (SELECT unnest(range(12)) AS a), votes AS (SELECT page_id, a, CAST(round(x * cos(pi() * a / 12) + y * sin(pi() * a / 12)) AS INT) AS d, count(*) AS n FROM ink, bins GROUP BY ALL)
 SELECT page_id, a, d, n FROM votes QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, a, d) <= 3""")
def line_votes(spark, sf):
    ink = fx.vector_pixels(spark, sf).where("black = 1")
    # Each pixel votes once an angle; the angles are a dozen literals.
    d = F.array(*(F.round(F.col("x") * math.cos(math.pi * a / 12) + F.col("y") * math.sin(math.pi * a / 12)).cast("int") for a in range(12)))
    votes = ink.select("page_id", F.posexplode(d).alias("a", "d")).groupBy("page_id", "a", "d").agg(F.count("*").alias("n"))
    return votes.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("n").desc(), "a", "d"))).where("k <= 3").drop("k")


@reg.add(f"""{V}, ink AS (SELECT page_id, x, y FROM pixels WHERE black = 1), col AS (SELECT p.page_id, p.x, p.y, min((p.y - i.y) * (p.y - i.y)) AS d FROM pixels p JOIN ink i ON i.page_id = p.page_id AND i.x = p.x GROUP BY 1, 2, 3),
 sq AS (SELECT p.page_id, p.y, p.x, min(c.d + (p.x - c.x) * (p.x - c.x)) AS squared FROM pixels p JOIN col c ON c.page_id = p.page_id AND c.y = p.y GROUP BY 1, 2, 3), {box('max', 'squared', (-1, 1), (-1, 1), 'm', 'sq', 'most')} SELECT page_id, y, x, squared FROM m WHERE squared = most AND squared > 0""")
def distance_peaks(spark, sf):
    d = bz.squared_distances(fx.vector_pixels(spark, sf))
    return r.frame(F.max, "squared", "most", (-1, 1), (-1, 1), d).where("squared = most and squared > 0").select("page_id", "y", "x", "squared")


@reg.add(f"""{V}, {HIST.format(t='pixels')} SELECT page_id, y, x, CASE WHEN x BETWEEN 2 AND 4 AND y BETWEEN 1 AND 3 THEN 0 WHEN x BETWEEN 3 AND 6 AND y BETWEEN 2 AND 6 THEN 1 WHEN x + y < 3 THEN 0 ELSE black END AS mask FROM pixels""")
def zone_layers(spark, sf):
    """Picture zones in their order: erasers first, then foreground, then erasers on top."""
    x, y = F.col("x"), F.col("y")
    first, paint, last = x.between(2, 4) & y.between(1, 3), x.between(3, 6) & y.between(2, 6), x + y < 3
    mask = F.when(first, 0).when(paint, 1).when(last, 0).otherwise(F.col("black"))
    return fx.vector_pixels(spark, sf).select("page_id", "y", "x", mask.alias("mask"))


@reg.add(f"""{V}, o AS (SELECT page_id, y + 2 AS y, x + 3 AS x, v AS w FROM pixels WHERE y < 4 AND x < 4) SELECT page_id, y, x, coalesce(w, v) AS v FROM pixels LEFT JOIN o USING (page_id, y, x)""")
def pasted(spark, sf):
    p = fx.vector_pixels(spark, sf)
    w = F.when((F.col("y").between(2, 5)) & F.col("x").between(3, 6), F.lag("__up", 3).over(r.along("x")))
    p = p.withColumn("__up", F.lag("v", 2).over(r.along("y")))
    return p.withColumn("w", w).select("page_id", "y", "x", F.coalesce("w", "v").alias("v"))


@reg.add(f"""{V}, g AS (SELECT page_id, y // 2 AS y, x // 2 AS x, sum(v) AS s FROM pixels GROUP BY 1, 2, 3) SELECT page_id, y, x, CAST((s + 2) // 4 AS INT) AS v FROM g""")
def scaled_to_half(spark, sf):
    return r.block_mean(fx.vector_pixels(spark, sf), 2)


@reg.add(f"WITH {fx.IMAGES} SELECT image_id, CASE WHEN image_id % 4 IN (1, 3) THEN height ELSE width END AS width, CASE WHEN image_id % 4 IN (1, 3) THEN width ELSE height END AS height, round(width * 25.4::DOUBLE / greatest(dpi_x, 1), 6) AS width_mm, round(sqrt(CAST(width AS DOUBLE) * width + CAST(height AS DOUBLE) * height), 4) AS diagonal FROM images")
def turned_sizes(spark, sf):
    turned = (F.col("image_id") % 4).isin(1, 3)
    w, h = F.col("width"), F.col("height")
    return fx.images(spark, sf).select("image_id", F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"), F.round(w * 25.4 / F.greatest("dpi_x", F.lit(1)), 6).alias("width_mm"), F.round(F.sqrt(w.cast("double") * w + h.cast("double") * h), 4).alias("diagonal"))


@reg.add(f"""WITH {fx.IMAGES}, t AS (SELECT image_id, 300.0::DOUBLE / greatest(dpi_x, 50) AS sx, 300.0::DOUBLE / greatest(dpi_y, 50) AS sy, image_id % 4 AS q, width AS w, height AS h FROM images)
 SELECT image_id, round(CASE q WHEN 0 THEN 10 * sx WHEN 1 THEN (h - 20) * sy WHEN 2 THEN (w - 10) * sx ELSE 20 * sy END, 6) AS x, round(CASE q WHEN 0 THEN 20 * sy WHEN 1 THEN 10 * sx WHEN 2 THEN (h - 20) * sy ELSE (w - 10) * sx END, 6) AS y FROM t""")
def transformed_points(spark, sf):
    """Pre-scale to 300 dpi, then quarter turns, of the point (10, 20) of each image."""
    sx, sy = 300.0 / F.greatest("dpi_x", F.lit(50)), 300.0 / F.greatest("dpi_y", F.lit(50))
    q, w, h = F.col("image_id") % 4, F.col("width"), F.col("height")
    x = F.when(q == 0, 10 * sx).when(q == 1, (h - 20) * sy).when(q == 2, (w - 10) * sx).otherwise(20 * sy)
    y = F.when(q == 0, 20 * sy).when(q == 1, 10 * sx).when(q == 2, (h - 20) * sy).otherwise((w - 10) * sx)
    return fx.images(spark, sf).select("image_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@reg.add(f"""WITH {fx.IMAGES} SELECT image_id, CASE image_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END | CASE WHEN image_id % 3 = 2 AND owner % 2 = 0 THEN 4 ELSE 0 END | CASE WHEN image_id % 3 = 2 AND owner % 2 = 0 AND owner % 3 = 0 THEN 8 ELSE 0 END AS flags FROM images""")
def render_flags(spark, sf):
    """Bits: 1 binarise, 2 mixed or colour, 4 split output, 8 keep the original background."""
    q, o = F.col("image_id") % 3, F.col("owner")
    split = (q == 2) & (o % 2 == 0)
    flags = F.when(q == 0, 1).when(q == 1, 2).otherwise(3).bitwiseOR(F.when(split, 4).otherwise(0)).bitwiseOR(F.when(split & (o % 3 == 0), 8).otherwise(0))
    return fx.images(spark, sf).select("image_id", flags.alias("flags"))


@reg.add("""WITH p AS (SELECT l_orderkey AS image_id, l_linenumber AS page_no, l_partkey, CASE WHEN l_returnflag = 'R' THEN l_tax END AS angle, CASE WHEN l_returnflag = 'A' THEN l_discount END AS oblique FROM lineitem),
 c AS (SELECT l_orderkey AS image_id, max(l_tax) AS angle, max(l_discount) AS oblique FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT p.image_id, page_no, l_partkey, coalesce(p.angle, c.angle, 0) AS angle, coalesce(p.oblique, c.oblique, 0) AS oblique FROM p LEFT JOIN c USING (image_id)""")
def merged_angles(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    p = li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("page_no"), "l_partkey", F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("angle"), F.when(F.col("l_returnflag") == "A", F.col("l_discount")).alias("oblique"))
    c = li.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.max("l_tax").alias("a"), F.max("l_discount").alias("o"))
    return p.join(c, "image_id", "left").select("image_id", "page_no", "l_partkey", F.coalesce("angle", "a", F.lit(0.0)).alias("angle"), F.coalesce("oblique", "o", F.lit(0.0)).alias("oblique"))


@reg.add(f"""WITH {fx.IMAGES}, s AS (SELECT image_id, regexp_extract(file_name, '^([^.]*)', 1) AS stem, unnest(['left', 'right']) AS side FROM images WHERE sub_pages = 2) SELECT image_id, stem || CASE side WHEN 'left' THEN '_1L' ELSE '_2R' END || '.tif' AS old_name, stem || CASE side WHEN 'left' THEN '_2L' ELSE '_1R' END || '.tif' AS new_name FROM s""")
def renamed_outputs(spark, sf):
    stem = F.regexp_extract("file_name", r"^([^.]*)", 1)
    s = fx.images(spark, sf).where("sub_pages = 2").select("image_id", stem.alias("stem"), F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    left = F.col("side") == "left"
    return s.select("image_id", F.concat("stem", F.when(left, "_1L").otherwise("_2R"), F.lit(".tif")).alias("old_name"), F.concat("stem", F.when(left, "_2L").otherwise("_1R"), F.lit(".tif")).alias("new_name"))


@reg.add("""WITH p AS (SELECT user_id, ts, event_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events), s AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 l AS (SELECT user_id, (x + x0) / 2.0::DOUBLE AS mx, (y + y0) / 2.0::DOUBLE AS my, sqrt(1 + (y - y0) * (y - y0)) AS len FROM s WHERE x0 IS NOT NULL) SELECT user_id, round(sum(mx * len) / sum(len), 5) AS cx, round(sum(my * len) / sum(len), 5) AS cy FROM l GROUP BY 1""")
def polyline_centroids(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = fx.table(spark, sf, "events").withColumns({"x": F.row_number().over(w), "y": F.col("value")})
    s = p.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w)}).where("x0 is not null")
    length = F.sqrt(1 + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0")))
    mean = lambda a, b: F.round(F.sum((F.col(a) + F.col(b)) / 2.0 * length) / F.sum(length), 5)
    return s.groupBy("user_id").agg(mean("x", "x0").alias("cx"), mean("y", "y0").alias("cy"))


@reg.add("""SELECT l_orderkey AS image_id, l_linenumber AS page_no, i, CAST(round(l_quantity + (l_partkey % 20) * i / 4.0) AS BIGINT) AS x, CAST(round(l_suppkey % 30 * i / 4.0) AS BIGINT) AS y FROM lineitem, range(5) t(i) WHERE l_linenumber = 3""")
def line_cells(spark, sf):
    li = fx.table(spark, sf, "lineitem").where("l_linenumber = 3").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("page_no"), "i", F.round(F.col("l_quantity") + F.col("l_partkey") % 20 * F.col("i") / 4.0).cast("long").alias("x"), F.round(F.col("l_suppkey") % 30 * F.col("i") / 4.0).cast("long").alias("y"))


@reg.add(None)
def page_palettes(spark, sf):
    """Four mean grays of each page, from its histogram."""
    def palette(a: np.ndarray) -> list[int]:
        tones, counts = np.unique(a, return_counts=True)
        return sorted(int(m[0] + 0.5) for m in k.colour_means(tones[:, None].astype(float), counts, 4))

    return k.map_values(fx.vector_pages(spark, sf), palette, "v", "palette", "array<int>")


@reg.add(None)
def ink_hulls(spark, sf):
    """Corners of the hull of each page's black pixels."""
    return k.map_values(fx.vector_pages(spark, sf), lambda b: k.convex_hull(np.argwhere(b > 0)[:, ::-1]).tolist() if b.any() else [], "black", "hull", "array<array<int>>")


@reg.add(None)
def line_peaks(spark, sf):
    """Best lines of each page with no better one beside them: angle bin, distance, votes."""
    return k.map_values(fx.vector_pages(spark, sf), lambda b: [list(p) for p in k.hough_peaks(b)], "black", "lines", "array<array<int>>")
