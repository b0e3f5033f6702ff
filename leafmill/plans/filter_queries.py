"""Queries over tones and colours of pages, and patterns replaced in them, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from leafmill.operators import kernels as k, raster as r, tones as t
from leafmill.plans import fixtures as fx
from leafmill.plans.raster_queries import HIST, STATS, box, stats
from leafmill.plans.registry import Registry

reg = Registry()
V, C = f"WITH {fx.VECTOR_PIXELS}", f"WITH {fx.COLOUR_PIXELS}"
TONE = {"exposure": 0.3, "contrast": 20, "highlights": -15, "shadows": 25, "whites": 5, "blacks": -5}
#: The formula of tones written out, for a column x from 0 to 1.
SMOOTH = "(least(greatest(({x} - {a}) / ({b} - {a}), 0), 1) * least(greatest(({x} - {a}) / ({b} - {a}), 0), 1) * (3 - 2 * least(greatest(({x} - {a}) / ({b} - {a}), 0), 1)))"
TONE_STEPS = f"""t0 AS (SELECT i, i / 255.0::DOUBLE AS x FROM range(256) r(i)), t1 AS (SELECT i, x * pow(2.0::DOUBLE, 0.3) AS x FROM t0), t2 AS (SELECT i, 0.5 + (x - 0.5) * pow(2.0::DOUBLE, 20 / 100.0 * 1.3) AS x FROM t1),
t3 AS (SELECT i, x + -15 / 100.0::DOUBLE * 0.40 * {SMOOTH.format(x='x', a='0.25', b='1.0')} AS x FROM t2), t4 AS (SELECT i, x + 25 / 100.0::DOUBLE * 0.40 * (1 - {SMOOTH.format(x='x', a='0.0', b='0.75')}) AS x FROM t3),
t5 AS (SELECT i, x + (1 - x) * (5 / 100.0::DOUBLE * 0.25) * {SMOOTH.format(x='x', a='0.5', b='1.0')} AS x FROM t4), t6 AS (SELECT i, greatest(0, x + -0.0125::DOUBLE) / (1 - 0.0125::DOUBLE) AS x FROM t5),
tone AS (SELECT i AS v, CAST(least(greatest(floor(x * 255 + 0.5), 0), 255) AS INT) AS tone FROM t6)"""


@reg.add(f"{V}, {TONE_STEPS} SELECT page_id, y, x, tone FROM pixels JOIN tone USING (v)")
def tone_adjusted(spark, sf):
    """Tones after exposure, contrast, highlights, shadows, whites and blacks."""
    return fx.vector_pixels(spark, sf).select("page_id", "y", "x", t.half_up(t.adjusted(F.col("v") / 255.0, **TONE) * 255).alias("tone"))


@reg.add(f"""{C}, {TONE_STEPS}, j AS (SELECT page_id, y, x, r, g, b, tr.tone AS r1, tg.tone AS g1, tb.tone AS b1 FROM colours JOIN tone tr ON tr.v = r JOIN tone tg ON tg.v = g JOIN tone tb ON tb.v = b)
 SELECT page_id, y, x, CASE WHEN w THEN r ELSE CAST(least(floor(r1 * (1 + 0.2 * 0.3) + 0.5), 255) AS INT) END AS r, CASE WHEN w THEN g ELSE CAST(least(floor(g1 * (1 + 0.1 * 0.3) + 0.5), 255) AS INT) END AS g, CASE WHEN w THEN b ELSE CAST(least(floor(b1 * (1 - 0.2 * 0.3) + 0.5), 255) AS INT) END AS b
 FROM (SELECT *, r = 255 AND g = 255 AND b = 255 AS w FROM j)""")
def photo_adjusted(spark, sf):
    """Colours after the same tones, 20 warmer and 10 greener; pure white stays."""
    white = (F.col("r") == 255) & (F.col("g") == 255) & (F.col("b") == 255)
    made = [F.when(white, F.col(c)).otherwise(t.photo_adjusted(F.col(c), TONE, 20, -10, name)).alias(c) for c, name in (("r", "red"), ("g", "green"), ("b", "blue"))]
    return fx.colour_pixels(spark, sf).select("page_id", "y", "x", *made)


POSTER = """p AS (SELECT *, sum(n) OVER (PARTITION BY page_id) AS total FROM hist), q AS (SELECT *, min(CASE WHEN n >= 0.0005 * total THEN v END) OVER (PARTITION BY page_id) AS lo, max(CASE WHEN n >= 0.0005 * total THEN v END) OVER (PARTITION BY page_id) AS hi FROM p),
s AS (SELECT *, CASE WHEN v IN (0, 255) OR hi <= lo THEN v ELSE CAST(floor(least(greatest((v - lo) / CAST(hi - lo AS DOUBLE) * 255, 0), 255) + 0.5) AS INT) END AS spread FROM q),
g AS (SELECT *, floor(spread / (255.0::DOUBLE / 5)) AS grp FROM s), b AS (SELECT page_id, grp, arg_max(v, n * 1000 - v) AS own, arg_max(spread, n * 1000 - v) AS even FROM g GROUP BY 1, 2),
m AS (SELECT page_id, v, own, even FROM g JOIN b USING (page_id, grp))"""


@reg.add(f"{V}, {HIST.format(t='pixels')}, {POSTER} SELECT page_id, y, x, own AS v FROM pixels JOIN m USING (page_id, v)")
def posterized(spark, sf):
    """Tones merged into five groups of each page's range, as the commonest of each."""
    return t.posterized(fx.vector_pixels(spark, sf), 5)


@reg.add(f"{V}, {HIST.format(t='pixels')}, {POSTER} SELECT page_id, y, x, even AS v FROM pixels JOIN m USING (page_id, v)")
def posterized_evenly(spark, sf):
    return t.posterized(fx.vector_pixels(spark, sf), 5, normalize=True)


@reg.add(f"""{V}, {STATS}, m AS (SELECT *, floor(least(greatest(mean + 0.5, 0), 255)) AS gm FROM stats), th AS (SELECT *, floor(least(greatest(gm * (1 - 0.3 * (0.5 * (1 - ((v - gm) / (256 - (v - gm)) + 0.0::DOUBLE / 128)))), 0), 255)) AS t FROM m)
 SELECT page_id, sum(CASE WHEN v < t THEN 1 ELSE 0 END) AS black, round(avg(t), 8) AS level FROM th GROUP BY 1""")
def binarize_singh(spark, sf):
    th = stats(spark, sf).withColumn("t", t.singh(0.3))
    return th.groupBy("page_id").agg(F.sum(F.when(F.col("v") < F.col("t"), 1).otherwise(0)).alias("black"), F.round(F.avg("t"), 8).alias("level"))


@reg.add(f"""{C}, n AS (SELECT *, 255 - (r * 11 + g * 16 + b * 5) // 32 AS y2 FROM colours), l AS (SELECT *, 0.299::DOUBLE * r + (1 - 0.299::DOUBLE - 0.114::DOUBLE) * g + 0.114::DOUBLE * b AS luma FROM n),
 d AS (SELECT *, y2 + (r - luma) AS r2, y2 + (b - luma) AS b2 FROM l) SELECT page_id, y, x, CAST(least(greatest(trunc(r2 + 0.5), 0), 255) AS INT) AS r, CAST(least(greatest(trunc((y2 - r2 * 0.299::DOUBLE - b2 * 0.114::DOUBLE) / (1 - 0.299::DOUBLE - 0.114::DOUBLE) + 0.5), 0), 255) AS INT) AS g, CAST(least(greatest(trunc(b2 + 0.5), 0), 255) AS INT) AS b FROM d""")
def brightness_replaced(spark, sf):
    """Colours of pages with the inverse of their gray as brightness."""
    c = fx.colour_pixels(spark, sf).withColumn("gray", 255 - r.gray_of(F.col("r"), F.col("g"), F.col("b")))
    made = t.with_brightness(F.col("r").cast("double"), F.col("g").cast("double"), F.col("b").cast("double"), F.col("gray"))
    return c.select("page_id", "y", "x", *(m.alias(n) for m, n in zip(made, "rgb", strict=True)))


GRAY_STATS = """src AS (SELECT page_id, y, x, (r * 11 + g * 16 + b * 5) // 32 AS v, r, g, b FROM colours), s0 AS (SELECT *, CAST(v AS BIGINT) AS v1, CAST(v * v AS BIGINT) AS v2, CAST(1 AS BIGINT) AS one FROM src), """ + ", ".join(
    (box("sum", "v1", r.reach(5), r.reach(3), "b1", "s0", "s"), box("sum", "v2", r.reach(5), r.reach(3), "b2", "b1", "sq"), box("sum", "one", r.reach(5), r.reach(3), "b3", "b2", "n"))
)


@reg.add(f"""{C}, {GRAY_STATS}, w AS (SELECT *, s * (1.0::DOUBLE / n) AS mean, sq * (1.0::DOUBLE / n) - (s * (1.0::DOUBLE / n)) * (s * (1.0::DOUBLE / n)) AS var FROM b3),
 f AS (SELECT *, CASE WHEN var > 1e-6 THEN floor(least(greatest(mean + (v - mean) * greatest(var - 400.0, 0) / var, 0), 255) + 1e-9) ELSE v END AS w2 FROM w), c AS (SELECT *, (w2 + 1.0::DOUBLE) / (v + 1.0::DOUBLE) AS k FROM f)
 SELECT page_id, y, x, CAST(floor(least(greatest(r * k + w2 - v * k, 0), 255) + 0.5) AS INT) AS r, CAST(floor(least(greatest(g * k + w2 - v * k, 0), 255) + 0.5) AS INT) AS g, CAST(floor(least(greatest(b * k + w2 - v * k, 0), 255) + 0.5) AS INT) AS b FROM c""")
def wiener_colours(spark, sf):
    """Colours scaled as a Wiener filter against noise of 20 tones scales their gray."""
    c = fx.colour_pixels(spark, sf).withColumn("v", r.gray_of(F.col("r"), F.col("g"), F.col("b")))
    s = r.local_stats(c, 5, 3)
    # The variance comes anew from the sums' mean square, so it isn't rooted and squared.
    var = F.col("sd") * F.col("sd")
    share = F.greatest(var - 400.0, F.lit(0.0)) / var
    filtered = F.when(var > 1e-6, F.floor(F.least(F.greatest(F.col("mean") + (F.col("v") - F.col("mean")) * share, F.lit(0.0)), F.lit(255.0)) + 1e-9)).otherwise(F.col("v"))
    s = s.withColumn("w2", filtered)
    return s.select("page_id", "y", "x", *(t.scaled_colour(F.col(n), F.col("v"), F.col("w2")).alias(n) for n in "rgb"))


@reg.add("SELECT vec_id AS page_id, y, x, CASE WHEN y = 0 OR x = 0 OR y = h - 1 OR x = w - 1 THEN 40 ELSE 200 END AS v FROM (SELECT vec_id, 2 + vec_id % 5 AS w, 1 + vec_id % 4 AS h FROM embeddings), range(0, 8) a(y), range(0, 8) b(x) WHERE y < h AND x < w")
def framed_pages(spark, sf):
    """Pages of one tone with a frame of another."""
    k1 = F.col("vec_id")
    e = fx.table(spark, sf, "embeddings").select(k1.alias("page_id"), (2 + k1 % 5).cast("int").alias("w"), (1 + k1 % 4).cast("int").alias("h"))
    p = e.select("page_id", "w", F.posexplode(t.framed(F.col("w"), F.col("h"), 200, 40)).alias("i", "v"))
    return p.select("page_id", F.floor(F.col("i") / F.col("w")).alias("y"), (F.col("i") % F.col("w")).alias("x"), "v")


@reg.add(f"{V} SELECT page_id, y, x, (1 - black) * 255 AS v FROM pixels")
def mono_to_gray(spark, sf):
    return fx.vector_pixels(spark, sf).select("page_id", "y", "x", ((1 - F.col("black")) * 255).alias("v"))


PATTERN = ["XXX", "X+X", "?? "]


@reg.add(f"""{V}, o AS (SELECT p.page_id, p.y, p.x, p.black, d.dy, d.dx, d.want FROM pixels p, (VALUES (-1, -1, 1), (-1, 0, 1), (-1, 1, 1), (0, -1, 1), (0, 0, 0), (0, 1, 1), (1, 1, 0)) d(dy, dx, want)),
 m AS (SELECT o.page_id, o.y, o.x, any_value(o.black) AS black, bool_and(coalesce(q.black, 0) = o.want) AS hit FROM o LEFT JOIN pixels q ON q.page_id = o.page_id AND q.y = o.y + o.dy AND q.x = o.x + o.dx GROUP BY 1, 2, 3)
 SELECT page_id, y, x, CASE WHEN hit THEN 1 ELSE black END AS black FROM m""")
def pattern_replaced(spark, sf):
    """White pixels that black ones hold from three sides filled."""
    return k.map_pages(fx.vector_pages(spark, sf), lambda b: k.hit_miss_replace(b, PATTERN), "black", "black")


def replaced_sql(source: str, pattern: list[str], name: str) -> str:
    """Two tables, of which `name` is source (page_id, y, x, black) after a pattern whose replaced cell is one + in it."""
    cells = [(i, j, c) for i, row in enumerate(pattern) for j, c in enumerate(row) if c != "?"]
    y, x = next((i, j) for i, j, c in cells if c == "+")
    wants = ", ".join(f"({i - y}, {j - x}, {1 if c == 'X' else 0})" for i, j, c in cells)
    return f"""{name}_m AS (SELECT p.page_id, p.y, p.x, any_value(p.black) AS black, bool_and(coalesce(q.black, 0) = d.want) AS hit FROM {source} p CROSS JOIN (VALUES {wants}) d(dy, dx, want) LEFT JOIN {source} q ON q.page_id = p.page_id AND q.y = p.y + d.dy AND q.x = p.x + d.dx GROUP BY 1, 2, 3),
{name} AS (SELECT page_id, y, x, CASE WHEN hit THEN 1 ELSE black END AS black FROM {name}_m)"""


WAYS = [PATTERN, ["?XX", "?+X", " XX"], [" ??", "X+X", "XXX"], ["XX ", "X+?", "XX?"]]


@reg.add(f"{V}, " + ", ".join(replaced_sql("pixels" if i == 0 else f"w{i - 1}", way, f"w{i}") for i, way in enumerate(WAYS)) + " SELECT page_id, y, x, black FROM w3")
def pattern_replaced_all_ways(spark, sf):
    """The same from all four sides, one after the other."""
    return k.map_pages(fx.vector_pages(spark, sf), lambda b: k.hit_miss_all_ways(b, PATTERN), "black", "black")


LABELS = """ink AS (SELECT page_id, y, x, v FROM pixels WHERE black = 1),
reach AS (SELECT page_id, y, x, y * 8 + x AS root FROM ink UNION SELECT i.page_id, i.y, i.x, r.root FROM reach r JOIN ink i ON i.page_id = r.page_id AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1),
labels AS (SELECT page_id, y, x, min(root) AS root FROM reach GROUP BY 1, 2, 3)"""


@reg.add(f"""WITH RECURSIVE {fx.VECTOR_PIXELS}, {LABELS}, c AS (SELECT page_id, root, count(*) AS area, avg(v) AS mean, stddev_pop(v) AS sd, count(*) FILTER (WHERE v < 64) / CAST(count(*) AS DOUBLE) AS dark FROM labels JOIN pixels USING (page_id, y, x) GROUP BY 1, 2)
 SELECT page_id, max(area) AS area, round(arg_max(mean, area * 100 - root), 6) AS mean, round(arg_max(sd, area * 100 - root), 6) AS sd, round(arg_max(dark, area * 100 - root), 6) AS dark FROM c GROUP BY 1""")
def largest_components(spark, sf):
    """Area, mean, deviation and dark share of each page's largest component, the first of equals."""
    pages = fx.vector_pages(spark, sf).withColumn("both", F.zip_with("black", "v", lambda b, v: b * 256 + v))

    def measured(p):
        label = k.components(p // 256)
        n = int(label.max(initial=0))
        if not n:
            return None
        area = k.np.bincount(label.ravel(), minlength=n + 1)[1:]
        tones = (p % 256)[label == int(k.np.argmax(area)) + 1]
        return {"area": len(tones), "mean": float(tones.mean()), "sd": float(tones.std()), "dark": float((tones < 64).mean())}

    found = k.map_values(pages, measured, "both", "m", "struct<area: bigint, mean: double, sd: double, dark: double>").where("m is not null")
    return found.select("page_id", "m.area", *(F.round(f"m.{c}", 6).alias(c) for c in ("mean", "sd", "dark")))


@reg.add(f"{V} SELECT page_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM pixels WHERE v <> 255 AND black = 1 GROUP BY 1")
def layer_rectangles(spark, sf):
    """The part of each page's layer that holds anything, as it is cut before it is embedded."""
    p = fx.vector_pixels(spark, sf).where("v <> 255 and black = 1").groupBy("page_id")
    return p.agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
