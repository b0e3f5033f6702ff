"""Queries that label, fill, cut or render pages, and texts of pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from leafmill.functions import geometry as g, text as tx
from leafmill.operators import kernels as k, raster as r
from leafmill.plans import fixtures as fx, stages
from leafmill.plans.registry import Registry
from leafmill.sources import fax

reg = Registry()
V = f"WITH RECURSIVE {fx.VECTOR_PIXELS}"
LABELS = """ink AS (SELECT page_id, y, x FROM pixels WHERE black = 1),
reach AS (SELECT page_id, y, x, y * 8 + x AS root FROM ink UNION SELECT i.page_id, i.y, i.x, r.root FROM reach r JOIN ink i ON i.page_id = r.page_id AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1),
labels AS (SELECT page_id, y, x, dense_rank() OVER (PARTITION BY page_id ORDER BY root) AS label FROM (SELECT page_id, y, x, min(root) AS root FROM reach GROUP BY 1, 2, 3))"""


def labelled(spark, sf):
    return k.map_pages(fx.vector_pages(spark, sf), k.components, "black", "label", "long", where=lambda label: label > 0)


@reg.add(f"{V}, {LABELS} SELECT page_id, y, x, label FROM labels")
def connected_components(spark, sf):
    return labelled(spark, sf)


@reg.add(f"{V}, {LABELS} SELECT page_id, label, count(*) AS area, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom FROM labels GROUP BY 1, 2")
def component_statistics(spark, sf):
    return labelled(spark, sf).groupBy("page_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"))


@reg.add(f"""{V}, {LABELS}, small AS (SELECT page_id, label, count(*) AS n FROM labels GROUP BY 1, 2 HAVING count(*) >= 3) SELECT page_id, y, x, dense_rank() OVER (PARTITION BY page_id ORDER BY label) AS label FROM labels SEMI JOIN small USING (page_id, label)""")
def components_kept(spark, sf):
    page = Window.partitionBy("page_id")
    big = labelled(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("page_id", "label"))).where("n >= 3")
    return big.select("page_id", "y", "x", F.dense_rank().over(page.orderBy("label")).cast("long").alias("label"))


@reg.add(f"{V}, {LABELS}, seeds AS (SELECT DISTINCT page_id, label FROM labels WHERE y = 0) SELECT page_id, y, x FROM labels SEMI JOIN seeds USING (page_id, label)")
def seed_fill(spark, sf):
    hit = F.bool_or(F.col("y") == 0).over(Window.partitionBy("page_id", "label"))
    return labelled(spark, sf).withColumn("hit", hit).where("hit").select("page_id", "y", "x")


@reg.add(f"{V}, {LABELS}, small AS (SELECT page_id, label FROM labels GROUP BY 1, 2 HAVING count(*) < 2) SELECT page_id, y, x FROM labels SEMI JOIN small USING (page_id, label)")
def speckles(spark, sf):
    p = labelled(spark, sf)
    n = F.count("*").over(Window.partitionBy("page_id", "label"))
    return p.withColumn("n", n).where("n < 2").select("page_id", "y", "x")


@reg.add(f"{V}, {LABELS}, a AS (SELECT * FROM labels), t AS (SELECT DISTINCT a.page_id, a.label, b.label AS other FROM a JOIN a b ON a.page_id = b.page_id AND a.label < b.label AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2) SELECT * FROM t")
def close_components(spark, sf):
    p = labelled(spark, sf)
    # Each pixel meets the 24 places around it, not all pixels of its page.
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-2, 3) for dx in range(-2, 3) if (dy, dx) != (0, 0)))
    near = p.select("page_id", F.col("label").alias("other"), F.explode(steps).alias("s"), "y", "x").select("page_id", "other", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return p.join(near, ["page_id", "y", "x"]).where("label < other").select("page_id", "label", "other").distinct()


POLYGON = [(1.0, 0.5), (6.5, 1.5), (5.0, 6.5), (2.0, 5.5)]
EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True)) + ") e(x1, y1, x2, y2))"


@reg.add(f"""{V}, {EDGES}, hits AS (SELECT page_id, y, x, black, sum(CASE WHEN y1 <= y + 0.5 AND y2 > y + 0.5 AND x1 + (y + 0.5 - y1) / (y2 - y1) * (x2 - x1) > x + 0.5 THEN 1 WHEN y2 <= y + 0.5 AND y1 > y + 0.5 AND x1 + (y + 0.5 - y1) / (y2 - y1) * (x2 - x1) > x + 0.5 THEN -1 ELSE 0 END) AS w FROM pixels, edges GROUP BY ALL)
 SELECT page_id, y, x, CASE WHEN w <> 0 THEN 1 ELSE black END AS filled, CASE WHEN w = 0 THEN 1 ELSE black END AS filled_outside FROM hits""")
def polygon_fill(spark, sf):
    w = g.winding(F.col("x") + 0.5, F.col("y") + 0.5, POLYGON)
    return fx.vector_pixels(spark, sf).withColumn("w", w).select("page_id", "y", "x", F.when(F.col("w") != 0, 1).otherwise(F.col("black")).alias("filled"), F.when(F.col("w") == 0, 1).otherwise(F.col("black")).alias("filled_outside"))


LINES = "seg AS (SELECT event_id, user_id::DOUBLE AS x1, value AS y1, user_id + event_id % 7 + 1.0::DOUBLE AS x2, value + event_id % 5 - 2.0::DOUBLE AS y2, 40.0::DOUBLE AS px, 30.0::DOUBLE AS py FROM events)"


@reg.add(f"""WITH {LINES}, t AS (SELECT *, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS t FROM seg), c AS (SELECT *, least(greatest(t, 0), 1) AS u FROM t)
 SELECT event_id, round((x1 + u * (x2 - x1) - px) * (x1 + u * (x2 - x1) - px) + (y1 + u * (y2 - y1) - py) * (y1 + u * (y2 - y1) - py), 5) AS squared, round(x1 + (10 - y1) / CASE WHEN abs(y2 - y1) < 1e-6 THEN NULL ELSE y2 - y1 END * (x2 - x1), 5) AS crosses_at FROM c""")
def segments_and_points(spark, sf):
    e = fx.table(spark, sf, "events")
    x1, y1 = F.col("user_id").cast("double"), F.col("value")
    x2, y2 = F.col("user_id") + F.col("event_id") % 7 + 1.0, F.col("value") + F.col("event_id") % 5 - 2.0
    return e.select("event_id", F.round(g.squared_distance(F.lit(40.0), F.lit(30.0), x1, y1, x2, y2), 5).alias("squared"), F.round(g.crossing_x(F.lit(10.0), x1, y1, x2, y2), 5).alias("crosses_at"))


KNOTS = [(0.0, 0.0), (20.0, 18.0), (60.0, 66.0), (150.0, 150.0), (400.0, 390.0)]


@reg.add("WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(KNOTS, KNOTS[1:], strict=False)) + """) k(a, fa, b, fb))
 SELECT event_id, round(fa + (least(value, 399.0) - a) / (b - a) * (fb - fa), 6) AS mapped FROM events JOIN k ON least(value, 399.0) >= a AND least(value, 399.0) < b""")
def width_correction(spark, sf):
    return fx.table(spark, sf, "events").where("value >= 0").select("event_id", F.round(g.piecewise(F.least("value", F.lit(399.0)), KNOTS), 6).alias("mapped"))


@reg.add("""WITH p AS (SELECT user_id, ts, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events), s AS (SELECT user_id, event_id, sum(sqrt(1 + coalesce(d, 0) * coalesce(d, 0))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS len FROM p) SELECT user_id, event_id, round(len, 4) AS len FROM s""")
def arc_lengths(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0))
    p = fx.table(spark, sf, "events").withColumn("d", d)
    return p.select("user_id", "event_id", F.round(F.sum(F.sqrt(1 + F.col("d") * F.col("d"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("len"))


@reg.add("""SELECT doc_id, replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', chr(65533), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml FROM documents""")
def xml_texts(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.xml_text(F.col("text")).alias("xml"))


@reg.add(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents), w AS (SELECT doc_id, line, unnest(range(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))) AS n, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word FROM l)
 SELECT doc_id, line, n, word FROM w""")
def page_words(spark, sf):
    return tx.words(fx.table(spark, sf, "documents").select("doc_id", "text"))


@reg.add("""SELECT source, string_agg(text, chr(12) ORDER BY doc_id) AS book, count(*) AS pages FROM documents GROUP BY source""")
def text_books(spark, sf):
    return tx.books(fx.table(spark, sf, "documents"), "source", "doc_id", "text")


@reg.add("""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents) SELECT doc_id, lpad(CAST(n AS VARCHAR), CAST(greatest(length(CAST(total AS VARCHAR)), 4) AS INT), '0') || '_page' || doc_id || '.xml' AS name FROM p""")
def page_file_names(spark, sf):
    w = Window.partitionBy("source")
    p = fx.table(spark, sf, "documents").select("doc_id", F.row_number().over(w.orderBy("doc_id")).alias("n"), F.count("*").over(w).alias("total"))
    return p.select("doc_id", tx.numbered_name(F.col("n"), F.col("total"), F.concat(F.lit("_page"), "doc_id", F.lit(".xml"))).alias("name"))


ESCAPED = "replace(replace(replace(replace(regexp_replace({w}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', chr(65533), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def markup_sql(word: str, line: tuple[str, str], page: tuple[str, str]) -> str:
    """Markup of each document's words, from what a word, a line and a page look like; word uses w, a (where it begins), e (where it ends) and i (its line)."""
    return rf"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents), ws AS (SELECT doc_id, i, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM l),
 u AS (SELECT doc_id, i, unnest(ws) AS w, unnest(range(len(ws))) AS n FROM ws), p AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id, i ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS e FROM u), q AS (SELECT *, e - length(w) AS a FROM p),
 g AS (SELECT doc_id, i, string_agg({word}, '' ORDER BY n) AS body FROM q GROUP BY 1, 2)
 SELECT doc_id, '{page[0]}' || chr(10) || string_agg('{line[0]}' || coalesce(body, '') || '{line[1]}', chr(10) ORDER BY i) || chr(10) || '{page[1]}' AS page FROM l LEFT JOIN g USING (doc_id, i) GROUP BY 1"""


HOCR_WORD = "'<span class=''ocrx_word'' title=''bbox ' || CAST(a * 10 AS BIGINT) || ' ' || i * 20 || ' ' || CAST(e * 10 AS BIGINT) || ' ' || (i + 1) * 20 || '''>' || " + ESCAPED.format(w="w") + " || '</span> '"
ALTO_WORD = "'<String CONTENT=\"' || " + ESCAPED.format(w="w") + " || '\" HPOS=\"' || CAST(a * 10 AS BIGINT) || '\" VPOS=\"' || i * 20 || '\" WIDTH=\"' || CAST((e - a) * 10 AS BIGINT) || '\" HEIGHT=\"20\"/>'"


@reg.add(markup_sql(HOCR_WORD, ("<span class=''ocr_line''>", "</span>"), ("<div class=''ocr_page''>", "</div>")))
def line_pages(spark, sf):
    """hOCR markup of each document's words."""
    return tx.hocr_pages(fx.table(spark, sf, "documents"), "doc_id", "text")


@reg.add(markup_sql(ALTO_WORD, ("<TextLine>", "</TextLine>"), ("<Page><PrintSpace>", "</PrintSpace></Page>")))
def alto_pages(spark, sf):
    """ALTO markup of each document's words."""
    return tx.alto_pages(fx.table(spark, sf, "documents"), "doc_id", "text")


@reg.add("""WITH e AS (SELECT user_id AS path, event_id, ts, event_id % 3 AS size, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), s AS (SELECT *, CASE WHEN was = size AND size > 0 THEN 1 ELSE 0 END AS same FROM e),
 t AS (SELECT *, same + CASE WHEN same = 1 THEN coalesce(lag(same) OVER (PARTITION BY path ORDER BY ts, event_id), 0) ELSE 0 END AS stable FROM s) SELECT path, min(ts) AS ready_at FROM t WHERE stable >= 2 GROUP BY 1""")
def stable_files(spark, sf):
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("path"), "event_id", "ts", (F.col("event_id") % 3).alias("size"))
    s = e.withColumn("same", F.when((F.lag("size").over(w) == F.col("size")) & (F.col("size") > 0), 1).otherwise(0))
    t = s.withColumn("stable", F.col("same") + F.when(F.col("same") == 1, F.coalesce(F.lag("same").over(w), F.lit(0))).otherwise(0))
    return t.where("stable >= 2").groupBy("path").agg(F.min("ts").alias("ready_at"))


def kernel(name: str, f, value: str = "v", out: str = "v", kind: str = "int", sql: str | None = None):
    def query(spark, sf):
        return k.map_pages(fx.vector_pages(spark, sf), f, value, out, kind)

    query.__name__ = name
    reg.add(sql)(query)


P = f"WITH {fx.VECTOR_PIXELS}"


def blur_sql(sigma_x: float, sigma_y: float) -> str:
    """Tables that end in blurred (page_id, y, x, v, b): a Gaussian to five sigmas, one axis after the other, edges repeated."""
    def taps(sigma: float) -> str:
        r = int(5 * sigma + 0.5)
        return f"(SELECT d, exp(-0.5 * (d / {sigma}::DOUBLE) * (d / {sigma}::DOUBLE)) / (SELECT sum(exp(-0.5 * (e / {sigma}::DOUBLE) * (e / {sigma}::DOUBLE))) FROM range({-r}, {r + 1}) t(e)) AS w FROM range({-r}, {r + 1}) t(d))"

    return f"""across AS (SELECT p.page_id, p.y, p.x, any_value(p.v) AS v, sum(t.w * q.v) AS b FROM pixels p, {taps(sigma_x)} t, pixels q WHERE q.page_id = p.page_id AND q.y = p.y AND q.x = least(greatest(p.x + t.d, 0), 7) GROUP BY 1, 2, 3),
blurred AS (SELECT p.page_id, p.y, p.x, any_value(p.v) AS v, sum(t.w * q.b) AS b FROM across p, {taps(sigma_y)} t, across q WHERE q.page_id = p.page_id AND q.x = p.x AND q.y = least(greatest(p.y + t.d, 0), 7) GROUP BY 1, 2, 3)"""


kernel("gaussian_blur", lambda a: np.rint(k.blur(a, 1.0, 1.5)).astype(int), sql=f"{P}, {blur_sql(1.0, 1.5)} SELECT page_id, y, x, CAST(round_even(b, 0) AS INT) AS v FROM blurred")
kernel("sharpened", lambda a: k.sharpen(a, 1, 0.8), sql=f"{P}, {blur_sql(1.0, 1.0)} SELECT page_id, y, x, CAST(least(greatest(round_even(v + 0.8 * (v - b), 0), 0), 255) AS INT) AS v FROM blurred")
#: Weights of the parabola's middle over five places, in 35ths; over two axes they multiply.
SMOOTHING = "(VALUES (-2, -3), (-1, 12), (0, 17), (1, 12), (2, -3)) {t}(d, w)"
kernel("polynomial_smoothing", k.polynomial_smooth, sql=f"""{P}, s AS (SELECT p.page_id, p.y, p.x, sum(a.w * b.w * q.v) / 1225.0::DOUBLE AS s FROM pixels p, {SMOOTHING.format(t='a')}, {SMOOTHING.format(t='b')}, pixels q
 WHERE q.page_id = p.page_id AND q.y = least(greatest(p.y + a.d, 0), 7) AND q.x = least(greatest(p.x + b.d, 0), 7) GROUP BY 1, 2, 3) SELECT page_id, y, x, CAST(least(greatest(round_even(s, 0), 0), 255) AS INT) AS v FROM s""")
RINGS = ", ".join(f"r{i} AS (SELECT p.page_id, p.y, p.x, avg(q.v) AS m FROM pixels p JOIN pixels q ON q.page_id = p.page_id AND abs(q.y - p.y) <= {i} AND abs(q.x - p.x) <= {i} GROUP BY 1, 2, 3)" for i in (1, 2))
NEAR = "exp(-({r2} / 25.0::DOUBLE + ((v - {m}) / 255.0::DOUBLE * {r} / 0.5) * ((v - {m}) / 255.0::DOUBLE * {r} / 0.5)))"
kernel("tone_denoised", lambda a: k.denoise(a, 2, 0.5), sql=f"""{P}, {RINGS}, w AS (SELECT p.*, r1.m AS m1, r2.m AS m2, {NEAR.format(r2=1, m='r1.m', r=1)} AS w1, {NEAR.format(r2=4, m='r2.m', r=2)} AS w2 FROM pixels p JOIN r1 USING (page_id, y, x) JOIN r2 USING (page_id, y, x)),
 c AS (SELECT *, (v + m1 * w1 * 8 + m2 * w2 * 16) / (1 + w1 * 8 + w2 * 16) AS c, 1 / 25.0::DOUBLE + CASE WHEN w1 > 0.02 THEN 8 / 25.0::DOUBLE ELSE 0 END + CASE WHEN w2 > 0.02 THEN 16 / 25.0::DOUBLE ELSE 0 END AS alike FROM w)
 SELECT page_id, y, x, CAST(least(greatest(floor(c + (v - c) * CASE WHEN alike > 0.66 THEN 0.16 ELSE 0.84 END + 0.5), 0), 255) AS INT) AS v FROM c""")
kernel("background_subtracted", lambda a: k.subtract_background(a, 2, 0.5), sql=f"{P}, m AS (SELECT p.page_id, p.y, p.x, any_value(p.v) AS v, quantile_cont(q.v, 0.5) AS m FROM pixels p JOIN pixels q ON q.page_id = p.page_id AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 GROUP BY 1, 2, 3) SELECT page_id, y, x, CAST(least(greatest(round_even(v + 0.5 * (255 - m), 0), 0), 255) AS INT) AS v FROM m")
kernel("gray_seed_fill", lambda a: k.gray_reconstruct(np.where(np.indices(a.shape)[0] == 0, a, 255), a), sql=f"""{V}, spread AS (SELECT page_id, y, x, v FROM pixels WHERE y = 0 UNION SELECT q.page_id, q.y, q.x, greatest(s.v, q.v) FROM spread s JOIN pixels q ON q.page_id = s.page_id AND abs(q.y - s.y) <= 1 AND abs(q.x - s.x) <= 1)
 SELECT page_id, y, x, min(v) AS v FROM spread GROUP BY 1, 2, 3""")
kernel("affine_resampled", lambda a: k.resample(a, np.array([[1.0, 0.2, -0.5], [-0.2, 1.0, 0.5]]), a.shape[0], a.shape[1]), sql=f"""{P}, s AS (SELECT page_id, y, x, 1.0::DOUBLE * (x + 0.5) + 0.2::DOUBLE * (y + 0.5) + -0.5 - 0.5 AS sx, -0.2::DOUBLE * (x + 0.5) + 1.0 * (y + 0.5) + 0.5 - 0.5 AS sy FROM pixels),
 f AS (SELECT *, CAST(floor(sx) AS INT) AS x0, CAST(floor(sy) AS INT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM s),
 j AS (SELECT f.*, coalesce(a.v, 255) AS a, coalesce(b.v, 255) AS b, coalesce(c.v, 255) AS c, coalesce(d.v, 255) AS d FROM f LEFT JOIN pixels a ON a.page_id = f.page_id AND a.y = y0 AND a.x = x0 LEFT JOIN pixels b ON b.page_id = f.page_id AND b.y = y0 AND b.x = x0 + 1 LEFT JOIN pixels c ON c.page_id = f.page_id AND c.y = y0 + 1 AND c.x = x0 LEFT JOIN pixels d ON d.page_id = f.page_id AND d.y = y0 + 1 AND d.x = x0 + 1)
 SELECT page_id, y, x, CAST(least(greatest(round_even((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy, 0), 0), 255) AS INT) AS v FROM j""")
kernel("despeckled", lambda b: k.despeckle(b, 2, 8, 0.8), "black", "black")
NEAREST = f"""{V}, {LABELS}, near AS (SELECT p.page_id, p.y, p.x, arg_min(l.label, ((l.y - p.y) * (l.y - p.y) + (l.x - p.x) * (l.x - p.x)) * 1000 + l.label) AS label FROM pixels p JOIN labels l USING (page_id) GROUP BY 1, 2, 3)"""
kernel("influence_map", lambda b: k.nearest_label(k.components(b)), "black", "label", "long", sql=f"{NEAREST} SELECT p.page_id, p.y, p.x, coalesce(n.label, 0) AS label FROM pixels p LEFT JOIN near n USING (page_id, y, x)")


def two_tones_sql(source: str) -> str:
    """Tables that end in cuts (page_id, t): the threshold between two means of source (page_id, v), step by step, in 256ths."""
    return f"""tones AS (SELECT page_id, list(CAST(v AS BIGINT)) AS vs, CAST(min(v) AS BIGINT) * 128 AS lo, (CAST(max(v) AS BIGINT) + 1) * 128 AS hi FROM {source} GROUP BY 1),
steps AS (SELECT page_id, vs, lo, hi, CAST(NULL AS BIGINT) AS was, (256 * hi + 256 * lo) // 256 AS t, 0 AS n FROM tones UNION ALL
 SELECT page_id, vs, lo, hi, t, (256 * coalesce(CAST(list_sum(list_filter(vs, lambda v: v * 256 >= t)) AS BIGINT) * 128 // nullif(len(list_filter(vs, lambda v: v * 256 >= t)), 0), hi)
  + 256 * coalesce(CAST(list_sum(list_filter(vs, lambda v: v * 256 < t)) AS BIGINT) * 128 // nullif(len(list_filter(vs, lambda v: v * 256 < t)), 0), lo) + 127) // 256, n + 1 FROM steps WHERE (was IS NULL OR was <> t) AND n < 256),
cuts AS (SELECT page_id, (arg_max(t, n) + 127) // 256 AS t FROM steps GROUP BY 1)"""


kernel("two_tone_pages", lambda a: (a < k.two_tones(a)).astype(int), "v", "black", sql=f"{V}, {two_tones_sql('pixels')} SELECT page_id, y, x, CASE WHEN v < t THEN 1 ELSE 0 END AS black FROM pixels JOIN cuts USING (page_id)")
ROBUST = """m AS (SELECT *, floor(b + 0.5) AS m FROM blurred), robust AS (SELECT page_id, y, x, CASE WHEN m + (m - v) <= 0 THEN 255 ELSE CAST(floor(least(greatest(0.5 * (255 - (m + 255) * (m - v) / (m + (m - v))) + 0.5 * v + 0.5, 0), 255)) AS INT) END AS v FROM m)"""
kernel("binarize_robust", lambda a: ((r := k.robust(a, 2, 0.5)) < k.two_tones(r)).astype(int), "v", "black", sql=f"{V}, {blur_sql(2.0, 2.0)}, {ROBUST}, {two_tones_sql('robust')} SELECT page_id, y, x, CASE WHEN v < t THEN 1 ELSE 0 END AS black FROM robust JOIN cuts USING (page_id)")
kernel("binarize_gatos", lambda a: k.gatos(a, 2, 0.2), "v", "black")
kernel("binarize_multi_scale", lambda a: (a < k.multi_scale(a, 2, 0.5)).astype(int), "v", "black")
kernel("background_surface", lambda a: np.rint(k.fit_surface(a, 2, 2)).astype(int))


@reg.add(f"{NEAREST} SELECT DISTINCT a.page_id, least(a.label, b.label) AS label, greatest(a.label, b.label) AS other FROM near a JOIN near b ON b.page_id = a.page_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.label <> b.label")
def touching_regions(spark, sf):
    """Pairs of components whose regions of nearest pixels touch."""
    def pairs(b):
        label = k.nearest_label(k.components(b))
        found = set()
        for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
            one = label[: label.shape[0] - dy, max(0, -dx) : label.shape[1] - max(0, dx)]
            two = label[dy:, max(0, dx) : label.shape[1] - max(0, -dx)]
            apart = (one != two) & (one > 0) & (two > 0)
            found |= set(zip(np.minimum(one, two)[apart].tolist(), np.maximum(one, two)[apart].tolist(), strict=True))
        return [list(p) for p in sorted(found)]

    touching = k.map_values(fx.vector_pages(spark, sf), pairs, "black", "pairs", "array<array<bigint>>")
    return touching.select("page_id", F.explode("pairs").alias("p")).select("page_id", F.col("p")[0].alias("label"), F.col("p")[1].alias("other"))


@reg.add(f"{P}, c AS (SELECT page_id, y, sum(black) AS n FROM pixels GROUP BY 1, 2) SELECT page_id, y, n - lag(n, 1, 0) OVER (PARTITION BY page_id ORDER BY y) AS step FROM c")
def row_differences(spark, sf):
    """How much ink each row has more than the one above."""
    c = fx.vector_pixels(spark, sf).groupBy("page_id", "y").agg(F.sum("black").alias("n"))
    return c.select("page_id", "y", (F.col("n") - F.lag("n", 1, 0).over(Window.partitionBy("page_id").orderBy("y"))).alias("step"))


@reg.add(None)
def skew_angles(spark, sf):
    return k.map_values(fx.vector_pages(spark, sf), k.skew_angle, "black", "angle", "double")


@reg.add(None)
def processed_pages(spark, sf):
    """All stages on every vector page: orientation, split, deskew, content box, margins, output."""
    return stages.process(fx.vector_pages(spark, sf))


@reg.add(f"""{V}, cols AS (SELECT page_id, x AS i, sum(black) AS n FROM pixels GROUP BY 1, 2), f AS (SELECT *, i - lag(i) OVER (PARTITION BY page_id ORDER BY i) - 1 AS gap FROM cols WHERE n >= 3),
 s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM f),
 sp AS (SELECT page_id, min(i) AS b, max(i) + 1 AS e FROM s GROUP BY page_id, span), gaps AS (SELECT *, lead(b) OVER (PARTITION BY page_id ORDER BY b) AS nb FROM sp),
 best AS (SELECT page_id, arg_max((e + nb) / 2, (nb - e) * 1000 - e) AS cut FROM gaps WHERE nb IS NOT NULL GROUP BY 1) SELECT p.page_id, round(coalesce(cut, 4), 3) AS cut FROM (SELECT DISTINCT page_id FROM pixels) p LEFT JOIN best USING (page_id)""")
def page_cuts(spark, sf):
    return stages.whitespace_cuts(fx.vector_pixels(spark, sf), 3, 8).withColumn("cut", F.round("cut", 3))


@reg.add(None)
def fax_lengths(spark, sf):
    """Bytes of each text's page of 64 columns as fax, and as it is."""

    def lengths(tones, sizes):
        height = -(-sizes // 64)
        top = np.cumsum(height) - height
        ink = np.zeros(int(height.sum()) * 64, np.uint8)
        ink[np.arange(len(tones)) + np.repeat(top * 64 - (np.cumsum(sizes) - sizes), sizes)] = tones != 255
        begins = np.zeros(len(ink) // 64, bool)
        begins[top] = True
        return {"height": height, "fax_bytes": fax.encoded_sizes(ink.reshape(-1, 64), begins), "plain_bytes": height * 8}

    return k.map_many_texts(fx.text_pages(spark, sf), lengths, "height long, fax_bytes long, plain_bytes long")
