"""Queries on what is where on pages, and least squares, palettes and trims, with their SQL where they have one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from leafmill.operators import blurs, kernels as k, layout, segments, sheets, snakes, splines
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import Registry

reg = Registry()
C = f"WITH {fx.COLOUR_PIXELS}"
PALETTE = [(0, 0, 0), (255, 255, 255), (200, 40, 40), (40, 120, 200), (90, 160, 60)]


@reg.add(f"""{C}, p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE))}) p(i, pr, pg, pb))
 SELECT page_id, i AS colour, count(*) AS n FROM (SELECT page_id, y, x, arg_min(i, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 10 + i) AS i FROM colours, p GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def palette_shares(spark, sf):
    """Pixels of each page by the nearest colour of a palette, the first of equals."""
    apart = lambda c, v: (F.col(c) - v) * (F.col(c) - v)
    near = F.array_min(F.array(*(F.struct((apart("r", r) + apart("g", g) + apart("b", b)).alias("d"), F.lit(i).alias("i")) for i, (r, g, b) in enumerate(PALETTE))))["i"]
    return fx.colour_pixels(spark, sf).groupBy("page_id", near.alias("colour")).agg(F.count("*").alias("n"))


@reg.add("""WITH p AS (SELECT user_id, value AS y, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1) ::DOUBLE AS x FROM events),
 s AS (SELECT user_id, count(*) ::DOUBLE AS n, sum(x) AS a, sum(x * x) AS b, sum(x * x * x) AS c, sum(x * x * x * x) AS d, sum(y) AS e, sum(x * y) AS f, sum(x * x * y) AS g FROM p GROUP BY 1 HAVING count(*) >= 3),
 t AS (SELECT *, n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b) AS det FROM s)
 SELECT user_id, round((e * (b * d - c * c) - a * (f * d - c * g) + b * (f * c - b * g)) / det, 3) AS c0, round((n * (f * d - c * g) - e * (a * d - b * c) + b * (a * g - f * b)) / det, 3) AS c1, round((n * (b * g - f * c) - a * (a * g - f * b) + e * (a * c - b * b)) / det, 3) AS c2 FROM t""")
def polynomial_lines(spark, sf):
    """Least-squares parabola of each user's values over even steps from 0 to 1, from eight sums."""
    w = Window.partitionBy("user_id")
    x = (F.row_number().over(w.orderBy("ts", "event_id")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1)).cast("double")
    p = fx.table(spark, sf, "events").select("user_id", F.col("value").alias("y"), x.alias("x"))
    sums = {"a": "x", "b": "x * x", "c": "x * x * x", "d": "x * x * x * x", "e": "y", "f": "x * y", "g": "x * x * y"}
    s = p.groupBy("user_id").agg(F.count("*").cast("double").alias("n"), *(F.sum(F.expr(v)).alias(name) for name, v in sums.items())).where("n >= 3")
    s = s.withColumn("det", F.expr("n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b)"))
    made = {
        "c0": "e * (b * d - c * c) - a * (f * d - c * g) + b * (f * c - b * g)", "c1": "n * (f * d - c * g) - e * (a * d - b * c) + b * (a * g - f * b)", "c2": "n * (b * g - f * c) - a * (a * g - f * b) + e * (a * c - b * b)",
    }
    return s.select("user_id", *(F.round(F.expr(f"({v}) / det"), 3).alias(name) for name, v in made.items()))


@reg.add(f"""WITH {fx.IMAGES}, t AS (SELECT image_id, width, height, image_id % 4 AS q, image_id % 60 AS l, owner % 50 AS t, (image_id // 4) % 40 AS r, (owner // 4) % 30 AS b FROM images)
 SELECT image_id, CASE q WHEN 0 THEN l WHEN 1 THEN b WHEN 2 THEN r ELSE t END AS "left", CASE q WHEN 0 THEN t WHEN 1 THEN l WHEN 2 THEN b ELSE r END AS top, CASE WHEN q % 2 = 0 THEN width - l - r ELSE height - t - b END AS width, CASE WHEN q % 2 = 0 THEN height - t - b ELSE width - l - r END AS height FROM t""")
def turned_trims(spark, sf):
    """The part that a trim leaves of each image, as it lies on the page after its quarter turns."""
    i, o = F.col("image_id"), F.col("owner")
    t = fx.images(spark, sf).select("image_id", "width", "height", (i % 4).alias("q"), (i % 60).alias("l"), (o % 50).alias("t"), (F.floor(i / 4) % 40).alias("r"), (F.floor(o / 4) % 30).alias("b"))
    turned = lambda names: F.element_at(F.array(*map(F.col, names)), (F.col("q") + 1).cast("int"))
    w, h = F.col("width") - F.col("l") - F.col("r"), F.col("height") - F.col("t") - F.col("b")
    upright = F.col("q") % 2 == 0
    return t.select("image_id", turned("lbrt").alias("left"), turned("tlbr").alias("top"), F.when(upright, w).otherwise(h).alias("width"), F.when(upright, h).otherwise(w).alias("height"))


def found(name: str, f, value: str, kind: str):
    def query(spark, sf):
        return k.map_values(fx.vector_pages(spark, sf), f, value, "found", kind)

    query.__name__ = name
    reg.add(None)(query)


def page(name: str, f, value: str = "v", out: str = "v", sql: str | None = None):
    def query(spark, sf):
        return k.map_pages(fx.vector_pages(spark, sf), f, value, out)

    query.__name__ = name
    reg.add(sql)(query)


R = f"WITH RECURSIVE {fx.VECTOR_PIXELS}"


def labels_sql(ink: str, name: str) -> str:
    """Tables that end in `name` (page_id, y, x, label): components of ink (page_id, y, x) by their first pixel."""
    return f"""{name}_r AS (SELECT page_id, y, x, y * 8 + x AS root FROM {ink} UNION SELECT i.page_id, i.y, i.x, r.root FROM {name}_r r JOIN {ink} i ON i.page_id = r.page_id AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1),
{name} AS (SELECT page_id, y, x, dense_rank() OVER (PARTITION BY page_id ORDER BY root) AS label FROM (SELECT page_id, y, x, min(root) AS root FROM {name}_r GROUP BY 1, 2, 3))"""


page("picture_masks", lambda a: layout.picture_mask(a, 3), out="black")
page("pages_without_shadows", lambda b: layout.without_shadows(b, ((2, 6), (6, 2))), "black", "black")
page("dewarped_pages", lambda a: layout.dewarped(a, np.array([(0, 0.5), (4, 0), (8, 0.5)]), np.array([(0, 7.5), (4, 7), (8, 7.5)]), 8, 8))
page("flattened_pages", lambda a: sheets.flattened(a, np.array([(0, 0.5), (4, 0), (8, 0.5)]), np.array([(0, 7.5), (4, 7), (8, 7.5)]), 8, 8))
page("recursive_blur", lambda a: np.floor(blurs.gauss(a, 1.5, 2.0) + 0.5).astype(int))
page("modelled_pages", lambda a: sheets.modelled(a, layout.text_lines((a < 128).astype(int), 3, 4, 1)))
page("components_added", lambda b: layout.add_component(k.components(b), (np.indices(b.shape).sum(axis=0) % 7 == 0).astype(int)), "black", "label", sql=f"""{R}, ink AS (SELECT page_id, y, x FROM pixels WHERE black = 1), {labels_sql("ink", "l")}, n AS (SELECT page_id, max(label) AS n FROM l GROUP BY 1)
 SELECT p.page_id, p.y, p.x, CASE WHEN (p.y + p.x) % 7 = 0 THEN coalesce(n, 0) + 1 ELSE coalesce(label, 0) END AS label FROM pixels p LEFT JOIN n USING (page_id) LEFT JOIN l ON l.page_id = p.page_id AND l.y = p.y AND l.x = p.x""")
page("text_masks", lambda b: layout.text_mask(b, 2), "black", "black", sql=f"""{R}, smeared AS (SELECT p.page_id, p.y, p.x FROM pixels p LEFT JOIN pixels q ON q.page_id = p.page_id AND q.y = p.y AND q.x = p.x - 1 WHERE p.black = 1 OR q.black = 1), {labels_sql("smeared", "l")},
 kept AS (SELECT page_id, label FROM l GROUP BY 1, 2 HAVING max(x) - min(x) + 1 >= 1.5 * (max(y) - min(y) + 1)) SELECT p.page_id, p.y, p.x, CASE WHEN p.black = 1 AND k.label IS NOT NULL THEN 1 ELSE 0 END AS black FROM pixels p LEFT JOIN l ON l.page_id = p.page_id AND l.y = p.y AND l.x = p.x LEFT JOIN kept k ON k.page_id = l.page_id AND k.label = l.label""")
page("straightened_pages", lambda a: layout.straightened(a, (a < 128).astype(int), 3, 5))
found("traced_lines", lambda b: [[round(float(v), 3) for v in (line[0, 0], line[0, 1], line[-1, 0], line[-1, 1])] for line in layout.text_lines(b, 3, 4, 1)], "black", "array<array<double>>")
found("refined_lines", lambda a: [[round(float(v), 3) for v in (line[0, 1], line[-1, 1])] for line in snakes.refined_lines(a, layout.text_lines((a < 128).astype(int), 3, 4, 1), 2.0)], "v", "array<array<double>>")
found("whitespace_rectangles", lambda b: [list(map(int, r)) for r in layout.whitespaces(b, 1, 1, 3)], "black", "array<array<int>>")
found("picture_rectangles", lambda b: [list(r) for r in layout.rectangles(b)], "black", "array<array<int>>")
found("oblique_angles", layout.oblique_angle, "black", "double")
found("upright_lines", lambda a: [list(x) for x in layout.vertical_lines(a, 2)], "v", "array<array<double>>")
found("spine_cuts", layout.spine_split, "v", "double")
found("trimmed_boxes", lambda b: list(map(int, layout.trimmed_box(b, (0, 0, 7, 7), 0.2, 1))), "black", "array<int>")
found("ink_lines", lambda b: [float(x) for x in layout.ransac_line(np.argwhere(b > 0)[:, ::-1].astype(float), 0.75, 50)[0]] if b.any() else None, "black", "array<double>")
found("edge_lines", lambda b: [[round(x, 2) for x in line] for line in layout.best_lines(np.argwhere(b > 0)[:, ::-1], 0.5, 1, fine=0.2)], "black", "array<array<double>>")
found("cheapest_paths", lambda a: float(layout.cheapest_path(a, (0, 0), (a.shape[0] - 1, a.shape[1] - 1))[0]), "v", "double")


@reg.add(None)
def chroma_denoised(spark, sf):
    """Colours of pages without weak tints: gray, red and blue from one array of packed colours."""
    pages = fx.vector_pages(spark, sf)
    at = F.sequence(F.lit(0), F.size("v") - 1)
    packed = F.zip_with("v", at, lambda v, i: v * 65536 + (v * 3 + i % 8 * 17) % 256 * 256 + (v * 5 + F.floor(i / 8).cast("int") * 29) % 256)

    def kernel(p):
        made = layout.chroma_denoised(np.stack((p >> 16, p >> 8 & 255, p & 255), axis=2), 1.0, 12)
        return made[:, :, 0] << 16 | made[:, :, 1] << 8 | made[:, :, 2]

    out = k.map_pages(pages.withColumn("rgb", packed), kernel, "rgb", "rgb")
    part = lambda s: F.shiftright("rgb", s).bitwiseAND(255)
    return out.select("page_id", "y", "x", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


@reg.add(f"""{R}, ink AS (SELECT page_id, y, x FROM pixels WHERE black = 1), {labels_sql("ink", "l")}, border AS (SELECT DISTINCT page_id, label FROM l WHERE y IN (0, 7) OR x IN (0, 7))
 SELECT page_id, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom FROM l ANTI JOIN border USING (page_id, label) GROUP BY 1""")
def page_boxes(spark, sf):
    """Box of each page's ink that no dark border touches; pages without any are left out."""
    boxes = k.map_values(fx.vector_pages(spark, sf), lambda b: list(x) if (x := layout.page_box(b)) else None, "black", "box", "array<int>")
    return boxes.where("box is not null").select("page_id", *(F.col("box")[i].alias(n) for i, n in enumerate(("left", "top", "right", "bottom"))))


def packed_colours(spark, sf):
    """Vector pages with a colour a pixel in one number, r * 65536 + g * 256 + b, and ink where the gray is below 200."""
    at = F.sequence(F.lit(0), F.size("v") - 1)
    packed = F.zip_with("v", at, lambda v, i: v * 65536 + (v * 3 + i % 8 * 17) % 256 * 256 + (v * 5 + F.floor(i / 8).cast("int") * 29) % 256)
    return fx.vector_pages(spark, sf).withColumn("rgb", packed)


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.stack((p >> 16, p >> 8 & 255, p & 255), axis=2), (p >> 16 < 200).astype(np.int64)


# Otsu of a channel: the middle of the first and last level of the greatest variance between classes, told from cumulative histograms of the levels that occur.
CHANNELS = f"""{C}, inked AS (SELECT page_id, y, x, r, g, b, r < 200 AS ink FROM colours), seen AS (SELECT page_id, y, x, ink, unnest([0, 1, 2]) AS c, unnest([CASE WHEN ink THEN r ELSE 255 END, CASE WHEN ink THEN g ELSE 255 END, CASE WHEN ink THEN b ELSE 255 END]) AS v FROM inked),
 h AS (SELECT page_id, c, v, count(*) AS n FROM seen GROUP BY 1, 2, 3),
 s AS (SELECT page_id, c, v, sum(n) OVER w AS d, sum(n * v) OVER w AS ds, sum(n) OVER p AS t, sum(n * v) OVER p AS ts, lead(v) OVER (PARTITION BY page_id, c ORDER BY v) AS nxt FROM h WINDOW w AS (PARTITION BY page_id, c ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY page_id, c)),
 z AS (SELECT page_id, c, v, nxt, (ds / d - (ts - ds) / (t - d)) * (ds / d - (ts - ds) / (t - d)) * CAST(d AS DOUBLE) * CAST(t - d AS DOUBLE) AS var FROM (SELECT page_id, c, v, nxt, CAST(d AS DOUBLE) AS d, CAST(ds AS DOUBLE) AS ds, CAST(t AS DOUBLE) AS t, CAST(ts AS DOUBLE) AS ts FROM s WHERE nxt IS NOT NULL)),
 best AS (SELECT page_id, c, (min(v) + max(nxt) - 1 + 2) // 2 AS cut FROM (SELECT *, max(var) OVER (PARTITION BY page_id, c) AS top FROM z) WHERE var = top GROUP BY 1, 2),
 cuts AS (SELECT page_id, c, greatest(1, least(255, coalesce(cut, 0))) AS cut FROM (SELECT DISTINCT page_id, c FROM h) LEFT JOIN best USING (page_id, c)),
 masks AS (SELECT page_id, y, x, CAST(sum(CASE WHEN v < cut THEN 1 << c ELSE 0 END) AS INT) AS dark FROM seen JOIN cuts USING (page_id, c) GROUP BY 1, 2, 3)"""


@reg.add(f"{CHANNELS} SELECT page_id, y, x, dark FROM masks")
def colour_masks(spark, sf):
    """Which of a pixel's channels are dark, each by its own threshold: the seven masks of the colour segments."""
    return k.map_pages(packed_colours(spark, sf), lambda p: segments.dark_channels(*unpacked(p)), "rgb", "dark")


@reg.add(None)
def colour_segments(spark, sf):
    """Segments of each page's ink by colour, with a pixel's number and the mean colour of its segment."""

    def kernel(p):
        label = segments.segments(*unpacked(p), noise=1)
        mean = segments.mean_coloured(label, unpacked(p)[0])
        return label << 24 | mean[:, :, 0] << 16 | mean[:, :, 1] << 8 | mean[:, :, 2]

    made = k.map_pages(packed_colours(spark, sf), kernel, "rgb", "made", "long", where=lambda m: m >> 24 > 0)
    return made.select("page_id", "y", "x", F.shiftright("made", 24).alias("segment"), F.col("made").bitwiseAND(0xFFFFFF).alias("mean"))


TILE_KINDS = ["long"] * 6 + ["double"] * 6 + ["long"] * 3


@reg.add(None)
def tone_tiles(spark, sf):
    """What the 81 tiles of each text's page of 128 columns tell of continuous tones; pages with fewer than 100 lines are left out."""

    def tiles(tones):
        page = np.full(-(-len(tones) // 128) * 128, 255)
        page[: len(tones)] = tones
        found = segments.tone_tiles(page.reshape(-1, 128))
        return {n: np.array([f"{v:.6f}" if kind == "double" else v for v in column]) for n, kind, column in zip(segments.TILE_COLUMNS, TILE_KINDS, zip(*found, strict=True), strict=True)} if found else None

    kinds = ["string" if kind == "double" else kind for kind in TILE_KINDS]
    made = k.map_texts(fx.text_pages(spark, sf), tiles, ", ".join(f"{n} {kind}" for n, kind in zip(segments.TILE_COLUMNS, kinds, strict=True)))
    return made.select("page_id", *(F.col(n).cast(kind) for n, kind in zip(segments.TILE_COLUMNS, TILE_KINDS, strict=True)))


@reg.add(f"""{R}, flags AS (SELECT page_id, y, x FROM pixels WHERE black = 1), reach AS (SELECT page_id, y, x, y * 8 + x AS root FROM flags UNION SELECT f.page_id, f.y, f.x, r.root FROM reach r JOIN flags f ON f.page_id = r.page_id AND abs(f.y - r.y) + abs(f.x - r.x) = 1),
 roots AS (SELECT page_id, y, x, min(root) AS root FROM reach GROUP BY 1, 2, 3), cells AS (SELECT DISTINCT page_id, root, y + dy AS y, x + dx AS x FROM roots, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)),
 n AS (SELECT page_id, root, count(*) AS tiles FROM roots GROUP BY 1, 2), m AS (SELECT page_id, root, count(*) AS cells FROM cells GROUP BY 1, 2)
 SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY root) AS region, tiles, cells FROM n JOIN m USING (page_id, root)""")
def tone_regions(spark, sf):
    """Regions of touching flagged tiles, how many tiles each has and how many cells they cover."""
    found = k.map_values(fx.vector_pages(spark, sf), lambda b: [list(r) for r in segments.tone_regions(b)], "black", "regions", "array<array<long>>")
    rows = found.select("page_id", F.explode("regions").alias("r"))
    return rows.select("page_id", *(F.col("r")[i].alias(n) for i, n in enumerate(("region", "tiles", "cells"))))


@reg.add(None)
def spline_samples(spark, sf):
    """Each user's first eight values as control points of a curve: its samples, its length and where it comes nearest to the middle of the box."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = fx.table(spark, sf, "events").select("user_id", "value", "event_type", F.row_number().over(w).alias("n")).where("n <= 8")
    tension = F.when(F.col("event_type") == "click", -0.5).when(F.col("event_type") == "view", 0.0).otherwise(1.0)
    curves = first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("n", "value", tension.alias("tension")))).alias("p"))

    def run(batches):
        for batch in batches:
            out = [(user, *spline_measures([(10.0 * (x["n"] - 1), x["value"]) for x in p], [x["tension"] for x in p])) for user, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.float64()] * 4), strict=True)], ["user_id", "samples", "length", "t", "x", "y"])

    return curves.mapInArrow(run, "user_id long, samples long, length double, t double, x double, y double")


def spline_measures(points, tension):
    points = np.array(points)
    _, line = splines.sampled(points, tension)
    t, near = splines.closest((points.min(axis=0) + points.max(axis=0)) / 2, points, tension, 0.01)
    return len(line), round(float(np.hypot(*np.diff(line, axis=0).T).sum()), 6), round(t, 6), round(float(near[0]), 6), round(float(near[1]), 6)
