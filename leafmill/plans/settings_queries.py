"""Queries over what steps have stored: whether it still fits, and orders and counts made from it, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from leafmill.operators import dependencies as d
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import Registry

reg = Registry()
I = f"WITH {fx.IMAGES}"
#: A step's stored state of an image, and its present one, both made from the order.
NOW, THEN = "['auto', 'single_uncut', 'page_plus_offcut', 'two_pages'][image_id % 4 + 1]", "['auto', 'single_uncut', 'page_plus_offcut', 'two_pages'][owner % 4 + 1]"


def _one_of(values: tuple[str, ...], index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


KINDS = ("auto", "single_uncut", "page_plus_offcut", "two_pages")
FOUND = ("single_uncut", "single_cut", "two_pages")


@reg.add(f"""{I} SELECT image_id, image_id % 6 <> 0 AND owner % 5 <> 0 AND (image_id % 3 = 0 OR owner % 3 = 0 OR (image_id + owner) % 4 <> 0)
 AND ({NOW} = {THEN} OR {NOW} = 'single_uncut' OR ({NOW} = 'two_pages' AND owner % 2 = 0)) AS fits FROM images""")
def split_dependencies(spark, sf):
    k, c = F.col("image_id"), F.col("owner")
    trim = F.when((k % 3 != 0) & (c % 3 != 0), (k + c) % 4 != 0)
    mode = F.when(c % 2 == 0, "manual").otherwise("auto")
    return fx.images(spark, sf).select("image_id", d.split_compatible(k % 6 != 0, c % 5 != 0, trim, _one_of(KINDS, k), _one_of(KINDS, c), mode).alias("fits"))


@reg.add(f"""{I}, f AS (SELECT image_id, {NOW} AS wanted, CASE owner % 4 WHEN 0 THEN 'single_uncut' WHEN 1 THEN 'single_cut' WHEN 2 THEN 'two_pages' END AS found FROM images)
 SELECT image_id, found IS NOT NULL AND wanted <> 'auto' AND NOT ((found = 'single_uncut' AND wanted = 'single_uncut') OR (found = 'single_cut' AND wanted = 'page_plus_offcut') OR (found = 'two_pages' AND wanted = 'two_pages')) AS conflict FROM f""")
def layout_conflicts(spark, sf):
    k, c = F.col("image_id"), F.col("owner")
    return fx.images(spark, sf).select("image_id", d.layout_conflict(_one_of(KINDS, k), F.when(c % 4 < 3, _one_of((*FOUND, "none"), c))).alias("conflict"))


@reg.add(f"{I} SELECT image_id, NOT (dpi_x = dpi_y) AND (image_id % 3 = 0 OR owner % 4 = 0) AS again FROM images")
def angles_to_measure(spark, sf):
    k, c = F.col("image_id"), F.col("owner")
    return fx.images(spark, sf).select("image_id", d.needs_remeasure(F.col("dpi_x") == F.col("dpi_y"), F.when(k % 3 == 0, "auto").otherwise("manual"), F.when(c % 4 == 0, "auto").otherwise("manual")).alias("again"))


@reg.add(f"""{I}, m AS (SELECT image_id, image_id % 5 <> 0 AS same, ['auto', 'manual', 'off'][image_id % 3 + 1] AS c1, ['auto', 'manual', 'off'][owner % 3 + 1] AS c2, ['auto', 'manual', 'off'][(image_id // 3) % 3 + 1] AS p1, ['auto', 'manual', 'off'][(owner // 3) % 3 + 1] AS p2,
 image_id % 2 = 0 AS f1, owner % 2 = 0 AS f2, CASE WHEN image_id % 4 > 0 THEN width % 2 END AS o1, CASE WHEN owner % 4 > 0 THEN height % 2 END AS o2 FROM images)
 SELECT image_id, NOT same OR (c1 <> 'manual' AND c1 <> c2) OR coalesce(c1 = 'auto' AND o1 <> o2, false) AS content, NOT same OR (p1 <> 'manual' AND p1 <> p2) OR (p1 = 'auto' AND f1 <> f2) AS page FROM m""")
def boxes_to_find(spark, sf):
    k, c, modes = F.col("image_id"), F.col("owner"), ("auto", "manual", "off")
    content, page = d.boxes_to_update(
        k % 5 != 0, (_one_of(modes, k), _one_of(modes, c)), (_one_of(modes, F.floor(k / 3)), _one_of(modes, F.floor(c / 3))), (k % 2 == 0, c % 2 == 0),
        (F.when(k % 4 > 0, F.col("width") % 2), F.when(c % 4 > 0, F.col("height") % 2)),
    )
    return fx.images(spark, sf).select("image_id", content.alias("content"), page.alias("page"))


@reg.add(f"""{I}, a AS (SELECT image_id, dir, file_name, row_number() OVER (PARTITION BY dir, file_name ORDER BY image_id) AS n, width, height FROM images),
 b AS (SELECT dir, file_name, row_number() OVER (PARTITION BY dir, file_name ORDER BY file_page, image_id) AS n, width + 1 AS w2, height + 2 AS h2 FROM images WHERE dpi_x > 0)
 SELECT image_id, coalesce(w2, width) AS width, coalesce(h2, height) AS height, w2 IS NOT NULL AS updated FROM a LEFT JOIN b USING (dir, file_name, n)""")
def metadata_updates(spark, sf):
    """The images of a file, in project order, take what has been read of the file's images, in file order."""
    i, file = fx.images(spark, sf), Window.partitionBy("dir", "file_name")
    a = i.select("image_id", "dir", "file_name", "width", "height", F.row_number().over(file.orderBy("image_id")).alias("n"))
    b = i.where("dpi_x > 0").select("dir", "file_name", F.row_number().over(file.orderBy("file_page", "image_id")).alias("n"), (F.col("width") + 1).alias("w2"), (F.col("height") + 2).alias("h2"))
    j = a.join(b, ["dir", "file_name", "n"], "left")
    return j.select("image_id", F.coalesce("w2", "width").alias("width"), F.coalesce("h2", "height").alias("height"), F.col("w2").isNotNull().alias("updated"))


@reg.add(f"""{I} SELECT book, image_id, row_number() OVER (PARTITION BY book ORDER BY dpi_x = 0, CASE WHEN dpi_x = 0 THEN 0 WHEN image_id % 4 = 0 THEN 100 ELSE image_id % 4 END, image_id) AS by_split,
 row_number() OVER (PARTITION BY book ORDER BY image_id % 3, image_id) AS by_colour FROM images""")
def step_orders(spark, sf):
    """Pages by split type, automatic ones as type 100 and incomplete ones last, and by colour mode; keys are made once, before the sort."""
    k, page = F.col("image_id"), Window.partitionBy("book")
    incomplete = F.col("dpi_x") == 0
    split = F.when(incomplete, 0).when(k % 4 == 0, 100).otherwise(k % 4)
    keyed = fx.images(spark, sf).select("book", "image_id", incomplete.alias("incomplete"), split.alias("split"), (k % 3).alias("mode"))
    return keyed.select("book", "image_id", F.row_number().over(page.orderBy("incomplete", "split", "image_id")).alias("by_split"), F.row_number().over(page.orderBy("mode", "image_id")).alias("by_colour"))


@reg.add(f"{I} SELECT DISTINCT image_id, s.side FROM images, (SELECT unnest(['single', 'left', 'right']) AS side) s WHERE CASE WHEN removed = '' AND sub_pages = 1 THEN s.side = 'single' WHEN removed = 'L' THEN s.side = 'right' WHEN removed = 'R' THEN s.side = 'left' ELSE s.side <> 'single' END")
def all_pages(spark, sf):
    sides = F.when(F.col("removed") == "L", F.array(F.lit("right"))).when(F.col("removed") == "R", F.array(F.lit("left"))).when(F.col("sub_pages") == 1, F.array(F.lit("single"))).otherwise(F.array(F.lit("left"), F.lit("right")))
    return fx.images(spark, sf).select("image_id", F.explode(sides).alias("side")).distinct()


SPANS = "s AS (SELECT l_orderkey AS image_id, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1)"


@reg.add(f"""WITH RECURSIVE {SPANS}, t AS (SELECT image_id, w, 1 AS lo, CAST(len(w) AS INT) AS hi, CAST(list_sum(w) AS BIGINT) // 15 AS budget, 0 AS step FROM s UNION ALL
 SELECT image_id, w, CASE WHEN w[lo] < w[hi] THEN lo + 1 ELSE lo END, CASE WHEN w[lo] < w[hi] THEN hi ELSE hi - 1 END, budget - least(w[lo], w[hi]), step + 1 FROM t WHERE lo < hi AND least(w[lo], w[hi]) <= budget)
 SELECT image_id, arg_max(lo, step) - 1 AS first, arg_max(hi, step) - 1 AS last FROM t GROUP BY 1""")
def edge_spans_kept(spark, sf):
    """Spans left when narrow ones at either end go, the narrower end first, up to a fifteenth of all in sum."""
    s = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("rows"))
    w = F.col("w")
    zero = F.struct(F.lit(0).alias("lo"), (F.size("w") - 1).alias("hi"), F.floor(F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x) / 15).alias("budget"), F.lit(False).alias("over"))

    def step(a, _):
        left, right = F.get(w, a["lo"]), F.get(w, a["hi"])
        stop = a["over"] | (a["lo"] >= a["hi"]) | (F.least(left, right) > a["budget"])
        from_left = left < right
        return F.struct(
            F.when(~stop & from_left, a["lo"] + 1).otherwise(a["lo"]).alias("lo"), F.when(~stop & ~from_left, a["hi"] - 1).otherwise(a["hi"]).alias("hi"),
            F.when(stop, a["budget"]).otherwise(a["budget"] - F.least(left, right)).alias("budget"), stop.alias("over"),
        )

    done = s.select("image_id", F.transform("rows", lambda r: r["q"]).alias("w")).select("image_id", F.aggregate("w", zero, step).alias("a"))
    return done.select("image_id", F.col("a.lo").alias("first"), F.col("a.hi").alias("last"))


MM = "25.4::DOUBLE"


@reg.add(f"""{I}, p AS (SELECT image_id, width * {MM} / greatest(dpi_x, 1) AS page_w, height * {MM} / greatest(dpi_y, 1) AS page_h, image_id % 40 AS l, owner % 30 AS r, image_id % 25 AS t, 0 AS b, width, height, dpi_x, dpi_y FROM images WHERE dpi_x > 0 AND dpi_y > 0),
 c AS (SELECT *, (width - l - r) * {MM} / dpi_x AS content_w, (height - t - b) * {MM} / dpi_y AS content_h FROM p)
 SELECT image_id, round(content_w, 6) AS content_w, round(content_h, 6) AS content_h, round(CASE WHEN l + r < 1 THEN 0 ELSE l * (page_w - content_w) / (l + r) END, 6) AS margin_l, round(CASE WHEN l + r < 1 THEN 0 ELSE r * (page_w - content_w) / (l + r) END, 6) AS margin_r,
 round(CASE WHEN t + b < 1 THEN 0 ELSE t * (page_h - content_h) / (t + b) END, 6) AS margin_t, round(CASE WHEN t + b < 1 THEN 0 ELSE b * (page_h - content_h) / (t + b) END, 6) AS margin_b FROM c""")
def auto_margins(spark, sf):
    """Sizes in millimetres of content boxes, and margins that keep the content where it is on its page."""
    k, c = F.col("image_id"), F.col("owner")
    i = fx.images(spark, sf).where("dpi_x > 0 and dpi_y > 0").select("image_id", "width", "height", "dpi_x", "dpi_y", (k % 40).alias("l"), (c % 30).alias("r"), (k % 25).alias("t"), F.lit(0).cast("long").alias("b"))
    mm = lambda n, dpi: n * 25.4 / dpi
    w, h = mm(F.col("width") - F.col("l") - F.col("r"), F.col("dpi_x")), mm(F.col("height") - F.col("t") - F.col("b"), F.col("dpi_y"))
    spare = {"l": mm(F.col("width"), F.col("dpi_x")) - w, "r": mm(F.col("width"), F.col("dpi_x")) - w, "t": mm(F.col("height"), F.col("dpi_y")) - h, "b": mm(F.col("height"), F.col("dpi_y")) - h}
    space = {"l": F.col("l") + F.col("r"), "r": F.col("l") + F.col("r"), "t": F.col("t") + F.col("b"), "b": F.col("t") + F.col("b")}
    margin = lambda s: F.round(F.when(space[s] < 1, 0.0).otherwise(F.col(s) * spare[s] / space[s]), 6).alias(f"margin_{s}")
    return i.select("image_id", F.round(w, 6).alias("content_w"), F.round(h, 6).alias("content_h"), *map(margin, "lrtb"))


@reg.add(f"""{I}, done AS (SELECT o_orderkey AS image_id, count(l_orderkey) AS files, max(l_shipdate) AS written FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY 1)
 SELECT i.image_id, i.book, row_number() OVER (PARTITION BY i.book ORDER BY i.image_id) AS n, CASE WHEN d.image_id IS NULL THEN 'missing' WHEN i.image_id % 3 = 0 THEN 'mixed' ELSE 'image' END AS kind, CASE WHEN d.image_id IS NULL THEN NULL ELSE i.owner % 4 = 0 END AS outdated FROM images i LEFT JOIN (SELECT * FROM done WHERE files = 2) d USING (image_id)""")
def export_pages(spark, sf):
    """All pages of a book in its order, with what there is to export of them and whether that is out of date."""
    li = fx.table(spark, sf, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count("*").alias("files")).where("files = 2")
    j = fx.images(spark, sf).select("image_id", "book", "owner").join(li, "image_id", "left")
    there = F.col("files").isNotNull()
    return j.select("image_id", "book", F.row_number().over(Window.partitionBy("book").orderBy("image_id")).alias("n"), F.when(~there, "missing").when(F.col("image_id") % 3 == 0, "mixed").otherwise("image").alias("kind"), F.when(there, F.col("owner") % 4 == 0).alias("outdated"))


@reg.add("""WITH RECURSIVE e AS (SELECT user_id, event_id, 'f' || (event_id % 5) AS file, CASE WHEN event_type IN ('click', 'view') THEN 'selected' WHEN event_type = 'error' THEN 'cleared' ELSE 'inserted' END AS what, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS anchor, '' AS last FROM (SELECT DISTINCT user_id FROM events) UNION ALL
 SELECT e.user_id, e.n, e.event_id, CASE WHEN what = 'cleared' THEN '' WHEN what = 'selected' AND file <> anchor AND file <> last THEN file ELSE anchor END,
 CASE WHEN what = 'cleared' THEN '' WHEN what = 'selected' AND file <> anchor AND file <> last THEN file WHEN what = 'inserted' AND anchor <> '' THEN file ELSE last END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
 SELECT user_id, event_id, anchor, last AS after FROM s WHERE n > 0""")
def insertion_anchors(spark, sf):
    """Where the next scan of each user goes: after the last one inserted behind the page that was selected."""
    what = F.when(F.col("event_type").isin("click", "view"), "selected").when(F.col("event_type") == "error", "cleared").otherwise("inserted")
    e = fx.table(spark, sf, "events").select("user_id", "ts", "event_id", F.concat(F.lit("f"), F.col("event_id") % 5).alias("file"), what.alias("what"))
    from leafmill.streaming.scans import insertion_anchors as anchors

    return anchors(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "anchor", "after")


@reg.add(f"""{I}, t AS (SELECT image_id, (image_id % 4) * 90 AS turn, row_number() OVER (PARTITION BY image_id ORDER BY l_linenumber DESC, l_partkey % 4 DESC) AS last, (l_partkey % 4) * 90 AS own FROM images JOIN lineitem ON l_orderkey = image_id)
 SELECT i.image_id, coalesce(t.own, (i.image_id % 4) * 90) AS degrees, coalesce(t.own, (i.image_id % 4) * 90) IN (90, 270) AS swapped FROM images i LEFT JOIN t ON t.image_id = i.image_id AND t.last = 1""")
def propagated_orientations(spark, sf):
    """Each image's orientation for the split step: that of its last page in project order, or the image's own."""
    li = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.max_by(F.col("l_partkey") % 4 * 90, F.struct("l_linenumber", F.col("l_partkey") % 4)).alias("own"))
    degrees = F.coalesce("own", F.col("image_id") % 4 * 90)
    return fx.images(spark, sf).select("image_id").join(li, "image_id", "left").select("image_id", degrees.alias("degrees"), degrees.isin(90, 270).alias("swapped"))


BAD = r"""CASE WHEN n = '' THEN 'empty' WHEN regexp_matches(n, '[\x01-\x1F\x7F]') THEN 'control' WHEN regexp_matches(n, '[\\/:*?"<>|]') THEN 'character' WHEN regexp_matches(n, '[. ]$') THEN 'end' END"""


@reg.add(rf"""{I}, p AS (SELECT image_id, CASE WHEN image_id % 11 = 0 THEN '' ELSE '/' || dir || CASE image_id % 5 WHEN 0 THEN '/a:b/' WHEN 1 THEN '//x./' WHEN 2 THEN '/./' WHEN 3 THEN '/tab' || chr(9) || '/' ELSE '/ok/' END || file_name || CASE owner % 3 WHEN 0 THEN ' ' WHEN 1 THEN '?' ELSE '' END END AS path FROM images),
 u AS (SELECT image_id, unnest(string_split(path, '/')) AS n, unnest(range(len(string_split(path, '/')))) AS i FROM p), r AS (SELECT image_id, i, {BAD} AS why FROM u WHERE n <> '' AND n <> '.')
 SELECT p.image_id, CASE WHEN path = '' THEN 'empty' ELSE w.why END AS why FROM p LEFT JOIN (SELECT image_id, arg_max(why, i) AS why FROM r WHERE why IS NOT NULL GROUP BY 1) w USING (image_id)""")
def bad_paths(spark, sf):
    k, c = F.col("image_id"), F.col("owner")
    middle = F.element_at(F.array(*map(F.lit, ("/a:b/", "//x./", "/./", "/tab\t/", "/ok/"))), (k % 5 + 1).cast("int"))
    path = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("/"), "dir", middle, "file_name", F.element_at(F.array(F.lit(" "), F.lit("?"), F.lit("")), (c % 3 + 1).cast("int"))))
    return fx.images(spark, sf).select("image_id", d.bad_path(path).alias("why"))


OUTLINE = "[{{'x': {x} + 0.0::DOUBLE, 'y': 0.0::DOUBLE}}, {{'x': 10.0::DOUBLE, 'y': 0.5::DOUBLE}}, {{'x': 8.0::DOUBLE, 'y': 9.0::DOUBLE}}]"


@reg.add(f"""{I} SELECT image_id, CASE WHEN image_id % 7 = 0 THEN false ELSE abs((image_id % 4) - (owner % 4)) = 0 END AS same FROM images""")
def outlines_compared(spark, sf):
    """Page outlines now and then: the same points from another begin and the other way round are the same outline."""
    k, c = F.col("image_id"), F.col("owner")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    a = F.array(point(k % 4, 0), point(F.lit(10), 0.5), point(F.lit(8), 9))
    b = F.array(point(F.lit(8), 9), point(F.lit(10) + 0.0001, 0.5), point(c % 4, 0))
    return fx.images(spark, sf).select("image_id", d.same_outline(a, F.when(k % 7 == 0, F.slice(b, 1, 1)).otherwise(b)).alias("same"))


@reg.add("SELECT DISTINCT l_extendedprice AS value, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS shown FROM lineitem")
def canonical_numbers(spark, sf):
    """Numbers in the shortest form that reads back as the same value."""
    return fx.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value")).distinct().select("value", F.regexp_replace(F.col("value").cast("string"), r"\.0$", "").alias("shown"))


QUADRATIC = ([[2.0, -1.0, 0.5], [-1.0, 3.0, 0.25], [0.5, 0.25, 1.0]], [1.0, -2.0, 0.5], 4.0)


@reg.add("""WITH p AS (SELECT event_id, user_id / 10.0::DOUBLE AS x, value AS y, event_id % 7 + 0.0::DOUBLE AS z FROM events)
 SELECT event_id, round(2 * x * x + 3 * y * y + z * z - 2 * x * y + x * z + 0.5 * y * z + x - 2 * y + 0.5 * z + 4, 4) AS f, round(4 * x - 2 * y + z + 1, 4) AS fx, round(6 * y - 2 * x + 0.5 * z - 2, 4) AS fy, round(2 * z + x + 0.5 * y + 0.5, 4) AS fz FROM p""")
def quadratic_values(spark, sf):
    """A quadratic function x'Ax + b'x + c and its gradient at points."""
    p = fx.table(spark, sf, "events").select("event_id", (F.col("user_id") / 10.0).alias("x0"), F.col("value").alias("x1"), (F.col("event_id") % 7 + 0.0).alias("x2"))
    a, b, c = QUADRATIC
    x = [F.col(f"x{i}") for i in range(3)]
    value = sum((a[i][j] * x[i] * x[j] for i in range(3) for j in range(3)), F.lit(c)) + sum((b[i] * x[i] for i in range(3)), F.lit(0.0))
    slope = [sum((2 * a[i][j] * x[j] for j in range(3)), F.lit(b[i])) for i in range(3)]
    return p.select("event_id", F.round(value, 4).alias("f"), *(F.round(s, 4).alias(n) for s, n in zip(slope, ("fx", "fy", "fz"), strict=True)))


BOX = (10.0, 5.0, 90.0, 70.0)


@reg.add("""WITH seg AS (SELECT event_id, user_id + 0.0::DOUBLE AS x1, value AS y1, event_id % 50 - 25.0::DOUBLE AS dx, event_id % 31 - 15.0::DOUBLE AS dy FROM events),
 t AS (SELECT event_id, x1, y1, dx, dy, unnest([CASE WHEN dy <> 0 THEN (5.0 - y1) / dy END, CASE WHEN dy <> 0 THEN (70.0 - y1) / dy END, CASE WHEN dx <> 0 THEN (10.0 - x1) / dx END, CASE WHEN dx <> 0 THEN (90.0 - x1) / dx END]) AS s, unnest([0, 1, 2, 3]) AS side FROM seg),
 ok AS (SELECT event_id, s FROM t WHERE s IS NOT NULL AND CASE WHEN side < 2 THEN (x1 + s * dx - 10.0) / 80.0 ELSE (y1 + s * dy - 5.0) / 65.0 END BETWEEN -1e-9 AND 1 + 1e-9),
 b AS (SELECT event_id, min(s) AS lo, max(s) AS hi FROM ok GROUP BY 1 HAVING max(s) > min(s))
 SELECT event_id, round(x1 + lo * dx, 6) AS ax, round(y1 + lo * dy, 6) AS ay, round(x1 + hi * dx, 6) AS bx, round(y1 + hi * dy, 6) AS by FROM seg JOIN b USING (event_id)""")
def bounded_lines(spark, sf):
    """The part within a rectangle of the line through each segment; lines that miss it are left out."""
    e = fx.table(spark, sf, "events").select("event_id", (F.col("user_id") + 0.0).alias("x1"), F.col("value").alias("y1"), (F.col("event_id") % 50 - 25.0).alias("dx"), (F.col("event_id") % 31 - 15.0).alias("dy"))
    from leafmill.functions.geometry import bounded_by

    lo, hi = bounded_by(*(F.col(c) for c in ("x1", "y1", "dx", "dy")), BOX)
    b = e.select("*", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    at = lambda s, v, by, name: F.round(F.col(v) + F.col(s) * F.col(by), 6).alias(name)
    return b.select("event_id", at("lo", "x1", "dx", "ax"), at("lo", "y1", "dy", "ay"), at("hi", "x1", "dx", "bx"), at("hi", "y1", "dy", "by"))


@reg.add("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS y FROM events), s AS (SELECT a.user_id, a.i, a.y AS y1, b.y AS y2 FROM p a JOIN p b ON b.user_id = a.user_id AND b.i = a.i + 1)
 SELECT user_id, i, round(i + (30 - y1) / (y2 - y1), 5) AS x FROM s WHERE (y1 - 30) * (y2 - 30) <= 0 AND y1 <> y2""")
def polyline_crossings(spark, sf):
    """Where the polyline of each user's values crosses a level line."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = fx.table(spark, sf, "events").select("user_id", F.row_number().over(w).alias("i"), F.col("value").alias("y1"), F.lead("value").over(w).alias("y2"))
    return p.where("(y1 - 30) * (y2 - 30) <= 0 AND y1 <> y2").select("user_id", "i", F.round(F.col("i") + (30 - F.col("y1")) / (F.col("y2") - F.col("y1")), 5).alias("x"))


@reg.add(f"""{I}, f AS (SELECT image_id, dpi_x <> dpi_y AND owner % 4 = 0 AS again, image_id % 6 <> 0 AND owner % 5 <> 0 AS split, image_id % 5 <> 0 AS outline, owner % 3 <> 0 AS fresh FROM images)
 SELECT image_id, CASE WHEN NOT split THEN 2 WHEN again THEN 3 WHEN NOT outline THEN 4 WHEN NOT fresh THEN 6 END AS stage FROM f""")
def stages_to_run(spark, sf):
    """The first step that each image needs again, told from what is stored alone: no pixel is read."""
    k, c, yes = F.col("image_id"), F.col("owner"), F.lit(True)
    split = d.split_compatible(k % 6 != 0, c % 5 != 0, yes, F.lit("auto"), F.lit("auto"), F.lit("auto"))
    again = d.needs_remeasure(F.col("dpi_x") == F.col("dpi_y"), F.when(c % 4 == 0, "auto").otherwise("manual"), F.lit("manual"))
    manual = (F.lit("manual"), F.lit("manual"))
    content, page = d.boxes_to_update(k % 5 != 0, manual, manual, (yes, yes), (F.lit(1), F.lit(1)))
    return fx.images(spark, sf).select("image_id", F.when(~split, 2).when(again, 3).when(content | page, 4).when(c % 3 == 0, 6).alias("stage"))


@reg.add(f"""{I}, made AS (SELECT l_orderkey AS image_id, max(l_shipdate) AS made FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), changed AS (SELECT o_orderkey AS image_id, o_orderdate + INTERVAL 60 DAY AS changed FROM orders)
 SELECT i.image_id, CAST(greatest(1, 250 * width // greatest(width, height)) AS INT) AS width, CAST(greatest(1, 250 * height // greatest(width, height)) AS INT) AS height FROM images i JOIN changed USING (image_id) LEFT JOIN made m USING (image_id) WHERE made IS NULL OR made < changed""")
def thumbnails_to_make(spark, sf):
    """Images whose thumbnail is missing or older than they are, and the size that fits 250 by 250."""
    made = fx.table(spark, sf, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.max("l_shipdate").alias("made"))
    changed = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("changed"))
    j = fx.images(spark, sf).select("image_id", "width", "height").join(changed, "image_id").join(made, "image_id", "left").where("made is null or made < changed")
    fit = lambda c: F.greatest(F.lit(1), F.floor(250 * F.col(c) / F.greatest("width", "height"))).cast("int")
    return j.select("image_id", fit("width").alias("width"), fit("height").alias("height"))


def listings_of_users(spark, sf):
    """Each user's events as listings of a folder, two thousand times as fast: a page that is new every day or so, and a log that grows; an error is a failed load of the page."""
    files = F.array(
        F.struct(F.concat(F.lit("page"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000_000_000)).alias("path"), F.lit(5).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_ms")),
        F.struct(F.lit("log").alias("path"), F.col("event_id").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_ms")),
    )
    failed = F.col("event_type") == "error"
    return fx.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("folder"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 2_000_000).alias("now_ms"), F.when(failed, "failed").otherwise("listing").alias("what"), F.when(failed, F.slice(files, 1, 1)).otherwise(files).alias("files")
    )


@reg.add(None)
def scan_events(spark, sf):
    """What becomes of the files of each user's folder."""
    from leafmill.streaming.scans import track

    return track(listings_of_users(spark, sf))
