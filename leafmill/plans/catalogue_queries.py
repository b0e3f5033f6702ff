"""Queries over the catalogue, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leafmill.operators import catalogue as c
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import Registry

reg = Registry()
#: Pages that one task sorts, of about 300 bytes each.
PAGES_A_TASK = 1_000_000
STATUS = """CASE WHEN {d} <= 1 THEN 'UNDEFINED' WHEN {d} < 300 AND ceil({p} * 300.0 / {d}) > 32767 THEN 'TOO_SMALL_TO_PROCESS' WHEN {d} < 150 THEN 'TOO_SMALL'
 WHEN {d} > 9999 THEN 'TOO_LARGE' WHEN 25.4 * {p} / {d} > 500 THEN 'TOO_SMALL_FOR_THIS_PIXEL_SIZE' ELSE 'OK' END"""
PAGES = """pages_view AS (SELECT *, unnest(CASE WHEN sub_pages = 2 THEN ['left', 'right'] WHEN removed = 'L' THEN ['right'] WHEN removed = 'R' THEN ['left'] ELSE ['single'] END) AS sub_page,
  unnest(range(CASE WHEN sub_pages = 2 THEN 2 ELSE 1 END)) AS ord FROM images)"""
POSITIONS = PAGES + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY image_id, ord) - 1 AS pos FROM pages_view)"""


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return c.with_positions(c.logical_pages(fx.images(spark, sf)), ["image_id", "ord"])


@reg.add(f"WITH {fx.IMAGES} SELECT image_id, file_name FROM images WHERE lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) IN ('tif', 'tiff', 'png', 'jpg', 'jpeg', 'jp2')")
def import_listing(spark, sf):
    return c.importable(fx.images(spark, sf)).select("image_id", "file_name")


@reg.add(f"""WITH {fx.IMAGES} SELECT image_id, {STATUS.format(p='width', d='dpi_x')} AS status_x, {STATUS.format(p='height', d='dpi_y')} AS status_y,
 dpi_x > 1 AND dpi_y > 1 AND NOT (dpi_x < 300 AND ceil(width * 300.0 / dpi_x) > 32767) AND NOT (dpi_y < 300 AND ceil(height * 300.0 / dpi_y) > 32767) AS dpi_ok,
 width > 32767 OR height > 32767 OR CAST(width AS BIGINT) * height > 600000000 AS too_big, CASE WHEN width * dpi_y > height * dpi_x THEN 2 ELSE 1 END AS advised_pages FROM images""")
def image_checks(spark, sf):
    return c.with_metadata_checks(fx.images(spark, sf)).select("image_id", "status_x", "status_y", "dpi_ok", "too_big", "advised_pages")


@reg.add(f"""WITH {fx.IMAGES} SELECT book, bool_and(dpi_x > 1 AND dpi_y > 1 AND NOT (dpi_x < 300 AND ceil(width * 300.0 / dpi_x) > 32767) AND NOT (dpi_y < 300 AND ceil(height * 300.0 / dpi_y) > 32767)) AS all_valid, count(*) AS images FROM images GROUP BY book""")
def books_ready(spark, sf):
    return c.with_metadata_checks(fx.images(spark, sf)).groupBy("book").agg(F.bool_and("dpi_ok").alias("all_valid"), F.count("*").alias("images"))


@reg.add(f"WITH {fx.IMAGES}, {PAGES} SELECT image_id, sub_page, ord FROM pages_view")
def page_view(spark, sf):
    return c.logical_pages(fx.images(spark, sf)).select("image_id", "sub_page", "ord")


@reg.add(f"""WITH {fx.IMAGES} SELECT image_id, unnest(CASE WHEN sub_pages = 2 THEN ['right', 'left'] WHEN removed = 'L' THEN ['right'] WHEN removed = 'R' THEN ['left'] ELSE ['single'] END) AS sub_page FROM images""")
def page_view_right_to_left(spark, sf):
    return c.logical_pages(fx.images(spark, sf), True).select("image_id", "sub_page")


REMOVED = "gone AS (SELECT l_orderkey AS image_id, ['single', 'left', 'right'][l_suppkey % 3 + 1] AS sub_page FROM lineitem WHERE l_returnflag = 'R')"


def removals(spark, sf):
    li = fx.table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return li.select(F.col("l_orderkey").alias("image_id"), F.element_at(F.array(*map(F.lit, c.SUB_PAGES)), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("sub_page"))


@reg.add(f"""WITH {fx.IMAGES}, {REMOVED}, g AS (SELECT image_id, bool_or(sub_page = 'single') AS s, bool_or(sub_page = 'left') AS l, bool_or(sub_page = 'right') AS r FROM gone GROUP BY 1),
 j AS (SELECT i.*, coalesce(s, false) AS s, coalesce(l, false) AND (sub_pages = 2 OR removed = 'R') AS cl, coalesce(r, false) AND (sub_pages = 2 OR removed = 'L') AS cr FROM images i LEFT JOIN g USING (image_id))
 SELECT image_id, CAST(sub_pages - cl::INT - cr::INT AS INT) AS sub_pages, CASE WHEN cl AND NOT cr THEN 'L' WHEN cr AND NOT cl THEN 'R' ELSE removed END AS removed FROM j WHERE NOT s AND sub_pages - cl::INT - cr::INT > 0""")
def pages_removed(spark, sf):
    return c.remove_pages(fx.images(spark, sf), removals(spark, sf)).select("image_id", "sub_pages", "removed")


@reg.add(f"""WITH {fx.IMAGES}, {REMOVED}, g AS (SELECT image_id, bool_or(sub_page = 'left') AS l, bool_or(sub_page = 'right') AS r FROM gone GROUP BY 1),
 j AS (SELECT i.*, coalesce(sub_pages = 1 AND ((removed = 'L' AND l) OR (removed = 'R' AND r)), false) AS hit FROM images i LEFT JOIN g USING (image_id))
 SELECT image_id, CASE WHEN hit THEN 2 ELSE sub_pages END AS sub_pages, CASE WHEN hit THEN '' ELSE removed END AS removed FROM j""")
def pages_restored(spark, sf):
    return c.unremove_pages(fx.images(spark, sf), removals(spark, sf)).select("image_id", "sub_pages", "removed")


@reg.add(f"""WITH {fx.IMAGES}, {POSITIONS}, base AS (SELECT book, min(pos) FILTER (WHERE sub_page = 'right') AS base FROM placed GROUP BY book)
 SELECT p.book, image_id, sub_page, pos, coalesce((pos - base) % 2 = 0, false) AS every_other, coalesce(pos >= base, false) AS followers, coalesce(pos >= base AND (pos - base) % 2 = 0, false) AS following_every_other FROM placed p JOIN base USING (book)""")
def page_selections(spark, sf):
    p = placed(spark, sf)
    base = p.groupBy("book").agg(F.min(F.when(F.col("sub_page") == "right", F.col("pos"))).alias("base"))
    j, no = p.join(base, "book"), F.lit(False)
    even = c.every_other(j, F.col("base"))
    return j.select("book", "image_id", "sub_page", F.col("pos").cast("long").alias("pos"), F.coalesce(even, no).alias("every_other"), F.coalesce(F.col("pos") >= F.col("base"), no).alias("followers"), F.coalesce((F.col("pos") >= F.col("base")) & even, no).alias("following_every_other"))


@reg.add(f"""WITH {fx.IMAGES}, {POSITIONS}, s AS (SELECT * FROM placed SEMI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25) q ON q.l_orderkey = image_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS place FROM s) SELECT book, image_id, sub_page, place FROM r WHERE place % 2 = 0""")
def every_other_in_subset(spark, sf):
    subset = fx.table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("image_id"))
    s = placed(spark, sf).join(subset, "image_id", "left_semi").withColumn("place", (F.row_number().over(Window.partitionBy("book").orderBy("pos")) - 1).cast("long"))
    return s.where("place % 2 = 0").select("book", "image_id", "sub_page", "place")


@reg.add(f"""WITH {fx.IMAGES}, {POSITIONS}, wanted AS (SELECT DISTINCT l_orderkey + (l_linenumber // 7) * 1000000000 AS image_id FROM lineitem)
 SELECT w.image_id, coalesce(min(pos), -1) AS page_no FROM wanted w LEFT JOIN placed p USING (image_id) GROUP BY 1""")
def page_numbers(spark, sf):
    wanted = fx.table(spark, sf, "lineitem").select((F.col("l_orderkey") + F.floor(F.col("l_linenumber") / 7) * 1000000000).alias("image_id")).distinct()
    return wanted.join(placed(spark, sf), "image_id", "left").groupBy("image_id").agg(F.coalesce(F.min("pos"), F.lit(-1)).cast("long").alias("page_no"))


@reg.add(f"""WITH {fx.IMAGES}, added AS (SELECT p_partkey AS image_id, p_partkey % 15000 AS existing FROM part), u AS (
 SELECT book, image_id, image_id AS spot, 1 AS side FROM images UNION ALL SELECT i.book, -a.image_id, a.existing, CASE WHEN a.image_id % 2 = 0 THEN 0 ELSE 2 END FROM added a JOIN images i ON i.image_id = a.existing)
 SELECT book, image_id, row_number() OVER (PARTITION BY book ORDER BY spot, side, image_id) AS place FROM u""")
def images_inserted(spark, sf):
    i = fx.images(spark, sf).select("book", "image_id")
    added = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("new"), (F.col("p_partkey") % 15000).alias("image_id"))
    new = added.join(i, "image_id").select("book", (-F.col("new")).alias("image_id"), F.col("image_id").alias("at"), F.when(F.col("new") % 2 == 0, 0).otherwise(2).alias("side"))
    both = i.select("book", "image_id", F.col("image_id").alias("at"), F.lit(1).alias("side")).unionByName(new)
    return both.select("book", "image_id", F.row_number().over(Window.partitionBy("book").orderBy("at", "side", "image_id")).cast("long").alias("place"))


@reg.add(f"""WITH {fx.IMAGES} SELECT i.image_id, coalesce(s.own, 'auto') AS layout, coalesce(s.own = 'single' AND i.sub_pages = 2, false) AS conflict FROM images i
 LEFT JOIN (SELECT l_orderkey AS image_id, any_value(CASE WHEN l_suppkey % 2 = 0 THEN 'single' ELSE 'two' END) AS own FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) s USING (image_id)""")
def layout_types(spark, sf):
    """An image's own layout is that of its first row in the file, as any_value has it when rows are read in order."""
    rows = fx.table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("image_id"), F.when(F.col("l_suppkey") % 2 == 0, "single").otherwise("two").alias("own"), "_metadata.file_path", "_metadata.row_index")
    own = rows.groupBy("image_id").agg(F.min_by("own", F.struct("file_path", "row_index")).alias("own"))
    j = fx.images(spark, sf).join(own, "image_id", "left")
    return j.select("image_id", F.coalesce("own", F.lit("auto")).alias("layout"), F.coalesce((F.col("own") == "single") & (F.col("sub_pages") == 2), F.lit(False)).alias("conflict"))


@reg.add("""SELECT a.l_orderkey AS image_id, a.l_linenumber AS page_no, b.l_orderkey IS NULL OR a.l_quantity IS DISTINCT FROM b.l_quantity + (b.l_partkey % 3) OR a.l_shipdate IS DISTINCT FROM b.l_shipdate AS stale
 FROM lineitem a LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'N') b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def stale_outputs(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    now = li.select("key", "l_quantity", "l_shipdate")
    was = li.where("l_returnflag <> 'N'").select("key", (F.col("l_quantity") + F.col("l_partkey") % 3).alias("l_quantity"), "l_shipdate")
    return c.is_stale(now, was, "key", ["l_quantity", "l_shipdate"]).select(F.col("key.l_orderkey").alias("image_id"), F.col("key.l_linenumber").alias("page_no"), "stale")


@reg.add("""WITH names AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'con.txt' WHEN 1 THEN p_name || '.' WHEN 2 THEN 'a:' || p_name WHEN 3 THEN '' WHEN 4 THEN '..' WHEN 5 THEN repeat(p_name, 30) ELSE p_name END AS name FROM part)
 SELECT p_partkey, CASE WHEN name = '' THEN 'empty' WHEN name IN ('.', '..') THEN 'dots' WHEN regexp_matches(name, '[<>:"/\\\\|?*\\x00-\\x1f]') THEN 'character' WHEN regexp_matches(name, '[ .]$') THEN 'ending'
 WHEN regexp_matches(upper(regexp_extract(name, '^([^.]*)', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN 'reserved' WHEN strlen(name) > 255 THEN 'long' END AS reason FROM names""")
def file_name_problems(spark, sf):
    k, n = F.col("p_partkey") % 8, F.col("p_name")
    name = F.when(k == 0, "con.txt").when(k == 1, F.concat(n, F.lit("."))).when(k == 2, F.concat(F.lit("a:"), n)).when(k == 3, "").when(k == 4, "..").when(k == 5, F.repeat(n, F.lit(30))).otherwise(n)
    return fx.table(spark, sf, "part").select("p_partkey", c.name_problem(name).alias("reason"))


@reg.add(f"""WITH {fx.IMAGES}, moved AS (SELECT DISTINCT dir AS old_dir, 'moved/' || dir AS new_dir FROM images WHERE dir < '3')
 SELECT image_id, coalesce(new_dir, dir) || '/' || file_name AS path, new_dir IS NULL AS unmoved FROM images LEFT JOIN moved ON dir = old_dir""")
def relinked_paths(spark, sf):
    i = fx.images(spark, sf)
    moved = i.where("dir < '3'").select(F.col("dir").alias("old_dir"), F.concat(F.lit("moved/"), "dir").alias("new_dir")).distinct()
    return i.join(moved, F.col("dir") == F.col("old_dir"), "left").select("image_id", F.concat(F.coalesce("new_dir", "dir"), F.lit("/"), "file_name").alias("path"), F.col("new_dir").isNull().alias("unmoved"))


@reg.add(f"WITH {fx.IMAGES} SELECT DISTINCT dir || '/' || file_name AS path, 'file' AS kind FROM images UNION ALL SELECT DISTINCT dir, 'folder' FROM images")
def relinkable_paths(spark, sf):
    i = fx.images(spark, sf)
    files = i.select(F.concat("dir", F.lit("/"), "file_name").alias("path"), F.lit("file").alias("kind")).distinct()
    return files.unionByName(i.select(F.col("dir").alias("path"), F.lit("folder").alias("kind")).distinct())


@reg.add(f"""WITH {fx.IMAGES}, {fx.LAYOUT} SELECT i.image_id, count(p.page_id) AS pages, coalesce(sum(p.content_w), 0) AS width_sum, bool_or(p.page_id IS NULL) AS lacking, bool_or(coalesce(p.content_w IS NULL, true) AND p.page_id IS NOT NULL) AS undefined FROM images i LEFT JOIN layout_params p USING (image_id) GROUP BY 1""")
def params_lookup(spark, sf):
    j = fx.images(spark, sf).join(fx.layout_params(spark, sf), "image_id", "left")
    return j.groupBy("image_id").agg(F.count("page_id").alias("pages"), F.coalesce(F.sum("content_w"), F.lit(0.0)).alias("width_sum"), F.bool_or(F.col("page_id").isNull()).alias("lacking"), F.bool_or(F.col("content_w").isNull() & F.col("page_id").isNotNull()).alias("undefined"))


@reg.add(f"WITH {fx.IMAGES}, {fx.LAYOUT} SELECT page_id FROM layout_params p SEMI JOIN (SELECT * FROM images WHERE status <> 'F') i USING (image_id)")
def settings_of_present_pages(spark, sf):
    return fx.layout_params(spark, sf).join(fx.images(spark, sf).where("status <> 'F'"), "image_id", "left_semi").select("page_id")


@reg.add(f"""WITH {fx.IMAGES}, {fx.LAYOUT} SELECT book, count(*) AS undefined_pages FROM images JOIN layout_params USING (image_id) WHERE content_w IS NULL GROUP BY book""")
def undefined_pages(spark, sf):
    j = fx.images(spark, sf).join(fx.layout_params(spark, sf).where("content_w is null"), "image_id")
    return j.groupBy("book").agg(F.count("*").alias("undefined_pages"))


@reg.add(f"""WITH {fx.IMAGES}, {POSITIONS}, project AS (SELECT book, image_id * 10 + ord AS key, pos FROM placed),
 prev AS (SELECT key, 100000 - pos AS old_pos, key % 3 = 0 AS ticked FROM project WHERE key % 4 <> 0),
 j AS (SELECT p.*, old_pos, ticked, last_value(old_pos IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM project p LEFT JOIN prev USING (key))
 SELECT book, key, row_number() OVER (PARTITION BY book ORDER BY coalesce(anchor, -1), old_pos IS NULL, pos) - 1 AS new_pos, coalesce(ticked, true) AS ticked FROM j""")
def export_order_merge(spark, sf):
    project = placed(spark, sf).select("book", (F.col("image_id") * 10 + F.col("ord")).alias("key"), "pos")
    previous = project.where("key % 4 <> 0").select("book", "key", (100000 - F.col("pos")).alias("pos"), (F.col("key") % 3 == 0).alias("ticked"))
    return c.merge_order(previous, project).withColumn("new_pos", F.col("new_pos").cast("long"))


@reg.add(f"""WITH {fx.LAYOUT}, s AS (SELECT avg(angle) AS m, stddev_samp(angle) AS sd FROM layout_params) SELECT page_id, round(abs(angle - m), 6) AS deviation, abs(angle - m) > greatest(1.5 * sd, 0.01 * m) AS deviant FROM layout_params, s""")
def deviant_pages(spark, sf):
    return c.deviations(fx.layout_params(spark, sf), "page_id", "angle", 1.5, 1.0, False).withColumn("deviation", F.round("deviation", 6))


SIZED = """sized AS (SELECT *, content_w + margin_l + margin_r AS hard_w, content_h + margin_t + margin_b AS hard_h FROM layout_params),
 agg AS (SELECT max(CASE WHEN align_null THEN 0 ELSE coalesce(hard_w, 0) END) AS agg_w, max(CASE WHEN align_null THEN 0 ELSE coalesce(hard_h, 0) END) AS agg_h FROM sized)"""


@reg.add(f"""WITH {fx.LAYOUT}, {SIZED}, d AS (SELECT *, greatest(agg_w - hard_w, 0) AS dw, greatest(agg_h - hard_h, 0) AS dh, align_null OR content_w IS NULL AS none FROM sized, agg)
 SELECT page_id, agg_w, agg_h, CASE WHEN none THEN 0 WHEN align_h = 'right' THEN dw WHEN align_h = 'hcenter' THEN dw * 0.5 ELSE 0 END AS soft_l, CASE WHEN none THEN 0 WHEN align_h = 'left' THEN dw WHEN align_h = 'hcenter' THEN dw * 0.5 ELSE 0 END AS soft_r,
 CASE WHEN none THEN 0 WHEN align_v = 'bottom' THEN dh WHEN align_v = 'vcenter' THEN dh * 0.5 ELSE 0 END AS soft_t, CASE WHEN none THEN 0 WHEN align_v = 'top' THEN dh WHEN align_v = 'vcenter' THEN dh * 0.5 ELSE 0 END AS soft_b FROM d""")
def page_margins(spark, sf):
    return c.soft_margins(fx.layout_params(spark, sf)).select("page_id", "agg_w", "agg_h", "soft_l", "soft_r", "soft_t", "soft_b")


@reg.add(f"""WITH {fx.LAYOUT}, {SIZED}, z AS (SELECT page_id, align_null, CASE WHEN align_null THEN 0 ELSE coalesce(hard_w, 0) END AS w, CASE WHEN align_null THEN 0 ELSE coalesce(hard_h, 0) END AS h FROM sized),
 lw AS (SELECT page_id AS lead_w FROM z ORDER BY w DESC, page_id LIMIT 1), lh AS (SELECT page_id AS lead_h FROM z ORDER BY h DESC, page_id LIMIT 1), m AS (SELECT max(w) AS mw, max(h) AS mh FROM z),
 rw AS (SELECT max(w) AS rw FROM z, lw WHERE page_id <> lead_w), rh AS (SELECT max(h) AS rh FROM z, lh WHERE page_id <> lead_h)
 SELECT page_id, CASE WHEN align_null OR page_id <> lead_w THEN mw ELSE greatest(w * 1.1, rw) END AS if_w, CASE WHEN align_null OR page_id <> lead_h THEN mh ELSE greatest(h * 1.1, rh) END AS if_h FROM z, lw, lh, m, rw, rh""")
def size_what_if(spark, sf):
    return c.aggregate_without(fx.layout_params(spark, sf)).select("page_id", "if_w", "if_h")


@reg.add(f"""WITH {fx.LAYOUT}, {SIZED}, r AS (SELECT *, least((agg_w - margin_l - margin_r) / content_w, (agg_h - margin_t - margin_b) / content_h) AS fit FROM sized, agg)
 SELECT page_id, round(CASE WHEN content_w IS NULL THEN 1 ELSE least(greatest(CASE WHEN abs(fit - 1) < 1e-6 THEN 1 ELSE fit END, 0.8), 1.5) END, 6) AS factor FROM r""")
def scale_to_fit(spark, sf):
    p = fx.layout_params(spark, sf)
    j = p.crossJoin(F.broadcast(c.aggregate_size(p)))
    col = F.col
    factor = c.scale_factor((col("content_w"), col("content_h")), (col("agg_w"), col("agg_h")), (col("margin_l") + col("margin_r"), col("margin_t") + col("margin_b")), 80, 150, True)
    return j.select("page_id", F.round(factor, 6).alias("factor"))


@reg.add(None)
def natural_file_order(spark, sf):
    i = fx.images(spark, sf)
    return i.select("book", "image_id", F.row_number().over(Window.partitionBy("book").orderBy(c.natural_key(F.col("file_name")), "file_name", "image_id")).cast("long").alias("place"))


@reg.add(f"""WITH {fx.IMAGES}, {fx.LAYOUT}, j AS (SELECT book, page_id, content_w, content_h, abs(angle - avg(angle) OVER (PARTITION BY book)) AS dev, content_w IS NULL AS incomplete FROM images JOIN layout_params USING (image_id))
 SELECT book, page_id, rank() OVER (PARTITION BY book ORDER BY incomplete, page_id) AS by_complete, rank() OVER (PARTITION BY book ORDER BY content_w ASC NULLS LAST, page_id) AS by_width, rank() OVER (PARTITION BY book ORDER BY content_h DESC NULLS LAST, page_id) AS by_height_desc FROM j""")
def page_orders(spark, sf):
    pages = fx.layout_params(spark, sf).select("image_id", "page_id", "content_w", "content_h")
    tasks = -(-pages.count() // PAGES_A_TASK) + 1
    out = fx.images(spark, sf).select("image_id", "book").repartition(tasks, "image_id").join(pages.repartition(tasks, "image_id"), "image_id").drop("image_id")
    piece = F.coalesce(F.floor(F.col("page_id") / 1_000_000), F.lit(1 << 62))
    out = c.with_rank(out, "by_complete", "book", [F.col("content_w").isNull(), piece], "page_id", tasks)
    out = c.with_rank(out, "by_width", "book", [F.col("content_w").isNull(), F.coalesce("content_w", F.lit(0.0))], "page_id", tasks)
    out = c.with_rank(out, "by_height_desc", "book", [F.col("content_h").isNull(), -F.coalesce("content_h", F.lit(0.0))], "page_id", tasks)
    return out.select("book", "page_id", "by_complete", "by_width", "by_height_desc")


@reg.add("""WITH opened AS (SELECT user_id, event_type AS project, max(ts) AS last_ts FROM events GROUP BY 1, 2) SELECT user_id, project, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, project) AS place FROM opened QUALIFY place <= 3""")
def recent_projects(spark, sf):
    opened = fx.table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("project")).agg(F.max("ts").alias("last_ts"))
    return opened.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last_ts").desc(), "project")).cast("long")).where("place <= 3").drop("last_ts")


@reg.add(f"""WITH {fx.IMAGES}, {PAGES}, stems AS (SELECT *, regexp_extract(file_name, '^([^.]*)', 1) AS stem FROM pages_view),
 labels AS (SELECT image_id, row_number() OVER (PARTITION BY lower(regexp_extract(file_name, '^([^.]*)', 1)) ORDER BY dir, file_name, image_id) - 1 AS label FROM images)
 SELECT image_id, sub_page, stem || CASE WHEN label > 0 THEN '(' || label || ')' ELSE '' END || CASE WHEN file_page > 0 THEN '_page' || lpad(CAST(file_page AS VARCHAR), 4, '0') ELSE '' END ||
 CASE sub_page WHEN 'left' THEN '_1L' WHEN 'right' THEN '_2R' ELSE '' END || '.tif' AS output FROM stems JOIN labels USING (image_id)""")
def output_names(spark, sf):
    i = fx.images(spark, sf).withColumn("stem", F.regexp_extract("file_name", r"^([^.]*)", 1))
    labelled = c.name_labels(i.withColumn("file_id", F.col("image_id")))
    p = c.logical_pages(labelled)
    name = c.output_name(F.col("stem"), F.col("label"), F.col("file_page"), F.col("file_page") > 0, F.col("sub_page"))
    return p.select("image_id", "sub_page", name.alias("output"))


@reg.add(f"""WITH {fx.IMAGES} SELECT image_id, CASE WHEN width % 5 = 0 THEN 'MISSING' WHEN width % 3 = 0 THEN 'BITONAL' WHEN height % 7 = 0 THEN 'PALETTE' WHEN sub_pages = 2 THEN 'MRC' ELSE 'IMAGE' END AS kind FROM images""")
def export_kinds(spark, sf):
    f = F.col
    kind = F.when(f("width") % 5 == 0, "MISSING").when(f("width") % 3 == 0, "BITONAL").when(f("height") % 7 == 0, "PALETTE").when(f("sub_pages") == 2, "MRC").otherwise("IMAGE")
    return fx.images(spark, sf).select("image_id", kind.alias("kind"))


@reg.add(f"""WITH {fx.IMAGES} SELECT status, count(*) AS failures, count(DISTINCT book) AS books, string_agg(DISTINCT dir, ',' ORDER BY dir) AS reasons FROM images WHERE dpi_x <= 1 OR dpi_y <= 1 GROUP BY status""")
def failures_by_kind(spark, sf):
    bad = fx.images(spark, sf).where("dpi_x <= 1 or dpi_y <= 1")
    return bad.groupBy("status").agg(F.count("*").alias("failures"), F.count_distinct("book").alias("books"), F.array_join(F.sort_array(F.collect_set("dir")), ",").alias("reasons"))


@reg.add(f"""WITH {fx.IMAGES} SELECT dir, file_name, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY file_page, image_id) AS members, count(*) AS images FROM images GROUP BY 1, 2""")
def images_by_file(spark, sf):
    g = fx.images(spark, sf).groupBy("dir", "file_name").agg(F.sort_array(F.collect_list(F.struct("file_page", "image_id"))).alias("m"), F.count("*").alias("images"))
    return g.select("dir", "file_name", F.array_join(F.transform("m", lambda s: s["image_id"].cast("string")), ",").alias("members"), "images")


@reg.add("""SELECT doc_id, array_to_string(list_sort(list_filter(['de', 'en', 'fr', 'it'], lambda x: x <> lang)), '+') AS missing FROM documents""")
def missing_languages(spark, sf):
    have = F.array("lang")
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(F.sort_array(F.array_except(F.array(*map(F.lit, ("de", "en", "fr", "it"))), have)), "+").alias("missing"))


@reg.add("""SELECT source, count(DISTINCT lang) AS languages FROM documents WHERE lang IN ('de', 'en') GROUP BY source HAVING count(DISTINCT lang) = 2""")
def common_language_folders(spark, sf):
    return fx.table(spark, sf, "documents").where("lang in ('de', 'en')").groupBy("source").agg(F.count_distinct("lang").alias("languages")).where("languages = 2")


@reg.add(f"""WITH {fx.IMAGES} SELECT image_id, CASE image_id % 5 WHEN 0 THEN CAST(width AS DOUBLE) WHEN 1 THEN width * 10.0 WHEN 2 THEN width * 25.4 WHEN 3 THEN CASE WHEN dpi_x > 0 THEN width * 25.4 / dpi_x END END AS mm FROM images""")
def unit_conversion(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("mm", "cm", "in", "px", "pt"))), (F.col("image_id") % 5 + 1).cast("int"))
    return fx.images(spark, sf).select("image_id", c.units_to_mm(F.col("width").cast("double"), unit, F.col("dpi_x")).alias("mm"))


@reg.add("""SELECT event_id, least(greatest(coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE '' END || CAST(user_id AS VARCHAR) AS DOUBLE), 7), 10), 100) AS n FROM events""")
def numbers_in_range(spark, sf):
    raw = F.concat(F.when(F.col("event_id") % 4 == 0, "x").otherwise(""), F.col("user_id").cast("string"))
    return fx.table(spark, sf, "events").select("event_id", F.least(F.greatest(F.coalesce(raw.try_cast("double"), F.lit(7.0)), F.lit(10.0)), F.lit(100.0)).alias("n"))


@reg.add(f"""WITH {fx.LAYOUT}, e AS (SELECT page_id, margin_l < 14 AS gray, margin_t / 10 AS midtone, margin_b / 20 AS dark, margin_r / 13 AS light, content_w / 200 AS coverage, margin_l / 20 AS largest, page_no AS tiles FROM layout_params)
 SELECT page_id, CASE WHEN NOT gray THEN 'color' WHEN NOT (midtone < 0.45 AND ((dark > 0.10 AND light > 0.30) OR light > 0.70)) THEN 'gray' WHEN midtone >= 0.10 OR coverage >= 0.70 OR largest >= 0.70 OR tiles >= 45 THEN 'gray'
 WHEN tiles >= 2 AND (dark >= 0.08 OR tiles >= 3) AND coverage >= 0.06 THEN 'mixed' ELSE 'bw' END AS mode FROM e""")
def colour_modes(spark, sf):
    f = F.col
    mode = c.colour_mode(f("margin_l") < 14, f("margin_t") / 10, f("margin_b") / 20, f("margin_r") / 13, f("content_w") / 200, f("margin_l") / 20, f("page_no"))
    return fx.layout_params(spark, sf).select("page_id", mode.alias("mode"))


@reg.add("""WITH z AS (SELECT l_orderkey, l_partkey % 5 AS x, l_suppkey % 5 AS y FROM lineitem), a AS (SELECT * FROM z WHERE x < 3), b AS (SELECT * FROM z WHERE y < 4),
 d AS (SELECT l_orderkey FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION SELECT l_orderkey FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
 SELECT o_orderkey AS image_id, d.l_orderkey IS NULL AS equal FROM orders LEFT JOIN d ON d.l_orderkey = o_orderkey""")
def equal_zone_sets(spark, sf):
    z = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 5).alias("x"), (F.col("l_suppkey") % 5).alias("y"))
    a, b = z.where("x < 3"), z.where("y < 4")
    differ = a.exceptAll(b).select("image_id").union(b.exceptAll(a).select("image_id")).distinct().withColumn("d", F.lit(True))
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id")).join(differ, "image_id", "left").select("image_id", F.col("d").isNull().alias("equal"))


@reg.add("""WITH dirs AS (SELECT DISTINCT o_orderpriority AS dir FROM orders), ids AS (SELECT dir, row_number() OVER (ORDER BY dir) AS dir_id FROM dirs)
 SELECT dir_id, o_orderkey AS image_id, row_number() OVER (PARTITION BY dir_id ORDER BY o_orderkey) AS file_id FROM orders JOIN ids ON dir = o_orderpriority""")
def project_ids(spark, sf):
    i = fx.images(spark, sf).select("dir", "image_id")
    dirs = i.select("dir").distinct().withColumn("dir_id", F.row_number().over(Window.orderBy("dir")).cast("long"))  # one row a folder
    return i.join(F.broadcast(dirs), "dir").select("dir_id", "image_id", F.row_number().over(Window.partitionBy("dir_id").orderBy("image_id")).cast("long").alias("file_id"))


@reg.add("""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 4 ORDER BY l_linenumber, l_suppkey, l_partkey) AS rn FROM lineitem), ok AS (SELECT * FROM ranked WHERE rn = 1 AND l_suppkey % 9 <> 0)
 SELECT o.o_orderkey AS image_id, count(ok.l_orderkey) AS pages, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) - count(ok.l_orderkey) AS skipped FROM orders o LEFT JOIN ok ON ok.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def project_rows_resolved(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rn = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_partkey") % 4).orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    good = li.withColumn("good", (rn == 1) & (F.col("l_suppkey") % 9 != 0)).groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count_if("good").alias("pages"), F.count_if(~F.col("good")).alias("skipped"))
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    return o.join(good, "image_id", "left").select("image_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("skipped", F.lit(0)).alias("skipped"))
