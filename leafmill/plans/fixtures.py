"""Pages, images and step settings synthesised from plain tables, and the same as SQL.

Every definition exists twice, as a DataFrame and as a common table expression, so that
a query and the SQL it is compared with start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scanned image an order: file, size, resolution, number of logical pages, removed half."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ext = F.element_at(F.array(*map(F.lit, (".tif", ".png", ".jpg", ".TIFF", ".txt"))), (k % 5 + 1).cast("int"))
    return o.select(
        k.alias("image_id"), F.col("o_orderpriority").alias("dir"), F.concat(F.lit("scan"), k % 97, F.lit("_"), c % 1000, ext).alias("file_name"), (k % 3).cast("int").alias("file_page"),
        (600 + k * 37 % 2800).cast("int").alias("width"), (800 + c * 53 % 2800).cast("int").alias("height"),
        F.when(k % 101 == 0, 12000).otherwise(k % 14 * 50).cast("int").alias("dpi_x"), (c % 13 * 50).cast("int").alias("dpi_y"),
        (1 + k % 2).cast("int").alias("sub_pages"), F.when((k % 2 == 0) & (c % 7 == 0), "L").when((k % 2 == 0) & (c % 7 == 1), "R").otherwise("").alias("removed"), c.alias("owner"), F.col("o_orderstatus").alias("status"), F.concat(F.col("o_orderpriority"), F.lit("/"), c % 64).alias("book"),
    )


IMAGES = """images AS (SELECT o_orderkey AS image_id, o_orderpriority AS dir,
  'scan' || (o_orderkey % 97) || '_' || (o_custkey % 1000) || ['.tif', '.png', '.jpg', '.TIFF', '.txt'][o_orderkey % 5 + 1] AS file_name,
  CAST(o_orderkey % 3 AS INT) AS file_page, CAST(600 + o_orderkey * 37 % 2800 AS INT) AS width, CAST(800 + o_custkey * 53 % 2800 AS INT) AS height,
  CAST(CASE WHEN o_orderkey % 101 = 0 THEN 12000 ELSE o_orderkey % 14 * 50 END AS INT) AS dpi_x, CAST(o_custkey % 13 * 50 AS INT) AS dpi_y,
  CAST(1 + o_orderkey % 2 AS INT) AS sub_pages,
  CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 7 = 0 THEN 'L' WHEN o_orderkey % 2 = 0 AND o_custkey % 7 = 1 THEN 'R' ELSE '' END AS removed, o_custkey AS owner, o_orderstatus AS status,
  o_orderpriority || '/' || (o_custkey % 64) AS book FROM orders)"""


def layout_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins, content size and alignment of a page for each order line; some sizes unknown."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("page_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_id"),
        (5 + p % 11).cast("double").alias("margin_l"), (5 + s % 7).cast("double").alias("margin_r"), (3 + p % 5).cast("double").alias("margin_t"), (3 + s % 6).cast("double").alias("margin_b"),
        F.when(p % 17 == 0, None).otherwise(100 + p % 90).cast("double").alias("content_w"), F.when(p % 17 == 0, None).otherwise(150 + s % 110).cast("double").alias("content_h"),
        (p % 19 == 0).alias("align_null"), F.element_at(F.array(*map(F.lit, ("left", "hcenter", "right"))), (p % 3 + 1).cast("int")).alias("align_h"), F.element_at(F.array(*map(F.lit, ("top", "vcenter", "bottom"))), (s % 3 + 1).cast("int")).alias("align_v"),
        (F.col("l_quantity") / 10).alias("angle"),
    )


LAYOUT = """layout_params AS (SELECT l_orderkey AS image_id, l_linenumber AS page_no, l_orderkey * 10 + l_linenumber AS page_id,
  CAST(5 + l_partkey % 11 AS DOUBLE) AS margin_l, CAST(5 + l_suppkey % 7 AS DOUBLE) AS margin_r, CAST(3 + l_partkey % 5 AS DOUBLE) AS margin_t, CAST(3 + l_suppkey % 6 AS DOUBLE) AS margin_b,
  CAST(CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 100 + l_partkey % 90 END AS DOUBLE) AS content_w, CAST(CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 150 + l_suppkey % 110 END AS DOUBLE) AS content_h,
  l_partkey % 19 = 0 AS align_null, ['left', 'hcenter', 'right'][l_partkey % 3 + 1] AS align_h, ['top', 'vcenter', 'bottom'][l_suppkey % 3 + 1] AS align_v, l_quantity / 10 AS angle FROM lineitem)"""


def text_pixels(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """Whole documents as pages of a fixed width: one pixel a character, gray by its code point, white where it is blank."""
    docs = text_pages(spark, sf_dir)
    chars = docs.select("page_id", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    blank = F.col("ch").isin(" ", "\t", "\n", "\r", "\v", "\f")
    return chars.select("page_id", F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), F.when(blank, 255).otherwise(F.ascii("ch") % 200).alias("v"), F.when(blank, 0).otherwise(1).alias("black"))


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as (page_id, text), for kernels on whole texts."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")


TEXT_PIXELS = r"""text_chars AS (SELECT doc_id AS page_id, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS pos FROM documents),
text_pixels AS (SELECT page_id, CAST(pos // 64 AS INT) AS y, CAST(pos % 64 AS INT) AS x,
  CASE WHEN ch IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 255 ELSE unicode(ch) % 200 END AS v,
  CASE WHEN ch IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 0 ELSE 1 END AS black FROM text_chars)"""


def vector_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a gray page of 8 by 8; black is what is darker than the middle."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("pos", "e"))
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    return e.select("page_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), v.alias("v")).withColumn("black", F.when(F.col("v") < 128, 1).otherwise(0))


def vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as rows: page_id, height, width, and their pixels v and black as arrays."""
    tone = lambda e: F.least(F.greatest(F.floor((e.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.transform("embedding", tone).alias("v"))
    return e.select("page_id", F.floor(F.size("v") / 8).cast("int").alias("height"), F.lit(8).alias("width"), "v", F.transform("v", lambda v: F.when(v < 128, 1).otherwise(0)).alias("black"))


VECTOR_PIXELS = """vector_raw AS (SELECT vec_id AS page_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings),
pixels AS (SELECT page_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, v, CASE WHEN v < 128 THEN 1 ELSE 0 END AS black
  FROM (SELECT *, CAST(least(greatest(floor((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS INT) AS v FROM vector_raw))"""


def colour_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector pages in colour: the gray and two others derived from it and the place."""
    p = vector_pixels(spark, sf_dir)
    return p.select("page_id", "y", "x", F.col("v").alias("r"), ((F.col("v") * 3 + F.col("x") * 17) % 256).alias("g"), ((F.col("v") * 5 + F.col("y") * 29) % 256).alias("b"))


COLOUR_PIXELS = VECTOR_PIXELS + """,
colours AS (SELECT page_id, y, x, v AS r, (v * 3 + x * 17) % 256 AS g, (v * 5 + y * 29) % 256 AS b FROM pixels)"""
