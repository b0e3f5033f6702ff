"""Projects kept as XML: read into tables of folders, files, images and pages, and written back.

Rows that lack a usable id, or name one that isn't there, are skipped and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCHEMAS = {
    "directory": "_id string, _path string",
    "file": "_id string, _dirId string, _name string",
    "image": "_id string, _fileId string, _fileImage string, _subPages string, _removed string",
    "page": "_id string, _imageId string, _subPage string",
}


def read_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """All elements of a tag, as strings."""
    return spark.read.format("xml").option("rowTag", tag).schema(SCHEMAS[tag]).load(path)


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """directories, files, images, pages and skipped (kind, n)."""
    number = lambda c: F.col(c).try_cast("int")
    raw = {t: read_rows(spark, path, t) for t in SCHEMAS}
    dirs = raw["directory"].select(number("_id").alias("dir_id"), F.col("_path").alias("dir")).where("dir_id is not null")
    files = raw["file"].select(number("_id").alias("file_id"), number("_dirId").alias("dir_id"), F.col("_name").alias("name")).where("file_id is not null").join(dirs, "dir_id")
    images = raw["image"].select(number("_id").alias("image_id"), number("_fileId").alias("file_id"), F.coalesce(number("_fileImage"), F.lit(0)).alias("file_page"), number("_subPages").alias("sub_pages"), F.coalesce("_removed", F.lit("")).alias("removed"))
    images = images.where("image_id is not null and sub_pages between 1 and 2").join(files, "file_id")
    images = images.withColumn("__n", F.row_number().over(Window.partitionBy("file_id", "file_page").orderBy("image_id"))).where("__n = 1").drop("__n")
    pages = raw["page"].select(number("_id").alias("page_id"), number("_imageId").alias("image_id"), F.coalesce("_subPage", F.lit("single")).alias("sub_page")).where("page_id is not null and sub_page in ('single', 'left', 'right')").join(images, "image_id")
    kept = {"directory": dirs, "file": files, "image": images, "page": pages}
    skipped = None
    for kind, df in kept.items():
        n = raw[kind].agg(F.count("*").alias("a")).crossJoin(df.agg(F.count("*").alias("b"))).select(F.lit(kind).alias("kind"), (F.col("a") - F.col("b")).alias("n"))
        skipped = n if skipped is None else skipped.unionByName(n)
    return {"directories": dirs, "files": files, "images": images, "pages": pages, "skipped": skipped}


def write_images(images: DataFrame, path: str) -> None:
    """Images as elements with surrogate ids by folder and name."""
    rows = images.select(F.concat_ws("/", "dir", "name").alias("_file"), F.col("image_id").alias("_id"), F.col("sub_pages").alias("_subPages"), F.col("removed").alias("_removed"))
    rows.write.format("xml").option("rootTag", "images").option("rowTag", "image").mode("overwrite").save(path)


_RECT = "struct<_x: string, _y: string, _width: string, _height: string>"
#: What a step keeps of a page: its parameters as XML has them, the attribute that tells the step, and columns with their types.
STEPS = {
    "content": (
        f"_contentDetectionMode string, _pageDetectionMode string, _fineTuneCorners string, `content-rect` {_RECT}, `page-rect` {_RECT}", "_contentDetectionMode",
        {"content_mode": ("_contentDetectionMode", "string"), "page_mode": ("_pageDetectionMode", "string"), "corners": ("_fineTuneCorners", "int")} | {f"{kind}_{side}": (f"`{kind}-rect`._{side}", "double") for kind in ("content", "page") for side in ("x", "y", "width", "height")},
    ),
    "layout": (
        "_autoMargins string, hardMarginsMM struct<_left: string, _top: string, _right: string, _bottom: string>, alignment struct<_hor: string, _vert: string, _null: string>", "_autoMargins",
        {"auto_margins": ("_autoMargins", "int"), "align_h": ("alignment._hor", "string"), "align_v": ("alignment._vert", "string"), "align_null": ("alignment._null", "int")} | {f"margin_{side[0]}": (f"hardMarginsMM._{side}", "double") for side in ("left", "top", "right", "bottom")},
    ),
    "output": (
        "_blackOnWhite string, _despeckleLevel string, _depthPerception string, dpi struct<_horizontal: string, _vertical: string>, `color-params` struct<_colorMode: string, bw: struct<_binarizationMethod: string, _windowSize: string, _sauvolaCoef: string, _thresholdAdj: string>>", "_despeckleLevel",
        {"black_on_white": ("_blackOnWhite", "int"), "despeckle": ("_despeckleLevel", "double"), "depth": ("_depthPerception", "double"), "dpi_x": ("dpi._horizontal", "int"), "dpi_y": ("dpi._vertical", "int"), "color_mode": ("`color-params`._colorMode", "string")}
        | {name: (f"`color-params`.bw._{attribute}", kind) for name, attribute, kind in (("method", "binarizationMethod", "string"), ("window", "windowSize", "int"), ("coef", "sauvolaCoef", "double"), ("delta", "thresholdAdj", "int"))},
    ),
}


def read_settings(spark: SparkSession, path: str, step: str) -> DataFrame:
    """(page_id, ...) of a step's parameters. Rows without a usable id are left out, values that can't be read are null; the last row of a page counts."""
    schema, marker, columns = STEPS[step]
    rows = spark.read.format("xml").option("rowTag", "page").schema(f"_id string, params struct<{_struct(schema)}>").load(path)
    typed = [F.expr(f"try_cast(params.{where} AS {kind})").alias(name) for name, (where, kind) in columns.items()]
    found = rows.where(F.col(f"params.{marker}").isNotNull()).select(F.col("_id").try_cast("int").alias("page_id"), F.monotonically_increasing_id().alias("__n"), *typed).where("page_id is not null")
    last = Window.partitionBy("page_id").orderBy(F.desc("__n"))
    return found.withColumn("__last", F.row_number().over(last)).where("__last = 1").drop("__last", "__n")


def _struct(columns: str) -> str:
    """Columns of a schema as fields of a struct."""
    import re

    parts, depth, out = columns.split(", "), 0, []
    for part in parts:
        out.append(re.sub(r"^(`[^`]+`|\S+) ", r"\1: ", part) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)
