"""Operators on the project catalogue: images, their logical pages and the settings of each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Limits of a page and of its resolution.
MAX_SIDE, MAX_PIXELS = 32767, 600_000_000
SUB_PAGES = ("single", "left", "right")
IMAGE_TYPES = ("tif", "tiff", "png", "jpg", "jpeg", "jp2")


def dpi_status(pixels: Column, dpi: Column) -> Column:
    """What is wrong with a resolution, if anything."""
    scaled = F.ceil(pixels * 300.0 / dpi)
    return (
        F.when(dpi <= 1, "UNDEFINED").when((dpi < 300) & (scaled > MAX_SIDE), "TOO_SMALL_TO_PROCESS").when(dpi < 150, "TOO_SMALL")
        .when(dpi > 9999, "TOO_LARGE").when(25.4 * pixels / dpi > 500, "TOO_SMALL_FOR_THIS_PIXEL_SIZE").otherwise("OK")
    )


def with_metadata_checks(images: DataFrame) -> DataFrame:
    """dpi_status of both axes, whether they can be processed, size limit and advised number of pages."""
    bad = ("UNDEFINED", "TOO_SMALL_TO_PROCESS")
    out = images.withColumn("status_x", dpi_status(F.col("width"), F.col("dpi_x"))).withColumn("status_y", dpi_status(F.col("height"), F.col("dpi_y")))
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    return out.withColumns({
        "dpi_ok": ~F.col("status_x").isin(*bad) & ~F.col("status_y").isin(*bad),
        "too_big": (w > MAX_SIDE) | (h > MAX_SIDE) | (w * h > MAX_PIXELS),
        "advised_pages": F.when(w * F.col("dpi_y") > h * F.col("dpi_x"), 2).otherwise(1),
    })


def importable(listing: DataFrame, name: str = "file_name") -> DataFrame:
    """Files whose extension is that of an image format."""
    return listing.where(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*IMAGE_TYPES))


def logical_pages(images: DataFrame, right_to_left: bool = False) -> DataFrame:
    """One row for each logical page, in reading order within its image (ord from 0)."""
    both = ("right", "left") if right_to_left else ("left", "right")
    one = F.when(F.col("removed") == "L", "right").when(F.col("removed") == "R", "left").otherwise("single")
    pages = F.when(F.col("sub_pages") == 2, F.array(*map(F.lit, both))).otherwise(F.array(one))
    return images.select("*", F.posexplode(pages).alias("ord", "sub_page"))


def sub_page_rank(sub_page: Column) -> Column:
    """Place of a sub-page in sort keys."""
    return F.when(sub_page == "single", 0).when(sub_page == "left", 1).when(sub_page == "right", 2)


def with_positions(pages: DataFrame, keys: list[str], book: str = "book") -> DataFrame:
    """pos: the page's place, from 0, in its book, the unit that is opened and sorted as one."""
    return pages.withColumn("pos", F.row_number().over(Window.partitionBy(book).orderBy(*keys)) - 1)


def with_rank(pages: DataFrame, out: str, book: str, keys: list[Column], last: str, tasks: int) -> DataFrame:
    """pages with out: rank() in the book by keys, which hold no nulls, and last; rows are dealt to so many tasks.

    Rows are ranked among those with the same keys, and what has smaller keys is counted: a large book is no one task's,
    and a key can be any column that never falls as last rises.
    """
    named = {"__none": F.col(book).isNull(), "__book": F.coalesce(book, F.lit(""))} | {f"__key{i}": key for i, key in enumerate(keys)}
    names = list(named)
    keyed = pages.withColumns(named).repartition(tasks, *names)
    counts = keyed.groupBy(*names).agg(F.count("*").alias("__rows"))
    above = Window.partitionBy("__none", "__book").orderBy(*names[2:]).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*names, F.coalesce(F.sum("__rows").over(above), F.lit(0)).alias("__before"))
    own = F.rank().over(Window.partitionBy(*names).orderBy(F.col(last).asc_nulls_last()))
    return keyed.withColumn(out, own.cast("long")).join(before, names).withColumn(out, F.col(out) + F.col("__before")).drop(*names, "__before")


def remove_pages(images: DataFrame, removed: DataFrame) -> DataFrame:
    """Images after removing pages (image_id, sub_page): single removes the image, a half only if it is shown."""
    gone = removed.groupBy("image_id").agg(F.bool_or(F.col("sub_page") == "single").alias("s"), F.bool_or(F.col("sub_page") == "left").alias("l"), F.bool_or(F.col("sub_page") == "right").alias("r"))
    j = images.join(gone, "image_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in "slr"})
    left = F.when(F.col("sub_pages") == 2, True).otherwise(F.col("removed") == "R")
    right = F.when(F.col("sub_pages") == 2, True).otherwise(F.col("removed") == "L")
    cut_l, cut_r = left & F.col("l"), right & F.col("r")
    count = F.col("sub_pages") - cut_l.cast("int") - cut_r.cast("int")
    side = F.when(cut_l & ~cut_r, "L").when(cut_r & ~cut_l, "R").otherwise(F.col("removed"))
    out = j.withColumn("n", F.when(F.col("s"), 0).otherwise(count)).withColumn("removed", side).where("n > 0")
    return out.withColumn("sub_pages", F.col("n").cast("int")).drop("s", "l", "r", "n")


def unremove_pages(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images with removed halves (image_id, sub_page) shown again: only where one page is left and that half went."""
    back = wanted.groupBy("image_id").agg(F.bool_or(F.col("sub_page") == "left").alias("l"), F.bool_or(F.col("sub_page") == "right").alias("r"))
    j = images.join(back, "image_id", "left")
    hit = F.coalesce((F.col("sub_pages") == 1) & (((F.col("removed") == "L") & F.col("l")) | ((F.col("removed") == "R") & F.col("r"))), F.lit(False))
    return j.withColumns({"sub_pages": F.when(hit, 2).otherwise(F.col("sub_pages")), "removed": F.when(hit, "").otherwise(F.col("removed"))}).drop("l", "r")


def every_other(pages: DataFrame, base: Column, pos: str = "pos") -> Column:
    """Whether a page is an even number of places from the base."""
    return F.pmod(F.col(pos) - base, F.lit(2)) == 0


def natural_key(path: Column) -> Column:
    """Sort key of a file name: digits before others, digit runs by value, then the raw name."""
    runs = F.regexp_extract_all(path, F.lit(r"[0-9]+|[^0-9]"), F.lit(0))
    bare = lambda t: F.regexp_replace(t, r"^0+(?=[0-9])", "")
    token = lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare(t)).cast("string"), 3, "0"), bare(t))).otherwise(F.concat(F.lit("1"), t))
    return F.transform(runs, token)


def deviations(values: DataFrame, key: str, value: str, coefficient: float, threshold: float, absolute: bool, default: bool = False) -> DataFrame:
    """deviation and deviant of each key, against mean and sample deviation of all known values (three at least)."""
    known = values.where(F.col(value).isNotNull() & ~F.isnan(value)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    j = values.crossJoin(F.broadcast(known))  # one row
    unknown = F.col(value).isNull() | F.isnan(value)
    apart = F.abs(F.col(value) - F.col("mean"))
    limit = F.greatest(coefficient * F.col("sd"), F.lit(threshold) if absolute else threshold / 100 * F.col("mean"))
    deviation = F.when(unknown, -1.0).when(F.col("n") < 3, 0.0).otherwise(apart)
    deviant = F.when(unknown, default).when(F.col("n") < 3, False).otherwise(apart > limit)
    return j.select(key, deviation.alias("deviation"), deviant.alias("deviant"))


def hard_sizes(params: DataFrame) -> DataFrame:
    return params.withColumns({"hard_w": F.col("content_w") + F.col("margin_l") + F.col("margin_r"), "hard_h": F.col("content_h") + F.col("margin_t") + F.col("margin_b")})


def aggregate_size(params: DataFrame) -> DataFrame:
    """Largest width and height of the aligned pages, each on its own; 0 without any."""
    sized = hard_sizes(params)
    most = lambda c: F.coalesce(F.max(F.when(~F.col("align_null"), F.coalesce(c, F.lit(0.0))).otherwise(0.0)), F.lit(0.0))
    return sized.agg(most("hard_w").alias("agg_w"), most("hard_h").alias("agg_h"))


def soft_margins(params: DataFrame) -> DataFrame:
    """What alignment adds to each side of a page to reach the common size. One pass for the size, one for the pages."""
    j = hard_sizes(params).crossJoin(F.broadcast(aggregate_size(params)))  # one row
    share = {"left": (0.0, 1.0), "hcenter": (0.5, 0.5), "right": (1.0, 0.0), "top": (0.0, 1.0), "vcenter": (0.5, 0.5), "bottom": (1.0, 0.0)}

    def side(align: str, room: Column, which: int) -> Column:
        out = F.lit(0.0)
        for name, parts in share.items():
            out = F.when(F.col(align) == name, room * parts[which]).otherwise(out)
        return F.when(F.col("align_null") | F.col("content_w").isNull(), 0.0).otherwise(out)

    dw, dh = (F.greatest(F.col(a) - F.col(h), F.lit(0.0)) for a, h in (("agg_w", "hard_w"), ("agg_h", "hard_h")))
    return j.withColumns({"soft_l": side("align_h", dw, 0), "soft_r": side("align_h", dw, 1), "soft_t": side("align_v", dh, 0), "soft_b": side("align_v", dh, 1)})


def aggregate_without(params: DataFrame) -> DataFrame:
    """For each page the common size if that page grew by a tenth: the old one unless the page leads an axis, else the runner-up or its new size."""
    p = hard_sizes(params).withColumns({c: F.when(F.col("align_null"), 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in ("hard_w", "hard_h")})
    out = p
    for c, a in (("hard_w", "if_w"), ("hard_h", "if_h")):
        best = p.agg(F.max_by("page_id", F.struct(c, -F.col("page_id"))).alias("leader"), F.max(c).alias("most"))
        second = p.join(F.broadcast(best), F.col("page_id") != F.col("leader")).agg(F.max(c).alias("runner"))
        out = out.crossJoin(F.broadcast(best.crossJoin(second)))
        grown = F.col(c) * 1.1
        out = out.withColumn(a, F.when(F.col("align_null") | (F.col("page_id") != F.col("leader")), F.col("most")).otherwise(F.greatest(grown, F.coalesce("runner", F.lit(0.0))))).drop("leader", "most", "runner")
    return out


def scale_factor(content: tuple[Column, Column], common: tuple[Column, Column], margins: tuple[Column, Column], least: float, most: float, fit: bool) -> Column:
    """By what a page's content is scaled to fill the common size, within limits."""
    ratio = F.least((common[0] - margins[0]) / content[0], (common[1] - margins[1]) / content[1])
    near = F.when(F.abs(ratio - 1) < 1e-6, 1.0).otherwise(ratio)
    return F.when(content[0].isNull() | (content[0] <= 0) | (content[1] <= 0), 1.0).otherwise(F.least(F.greatest(near, F.lit(least / 100)), F.lit(most / 100 if fit else 1.0)))


def output_name(stem: Column, label: Column, page: Column, multi: Column, sub_page: Column, right_to_left: bool = False) -> Column:
    """Name of a page's output file."""
    first, second = ("right", "left") if right_to_left else ("left", "right")
    suffix = F.when(sub_page == first, F.lit("_1" + first[0].upper())).when(sub_page == second, F.lit("_2" + second[0].upper())).otherwise("")
    return F.concat(stem, F.when(label > 0, F.concat(F.lit("("), label, F.lit(")"))).otherwise(""), F.when(multi, F.concat(F.lit("_page"), F.lpad(page.cast("string"), 4, "0"))).otherwise(""), suffix, F.lit(".tif"))


def name_labels(files: DataFrame) -> DataFrame:
    """label: the number, from 0, that tells a file from earlier ones of the same stem in any case."""
    return files.withColumn("label", F.row_number().over(Window.partitionBy(F.lower("stem")).orderBy("dir", "file_name", "file_id")) - 1)


def merge_order(previous: DataFrame, project: DataFrame) -> DataFrame:
    """Order of an export: the earlier order of the pages that are left, new ones directly after their project neighbour.

    previous has pos, key, ticked; project has book, pos, key. A new page follows the nearest
    earlier project page that is old; new ones without such a page come first.
    """
    kept = previous.groupBy("key").agg(F.min("pos").alias("old_pos"), F.min_by("ticked", "pos").alias("ticked"))
    seq = Window.partitionBy("book").orderBy("pos")
    j = project.join(kept, "key", "left")
    j = j.withColumn("anchor", F.coalesce(F.last("old_pos", ignorenulls=True).over(seq), F.lit(-1))).withColumn("fresh", F.col("old_pos").isNull())
    new_order = Window.partitionBy("book").orderBy("anchor", "fresh", "pos")
    return j.select("book", "key", (F.row_number().over(new_order) - 1).alias("new_pos"), F.coalesce("ticked", F.lit(True)).alias("ticked"))


def name_problem(name: Column) -> Column:
    """Why a file name can't be used, or null."""
    upper = F.upper(F.regexp_extract(name, r"^([^.]*)", 1))
    return (
        F.when(name == "", "empty").when(name.isin(".", ".."), "dots").when(name.rlike(r'[<>:"/\\|?*\x00-\x1f]'), "character").when(name.rlike(r"[ .]$"), "ending")
        .when(upper.rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), "reserved").when(F.length(F.encode(name, "UTF-8")) > 255, "long")
    )


def units_to_mm(value: Column, unit: Column, dpi: Column) -> Column:
    """A length in millimetres; null for an unknown unit or resolution."""
    return F.when(unit == "mm", value).when(unit == "cm", value * 10).when(unit == "in", value * 25.4).when((unit == "px") & (dpi > 0), value * 25.4 / dpi)


def is_stale(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a with stale: whether b lacks them or differs in any column, nulls being equal."""
    other = b.select(key, F.struct(*columns).alias("__was"))
    return a.join(other, key, "left").withColumn("stale", F.col("__was").isNull() | ~F.struct(*columns).eqNullSafe(F.col("__was"))).drop("__was")


def colour_mode(gray: Column, midtone: Column, dark: Column, light: Column, coverage: Column, largest: Column, tiles: Column) -> Column:
    """Verdict on a page from the evidence of its tones."""
    prior = (midtone < 0.45) & (((dark > 0.10) & (light > 0.30)) | (light > 0.70))
    wide = (midtone >= 0.10) | (coverage >= 0.70) | (largest >= 0.70) | (tiles >= 45)
    local = (tiles >= 2) & ((dark >= 0.08) | (tiles >= 3)) & (coverage >= 0.06)
    return F.when(~gray, "color").when(~prior, "gray").when(wide, "gray").when(local, "mixed").otherwise("bw")
