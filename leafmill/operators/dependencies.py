"""Whether what a step has stored still fits its page: predicates over settings as columns.

All are expressions, so a whole project's staleness is one projection over the join of
stored and present settings.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Layout types, in the order of the buttons; the first three are what a page can turn out to be.
LAYOUTS = ("single_uncut", "page_plus_offcut", "two_pages", "auto")
#: Polygons closer than this, point by point, are the same.
FUZZ = 1e-3


def same_outline(a: Column, b: Column, fuzz: float = FUZZ) -> Column:
    """Whether two polygons, arrays of (x, y), have the same edges, wherever they begin and whichever way they run.

    Polygons of fewer than two points are all the same, and unlike all others. Edges are
    compared in their order, so each of one matches one of the other within the tolerance.
    """

    def edges(poly: Column) -> Column:
        # A closed polygon repeats its first point.
        ring = F.when(F.element_at(poly, 1) == F.element_at(poly, -1), F.slice(poly, 1, F.size(poly) - 1)).otherwise(poly)
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.sort_array(F.zip_with(ring, following, lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))))

    def near(e: Column, f: Column) -> Column:
        apart = [F.abs(e[w][c] - f[w][c]) <= fuzz for w in ("p", "q") for c in ("x", "y")]
        return apart[0] & apart[1] & apart[2] & apart[3]

    def alike(both: Column) -> Column:
        return F.when(F.size(both["a"]) != F.size(both["b"]), False).otherwise(F.forall(F.zip_with(both["a"], both["b"], near), lambda x: x))

    # The edges stand in an array of one, so that they are made once.
    made = F.transform(F.array(F.struct(edges(a).alias("a"), edges(b).alias("b"))), alike)
    return F.when((F.size(a) < 2) | (F.size(b) < 2), (F.size(a) < 2) & (F.size(b) < 2)).otherwise(made[0])


def rounded_outline(poly: Column) -> Column:
    """Corners to the nearest thousandth."""
    return F.transform(poly, lambda p: F.struct(F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y")))


def split_compatible(same_size: Column, same_rotation: Column, same_trim: Column, now: Column, then: Column, line_mode: Column) -> Column:
    """Whether a stored split of layout type `then` serves a page that is now to be of type `now`; same_trim is null where a trim isn't known."""
    fits = same_size & same_rotation & F.coalesce(same_trim, F.lit(True))
    return fits & ((now == then) | (now == "single_uncut") | ((now == "two_pages") & (line_mode == "manual")))


def layout_conflict(wanted: Column, found: Column) -> Column:
    """Whether a layout type goes against the stored page layout (null: none, no conflict)."""
    expected = F.when(found == "single_cut", "page_plus_offcut").otherwise(found)
    return F.coalesce((wanted != "auto") & (wanted != expected), F.lit(False))


def needs_remeasure(same: Column, rotation_mode: Column, oblique_mode: Column) -> Column:
    """Whether an angle must be measured again: something changed, and one of the two angles is automatic."""
    return ~same & ((rotation_mode == "auto") | (oblique_mode == "auto"))


def boxes_to_update(same: Column, content: tuple[Column, Column], page: tuple[Column, Column], corners: tuple[Column, Column], options: tuple[Column, Column]) -> tuple[Column, Column]:
    """(content box, page box): which must be found again; each pair is the mode or setting now and then, options null where unknown."""
    other = lambda p: (p[0] != "manual") & (p[0] != p[1])
    tuned = F.coalesce((content[0] == "auto") & (options[0] != options[1]), F.lit(False))
    found = (page[0] == "auto") & (corners[0] != corners[1])
    return ~same | other(content) | tuned, ~same | other(page) | found


#: Characters no file name may have.
FORBIDDEN = '\\/:*?"<>|'


def bad_name(name: Column) -> Column:
    """Why a file name can't be used: empty, control, character, end; null where it can."""
    return (
        F.when(name == "", "empty").when(name.rlike(r"\p{Cc}"), "control").when(F.translate(name, FORBIDDEN, "") != name, "character")
        .when(name.rlike(r"[. ]$"), "end")
    )


def bad_path(path: Column) -> Column:
    """The reason of the path's last part that can't be used, from its end; "." and "" parts are no names, ".." takes one away."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.expr("cast(array() as array<string>)")
    clean = F.aggregate(parts, empty, lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(a))
    reasons = F.filter(F.transform(clean, bad_name), lambda r: r.isNotNull())
    return F.when(path == "", "empty").when(F.size(reasons) > 0, F.get(reasons, F.size(reasons) - 1))
