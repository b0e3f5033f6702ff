"""Places of regular expression matches as columns, without any Python on the executors.

A match is marked by a noncharacter on either side, the text is split there, and running
sums of lengths give the places. Places count code points; the end is exclusive. Running
values are made block by block, as appending one by one to a long array copies it each
time; what is used again is bound to a lambda's variable, so it is computed once. A text of
many matches thus costs about its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MARK, STAND_IN = "￿", "￾"
SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
BLOCK = 64


def readable(text: Column) -> Column:
    """The text with nulls as empty and the mark, should it occur, as its neighbour: no place moves."""
    return F.translate(F.coalesce(text, F.lit("")), MARK, STAND_IN)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """The running values step(value, item), from zero, before each item, as an array; items is a column or a lambda's variable, out the values' type."""
    empty, none = F.expr(f"cast(array() as array<{out}>)"), F.expr(f"cast(array() as array<array<{out}>>)")

    def one(acc: Column, item: Column) -> Column:
        return F.struct(step(acc["now"], item).alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen"))

    def block(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(items, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["now"].alias("now"), empty.alias("seen")), one)
        return bound(inner, lambda b: F.struct(b["now"].alias("now"), F.concat(acc["seen"], F.array(b["seen"])).alias("seen")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    made = F.aggregate(blocks, F.struct(zero.cast(out).alias("now"), none.alias("seen")), block, lambda a: F.flatten(a["seen"]))
    return F.when(F.size(items) > 0, made).otherwise(empty)


def matches(text: Column, pattern: str, needs: Column | None = None, reach: int = 0) -> Column:
    """Leftmost non-overlapping matches, in order, as array<struct<start, end, value, before, after>>.

    before and after are up to `reach` characters around the match, up to the next match.
    text has been through readable(); pattern matches no empty string and, since loops
    over groups would recurse in the regex engine, loops over groups only possessively.
    needs is a cheap condition that every text with a match meets.
    """
    parts = F.split(F.regexp_replace(text, f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK, -1)
    near = (lambda p: F.substring(p, -reach, reach), lambda p: F.substring(p, 1, reach)) if reach else (lambda p: F.lit(""),) * 2

    def spans(p: Column, at: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)),
            lambda i: F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.get(p, i).alias("value"), near[0](F.get(p, i - 1)).alias("before"), near[1](F.get(p, i + 1)).alias("after")),
        )

    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    starts = lambda p: scanned(p, F.lit(0), lambda at, x: at + F.length(x), "int")
    found = bound(parts, lambda p: F.when(F.size(p) > 2, bound(starts(p), lambda at: spans(p, at))).otherwise(empty))
    return found if needs is None else F.when(needs, found).otherwise(empty)


def kept(found: Column, keep: Callable[[Column], Column], kind: str, rank: int, score: Callable[[Column], Column] | None = None) -> Column:
    """Spans whose value passes, as array<struct<start, rank, end, kind, value, score>>."""
    passed = F.filter(found, lambda s: keep(s["value"]))
    worth = score or (lambda s: F.lit(1.0))
    return F.transform(passed, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), worth(s).cast("double").alias("score")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(spans: Column, others: Column) -> Column:
    """Those of the spans that overlap none of the others, in order of their starts: one sort, and a pass each way."""

    def merged(s: Column, o: Column) -> Column:
        item = lambda x, own, n: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), n.alias("n"))
        return F.array_sort(F.concat(F.transform(o, lambda x: item(x, 0, F.lit(0))), F.transform(s, lambda x, i: item(x, 1, i))))

    far = 2**31 - 1
    ended = lambda m: scanned(m, F.lit(-1), lambda now, x: F.when(x["own"] == 0, F.greatest(now, x["end"])).otherwise(now), "int")
    begun = lambda m: scanned(m, F.lit(far), lambda now, x: F.when(x["own"] == 0, x["start"]).otherwise(now), "int")

    def free(s: Column, m: Column) -> Column:
        both = F.arrays_zip(m.alias("m"), ended(m).alias("ended"), F.reverse(bound(F.reverse(m), begun)).alias("begun"))
        clear = F.filter(both, lambda b: (b["m"]["own"] == 1) & (b["ended"] <= b["m"]["start"]) & (b["begun"] >= b["m"]["end"]))
        return F.transform(clear, lambda b: F.get(s, b["m"]["n"]))

    return bound(spans, lambda s: F.when((F.size(s) > 0) & (F.size(others) > 0), bound(merged(s, others), lambda m: free(s, m))).otherwise(s))
