"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target share r = target / source size is wanted r times: all
its whole copies are taken, and the fraction is rounded. Two documents with fractions p
and q exchange mass, in words, until one fraction is 0 or 1: the pair's words are the
same before and after, and each fraction keeps its expectation. The one that is left
over goes on to the next document. A chunk of documents thus ends with one fraction at
most, and the chunks' leftovers are combined by a tree of the same steps. The one document that a
source has left over in the end goes to the nearer of its two numbers of copies, so the
source misses its target by half of that document at most; it alone departs from its
probability.

Chunks are cut by a hash of the documents within each source, so a source of any size is
spread over as many tasks as it needs, and draws are hashes of the rows: reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leafmill.llm.shared import materialize

#: Documents in a chunk, on average; leftovers that one step of the tree combines.
CHUNK, FAN_IN = 4_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: list[float], share: float, most: float) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources in code point order, null last, take the weights in turn and share
    share * (all sizes) by them. No source gives more than most times its size; what is
    over goes to the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = {s: float(n) for s, n in order}
    out: dict[str | None, float] = {}
    rest, free = share * sum(size.values()), [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = most * size[s]
        rest -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def settle(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions p of documents of those sizes, in order; the rounded ones, and the place of the one left over (-1: none).

    draw has a number from 0 to 1 for each document; the one of the later of a pair decides.
    """
    p = p.astype(float).copy()
    held = -1
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, size[held], size[j]
        # Mass in words that can move from j to i, and from i to j.
        up = min((1 - p[i]) * a, p[j] * b)
        down = min(p[i] * a, (1 - p[j]) * b)
        move = up if draw[j] * (up + down) < down else -down
        p[i] += move / a
        p[j] -= move / b
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p, held


_STATE = "source string, no_source boolean, bucket long, key long, size long, p double, draw double, open boolean"


def _combine(part: pd.DataFrame) -> pd.DataFrame:
    # Large documents first: what is left over in the end is small.
    part = part.sort_values(["size", "key", "rid"], ascending=[False, True, True], kind="stable")
    p, held = settle(part["size"].to_numpy(), part["p"].to_numpy(), part["draw"].to_numpy())
    return part.assign(p=p, open=np.arange(len(part)) == held)


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(id, size, source, source_size, target, taken, copies) of every row.

    size is the row's number of words (runs of characters but space and U+0009 to
    U+000D; 0 for a null text), source_size and target belong to its source, copies is how
    often the mix takes it and taken the words that makes. copies is the floor or the
    ceiling of target / source_size, so never above `most`, a whole number.

    Null sources are one source, null ids are ids like others. Equal rows are rounded one
    by one, in an order that makes no difference between them. Rows without words are
    taken as whole copies only (they can't add to any target). An empty table gives an
    empty result. Columns but the three named are not read.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    read = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"))
    read = read.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    read = materialize(read.withColumn("rid", F.monotonically_increasing_id()), "sizes")

    # One row a source; their number is what the weights are given for, not the input's size.
    per_source = read.groupBy("source", "no_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    known = per_source.collect()
    goal = targets([(None if r.no_source else r.source, r.source_size) for r in known], weights, share, most)
    rows = [(r.source, r.no_source, r.source_size, float(goal.get(None if r.no_source else r.source, 0.0)), max(1, -(-r.rows // chunk))) for r in known]
    schema = "source string, no_source boolean, source_size long, target double, chunks long"
    shares = F.broadcast(docs.sparkSession.createDataFrame(rows, schema))

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = read.join(shares, ["source", "no_source"]).withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + 1e-12))
    state = state.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0))).otherwise(F.lit(0.0)))
    unit = lambda *c: (F.xxhash64(*c).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52))
    state = state.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks"))).withColumn("draw", unit("key", F.lit(2)))
    cols = ["rid", "source", "no_source", "bucket", "key", "size", "p", "draw"]
    schema = "rid long, " + _STATE
    rounded = materialize(state.select(*cols).withColumn("open", F.lit(False)).groupBy("source", "no_source", "bucket").applyInPandas(_combine, schema), "rounded")

    settled = rounded.where("not open")
    left, level, most_chunks = rounded.where("open"), 0, max((r[-1] for r in rows), default=1)
    while most_chunks > 1:
        level, most_chunks = level + 1, -(-most_chunks // FAN_IN)
        step = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long")).withColumn("draw", unit("key", F.lit(2 + level)))
        step = materialize(step.groupBy("source", "no_source", "bucket").applyInPandas(_combine, schema), "leftovers")
        settled = settled.unionByName(step.where("not open"))
        left = step.where("open")
    # The last one of a source goes the nearer way, so the source misses by half a document at most.
    extra = settled.unionByName(left).select("rid", F.round("p").cast("long").alias("extra"))

    out = state.select("rid", "id", "source", "no_source", "size", "source_size", "target", "whole").join(extra, "rid")
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", F.when(~F.col("no_source"), F.col("source")).alias("source"), "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
