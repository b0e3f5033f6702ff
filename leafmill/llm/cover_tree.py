"""Near-duplicate vectors by a cover tree: all pairs whose cosine reaches a threshold, found by dual traversal.

On unit vectors a cosine is a chord, and chords obey the triangle inequality. The tree's levels
cover their vectors by balls whose radii halve from level to level; a node's head stays a
head below it, and every node knows its covering radius, the largest chord from its head to
a vector under it, as measured. Two nodes whose heads are further apart than the chord of the threshold and
both covering radii hold no link and are pruned; two that are so near that even their furthest
vectors are within it are linked whole, by their sizes, without a look at their pairs; all
others open into their children, down to single vectors, whose cosine is computed in double precision.

The tree is spread like this. Equal vectors are one, with a number. The upper levels are fitted on
a bounded sample (CELLS nodes at most) and only route: each vector goes to the nearest of their
lowest nodes, the cells, whose covering radii are then measured on all vectors. Cells are dealt
into shards of about SHARD vectors, large ones over several shards by a hash. In each
shard the lower levels are built once. Two shards meet in one task, to which
go only those cells that have a cell of the other shard within reach. In a collection that
fills all directions evenly nothing can be pruned: there each shard meets each, as large
blocks, and the vectors sent are as many as the shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm.components import components
from leafmill.llm.shared import drop, hash_sample, materialize
from leafmill.llm.words import thrifty

#: Levels that are built in a shard, their radii halving from one that is no smaller than the threshold's chord: wider balls would be within reach of nearly all others.
LEVELS = 5
#: The sample that routing is fitted on, and the cells it makes, at most. They move work about and touch no result.
SAMPLE, CELLS = 4096, 256
#: Vectors of a shard, about.
SHARD = 65_536
#: Sides of a block of heads that are compared at once, and pairs that are held at once.
TILE, PAIRS = 2048, 1 << 16
#: Results of linked vectors are broadcast up to this many rows, counted first.
BROADCAST_ROWS = 100_000
_SLACK = 1e-9


def _packed(batches):
    """Ids with their vectors as bytes; null for those that link with nothing."""
    for batch in batches:
        lists, ids = batch.column(1), batch.column(0)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        flat = lists.flatten()
        values = flat.to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        fine = running(np.isfinite(values) & ~flat.is_null().to_numpy(zero_copy_only=False))
        full = running(values != 0)
        begin = end - size
        ok = (size > 0) & (fine[end] - fine[begin] == size) & (full[end] > full[begin]) & ids.is_valid().to_numpy(zero_copy_only=False)
        raw, wide = np.ascontiguousarray(values).view(np.uint8).data, values.itemsize
        yield pa.RecordBatch.from_arrays([ids, pa.array([bytes(raw[a * wide : b * wide]) if o else None for a, b, o in zip(begin.tolist(), end.tolist(), ok.tolist(), strict=True)], pa.binary())], ["id", "v"])


def radii(threshold: float) -> tuple[float, ...]:
    """Radii of a shard's levels: halves of 2, the ball that holds all."""
    far = math.sqrt(2 - 2 * threshold)
    first = max(2.0 ** math.ceil(math.log2(far)), 2.0**-12) if far else 2.0**-12
    return tuple(min(first, 1.0) / 2**i for i in range(LEVELS))


def running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def unit(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length, from their bytes, as rows of length 1 in double precision."""
    joined = b"".join(column.to_pylist())
    x = np.frombuffer(joined, kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cover(x: np.ndarray, radius: float, start: int = 0) -> np.ndarray:
    """For each row of x a head within the radius; heads are more than the radius apart, and start is one of them."""
    least = 1 - radius * radius / 2
    head = np.full(len(x), -1, np.int64)
    left = np.concatenate(([start], np.delete(np.arange(len(x)), start)))
    while len(left):
        batch = left[:256]
        near = x[batch] @ x[batch].T >= least
        covered, chosen = np.zeros(len(batch), bool), []
        for i in range(len(batch)):
            if not covered[i]:
                chosen.append(i)
                covered |= near[i]
        heads, rest = batch[chosen], []
        for at in range(0, len(left), 8192):
            part = left[at : at + 8192]
            dots = x[part] @ x[heads].T
            best = dots.argmax(1)
            within = dots[np.arange(len(part)), best] >= least
            head[part[within]] = heads[best[within]]
            rest.append(part[~within])
        head[heads] = heads
        left = np.concatenate(rest)
        left = left[head[left] < 0]
    return head


def chord(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, y), 0))


def cells(x: np.ndarray, most: int, least: float = 0.0625) -> np.ndarray:
    """Heads of the upper tree's lowest nodes: the fullest node is opened into balls of half its radius, as long as there are `most` nodes at most."""
    nodes, done = [(np.arange(len(x)), 2.0)], []
    small = x.astype(np.float32)
    while nodes:
        nodes.sort(key=lambda n: len(n[0]))
        rows, radius = nodes.pop()
        if len(rows) <= max(1, len(x) // 64) or radius <= least:
            done.append((rows, radius))
            continue
        head = cover(small[rows], radius / 2)
        parts = [rows[np.concatenate(([h], np.flatnonzero((head == h) & (np.arange(len(rows)) != h))))] for h in np.unique(head)] if len(np.unique(head)) <= most else []
        if not parts or len(parts) + len(nodes) + len(done) > most:
            done.append((rows, radius))  # too many balls: what is in it is told apart in the shards
        else:
            nodes += [(p, radius / 2) for p in parts]
    return x[sorted(int(rows[0]) for rows, _ in done)] if len(x) else x


def _levels(x: np.ndarray, cell: np.ndarray, radii: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Head and covering radius of each row's node on each level."""
    small = x.astype(np.float32)
    heads, reach = np.empty((len(radii), len(x)), np.int64), np.empty((len(radii), len(x)))
    for level, radius in enumerate(radii):
        if level:
            head, open_ = heads[level - 1].copy(), np.flatnonzero(reach[level - 1] > radius)
            key = head[open_]
        else:
            head, open_, key = np.empty(len(x), np.int64), np.arange(len(x)), cell
        order = open_[np.argsort(key, kind="stable")]
        bounds = np.flatnonzero(np.diff(np.sort(key))) + 1
        for rows in np.split(order, bounds) if len(order) else []:
            start = int(np.flatnonzero(rows == head[rows[0]])[0]) if level else 0
            head[rows] = rows[cover(small[rows], radius, start)]
        far = np.zeros(len(x))
        np.maximum.at(far, head, chord(x, x[head]))
        heads[level], reach[level] = head, far[head] + _SLACK
    return heads, reach


def _built(kind: str, radii: tuple[float, ...]):
    def run(key, table):
        table = table.combine_chunks()
        ids = table["gid"].to_numpy()
        heads, reach = _levels(unit(table["v"].combine_chunks(), kind), table["cell"].to_numpy(), radii)
        at = pa.array(np.arange(0, len(radii) * (len(ids) + 1), len(radii)), pa.int32())
        more = [pa.ListArray.from_arrays(at, pa.array(ids[heads.T.ravel()])), pa.ListArray.from_arrays(at, pa.array(reach.T.ravel()))]
        return pa.table([table[c] for c in ("gid", "dim", "cell", "shard", "copies", "v")] + more, names=["gid", "dim", "cell", "shard", "copies", "v", "heads", "reach"])

    return run


class _Side:
    """The trees of one shard, level by level; below the last level are the vectors themselves."""

    def __init__(self, table: pa.Table, kind: str):
        order = np.argsort(table["gid"].to_numpy())
        table = table.take(pa.array(order)).combine_chunks()
        self.gid, self.copies = table["gid"].to_numpy(), table["copies"].to_numpy()
        self.x = unit(table["v"].combine_chunks(), kind)
        self.small = self.x.astype(np.float32)
        n, depth = len(self.gid), LEVELS
        heads = np.searchsorted(self.gid, table["heads"].combine_chunks().flatten().to_numpy().reshape(n, depth)).T
        reach = table["reach"].combine_chunks().flatten().to_numpy().reshape(n, depth).T
        self.row, self.node, self.reach, self.weight, self.many, self.kids, self.at = [], [], [], [], [], [], []
        for level in range(depth + 1):
            row, node = (np.unique(heads[level], return_inverse=True)) if level < depth else (np.arange(n), np.arange(n))
            self.row.append(row)
            self.node.append(node)
            self.reach.append(reach[level][row] if level < depth else np.zeros(n))
            self.weight.append(np.bincount(node, self.copies, len(row)).astype(np.int64))
            self.many.append(np.bincount(node, minlength=len(row)) > 1)
        for level in range(depth + 1):  # children on this level of the nodes one level up
            parent = self.node[level - 1][self.row[level]] if level else np.zeros(len(self.row[0]), np.int64)
            self.kids.append(np.lexsort((self.reach[level], parent)))  # by their radii: a block of heads has nodes of one size
            self.at.append(np.concatenate(([0], np.cumsum(np.bincount(parent, minlength=len(self.row[level - 1]) if level else 1)))))
        self.add = [np.zeros(len(r), np.int64) for r in self.row]
        self.own = [np.zeros(len(r), np.int64) for r in self.row]
        self.whole = [np.zeros(len(r), bool) for r in self.row]


class Dual:
    """Dual traversal of the trees of two shards, or of one with itself.

    Gives, after run(), the links of each row (counts) and a forest of its components (root), or with
    `every` all links one by one.
    """

    def __init__(self, a: _Side, b: _Side, threshold: float, every: bool = False):
        self.a, self.b, self.same, self.threshold, self.every = a, b, a is b, threshold, every
        self.far = math.sqrt(2 - 2 * threshold)
        self.parent = np.arange(len(a.gid) + (0 if self.same else len(b.gid)))
        self.shift = 0 if self.same else len(a.gid)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges.append((x, y))
        self.waiting += len(x)
        if self.waiting > 1 << 20:
            self.flush()

    def flush(self) -> None:
        """Join the components of the edges seen so far: roots hook on the smaller one, paths shrink to their ends."""
        if not self.edges:
            return
        x, y = (np.concatenate(s) for s in zip(*self.edges, strict=True))
        self.edges, self.waiting = [], 0
        while True:
            x, y = self.parent[x], self.parent[y]
            differ = x != y
            if not differ.any():
                return
            x, y = x[differ], y[differ]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up

    def _children(self, level: int, pa_: np.ndarray, pb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes of a level below the given pairs, but those that a block of heads already shows to be too far."""
        a, b = self.a, self.b
        na, nb = a.at[level][pa_ + 1] - a.at[level][pa_], b.at[level][pb + 1] - b.at[level][pb]
        product = na * nb
        for i in np.flatnonzero(product > PAIRS // 4):
            rows, cols = a.kids[level][a.at[level][pa_[i]] : a.at[level][pa_[i] + 1]], b.kids[level][b.at[level][pb[i]] : b.at[level][pb[i] + 1]]
            twin = self.same and pa_[i] == pb[i]
            for r in range(0, len(rows), TILE):
                for c in range(r if twin else 0, len(cols), TILE):
                    mine, yours = rows[r : r + TILE], cols[c : c + TILE]
                    ra, rb = a.reach[level][mine], b.reach[level][yours].max()
                    least = 1 - np.minimum(self.far + ra + rb, 2) ** 2 / 2 - 1e-5
                    near = a.small[a.row[level][mine]] @ b.small[b.row[level][yours]].T >= least.astype(np.float32)[:, None]
                    ia, ib = np.nonzero(near)
                    ia, ib = mine[ia], yours[ib]
                    keep = ia <= ib if twin else slice(None)
                    yield ia[keep], ib[keep]
        few = np.flatnonzero((product > 0) & (product <= PAIRS // 4))
        ends = np.cumsum(product[few])
        for at in range(0, int(ends[-1]) if len(few) else 0, PAIRS):
            part = few[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + PAIRS, "right")]
            if not len(part):
                continue
            size = product[part]
            pair = np.repeat(np.arange(len(part)), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            width = nb[part][pair]
            ia = a.kids[level][a.at[level][pa_[part]][pair] + k // width]
            ib = b.kids[level][b.at[level][pb[part]][pair] + k % width]
            if self.same:
                keep = (ia <= ib) | (pa_[part] != pb[part])[pair]
                ia, ib = ia[keep], ib[keep]
            yield ia, ib

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b, last = self.a, self.b, LEVELS
        root = np.zeros(1, np.int64)
        stack = [(0, self._children(0, root, root))]
        while stack:
            level, pairs = stack[-1]
            step = next(pairs, None)
            if step is None:
                stack.pop()
                continue
            for at in range(0, len(step[0]), PAIRS):
                ia, ib = step[0][at : at + PAIRS], step[1][at : at + PAIRS]
                if self.same:
                    keep = (ia != ib) | a.many[level][ia]
                    ia, ib = ia[keep], ib[keep]
                x, y = a.row[level][ia], b.row[level][ib]
                dots = np.einsum("ij,ij->i", a.x[x], b.x[y])
                if level == last:
                    link = dots >= self.threshold
                    for i in np.flatnonzero(np.abs(dots - self.threshold) < 1e-12):
                        link[i] = cosine(a.x[x[i]], b.x[y[i]]) >= self.threshold
                    x, y = x[link], y[link]
                    if self.every:
                        yield a.gid[x], b.gid[y], dots[link]
                        continue
                    np.add.at(a.add[last], x, b.copies[y])
                    np.add.at(b.add[last], y, a.copies[x])
                    self._join(x, y + self.shift)
                    continue
                d, reach = np.sqrt(np.maximum(2 - 2 * dots, 0)), a.reach[level][ia] + b.reach[level][ib] + _SLACK
                d[(ia == ib) & self.same] = 0
                whole = (d + reach <= self.far) & (not self.every)
                self._linked(level, ia[whole], ib[whole])
                further = ~whole & (d - reach <= self.far)
                if further.any():
                    stack.append((level + 1, self._children(level + 1, ia[further], ib[further])))
        self.flush()

    def _linked(self, level: int, ia: np.ndarray, ib: np.ndarray) -> None:
        """All vectors of one node of each pair link with all of the other."""
        a, b = self.a, self.b
        twin = (ia == ib) & self.same
        np.add.at(a.add[level], ia, b.weight[level][ib])
        np.add.at(b.add[level], ib[~twin], a.weight[level][ia[~twin]])
        np.add.at(a.own[level], ia[twin], 1)
        a.whole[level][ia] = True
        b.whole[level][ib] = True
        self._join(a.row[level][ia], b.row[level][ib] + self.shift)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """gid, links in these shards and root's gid of the rows that have links."""
        sides = [(self.a, 0)] if self.same else [(self.a, 0), (self.b, self.shift)]
        counts = []
        for side, shift in sides:
            n = np.zeros(len(side.gid), np.int64)
            for level, node in enumerate(side.node):
                n += side.add[level][node] - side.copies * side.own[level][node]
                rows = np.flatnonzero(side.whole[level][node])
                self._join(rows + shift, side.row[level][node[rows]] + shift)
            counts.append(n)
        self.flush()
        gid, n = np.concatenate([s.gid for s, _ in sides]), np.concatenate(counts)
        some = np.flatnonzero(n)
        return gid[some], n[some], gid[self.parent[some]]


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Rounded once at the end of each sum."""
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _traversed(kind: str, threshold: float, every: bool):
    def run(key, table):
        first, second = key[1].as_py(), key[2].as_py()
        shard = table["shard"].to_numpy()
        mine, yours = (table.filter(pa.array(shard == s)) for s in (first, second))
        found = []
        if mine.num_rows and yours.num_rows:
            a = _Side(mine, kind)
            dual = Dual(a, a if first == second else _Side(yours, kind), threshold, every)
            found = list(dual.run()) if every else [*dual.run(), dual.result()]
        types = [np.int64, np.int64, np.float64 if every else np.int64]
        columns = [np.concatenate([np.empty(0, t), *(f[i] for f in found)]).astype(t) for i, t in enumerate(types)]
        return pa.table([pa.array(c) for c in columns], names=["a", "b", "cosine"] if every else ["gid", "n", "root"])

    return run


def _placed(heads: dict[int, np.ndarray], kind: str):
    """Each vector with its nearest cell, and how far off the cell's head is."""

    def run(batches):
        for batch in batches:
            dim = batch.column(1).to_numpy()
            cell, off = np.zeros(len(dim), np.int32), np.full(len(dim), 2.0)
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                if d in heads:
                    x = unit(batch.column(3).take(pa.array(rows)), kind)
                    cell[rows] = (x @ heads[d].T).argmax(1)
                    off[rows] = chord(x, heads[d][cell[rows]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(off)], [*batch.schema.names, "cell", "off"])

    return run


def _routes(spark: SparkSession, counted: list, heads: dict[int, np.ndarray], far: float, cores: int) -> tuple[DataFrame, int]:
    """For each cell: its shards, as the first and their number, and ranges of the shards it must meet; and how many pairs of shards there are, at most."""
    rows, tasks = [], 0
    for dim in sorted({r.dim for r in counted}):
        own = sorted((r for r in counted if r.dim == dim), key=lambda r: r.cell)
        total = sum(r.rows for r in own)
        shards = max(-(-total // SHARD), min(math.ceil(math.sqrt(6 * cores)), -(-total // 1000)))
        size = -(-total // shards)
        ends = np.cumsum([r.rows for r in own])
        first = (ends - [r.rows for r in own]) // size
        number = (ends - 1) // size - first + 1
        reach = np.array([r.off for r in own]) + _SLACK
        x = heads[dim][[r.cell for r in own]] if dim in heads else np.zeros((len(own), 1))
        apart = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0)) if dim in heads else np.zeros((1, 1))
        meets = apart <= far + reach[:, None] + reach[None, :] + _SLACK
        np.fill_diagonal(meets, True)
        for i, r in enumerate(own):
            ranges = [(int(first[j]), int(number[j])) for j in np.flatnonzero(meets[i])]
            rows.append((dim, r.cell, int(first[i]), int(number[i]), ranges))
        tasks += shards * (shards + 1) // 2
    return spark.createDataFrame(rows, "dim int, cell int, first int, number int, meets array<struct<at:int,number:int>>"), tasks


def _found(vectors: DataFrame, id_col: str, vector_col: str, threshold: float, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packed rows, distinct vectors (gid, v, low, copies), and what the traversals found."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0, and 1 at most")
    spark = vectors.sparkSession
    single = "array<float>" in vectors.schema[vector_col].dataType.simpleString()
    kind, of = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    read = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(of).alias("v"))
    packed = read.mapInArrow(thrifty(_packed), f"id {read.schema['id'].dataType.simpleString()}, v binary")
    distinct = packed.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    groups = materialize(distinct.select(F.monotonically_increasing_id().alias("gid"), (F.length("v") / int(kind[2])).cast("int").alias("dim"), "copies", "v", "low"), "vectors")
    sample: dict[int, list[bytes]] = {}
    for r in hash_sample(groups, ["v"], SAMPLE).orderBy(F.xxhash64("v")).select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(bytes(r.v))
    heads = {d: cells(unit(pa.array(v, pa.binary()), kind), CELLS) for d, v in sample.items()}
    placed = materialize(groups.drop("low").mapInArrow(thrifty(_placed(heads, kind)), "gid long, dim int, copies long, v binary, cell int, off double"), "placed")
    counted = placed.groupBy("dim", "cell").agg(F.count("*").alias("rows"), F.max("off").alias("off")).collect()
    cores = spark.sparkContext.defaultParallelism
    # A cell's row is a few numbers and CELLS ranges at most, and there are CELLS cells: it is broadcast.
    routes, tasks = _routes(spark, counted, heads, math.sqrt(2 - 2 * threshold), cores)
    sent = placed.drop("off").join(F.broadcast(routes), ["dim", "cell"])
    shard = (F.col("first") + F.pmod(F.xxhash64("gid"), F.col("number"))).cast("int")
    dealt = sent.select("gid", "dim", "cell", shard.alias("shard"), "copies", "v")
    wide = max(1, min(tasks, 32 * cores))
    fields = "gid long, dim int, cell int, shard int, copies long, v binary, heads array<long>, reach array<double>"
    trees = materialize(dealt.repartition(wide, "dim", "shard").groupBy("dim", "shard").applyInArrow(_built(kind, radii(threshold)), fields), "trees")
    drop(placed)
    others = F.array_distinct(F.flatten(F.transform("meets", lambda m: F.sequence(m["at"], m["at"] + m["number"] - 1))))
    pairs = trees.join(F.broadcast(routes), ["dim", "cell"]).withColumn("other", F.explode(others))
    pairs = pairs.select(F.least("shard", "other").alias("one"), F.greatest("shard", "other").alias("two"), *trees.columns)
    made = "a long, b long, cosine double" if every else "gid long, n long, root long"
    return packed, groups, materialize(pairs.repartition(wide, "dim", "one", "two").groupBy("dim", "one", "two").applyInArrow(_traversed(kind, threshold, every), made), "found")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Per row: its id, n_links (other rows whose cosine with it reaches the threshold), component_id (the smallest id reachable by links) and kept (whether that is its own).

    Null and empty vectors, those of length zero or with null or non-finite components, and rows with a
    null id link with nothing; a null id is its own component. Vectors of different
    length don't link with each other. Equal vectors are compared once and counted as often as they
    occur. Rows that share an id are rows of their own. Other columns are not read. An
    empty table gives an empty result.
    """
    packed, groups, found = _found(vectors, id_col, vector_col, threshold, every=False)
    joined = components(found.where("gid <> root").select(F.col("gid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("gid").agg(F.sum("n").alias("n"))
    linked = groups.select("gid", "v", "low", "copies").join(links, "gid", "left").where("n > 0 or copies > 1").join(joined, F.col("gid") == F.col("node"), "left")
    linked = materialize(linked.select(F.md5("v").alias("key"), "low", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "gid").alias("component")), "linked")
    lowest = linked.groupBy("component").agg(F.min("low").alias("lowest"))
    told = linked.join(lowest, "component").select("key", "n", "lowest")
    told = F.broadcast(told) if linked.count() <= BROADCAST_ROWS else told
    rows = packed.withColumn("key", F.md5("v")).drop("v").join(told, "key", "left")
    component = F.coalesce("lowest", "id")
    return rows.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(a, b, cosine) of all links between distinct vectors, each once, by the smallest ids that have them; rows are as in near_duplicates."""
    _, groups, found = _found(vectors, id_col, vector_col, threshold, every=True)
    names = groups.select(F.col("gid"), "low")
    a, b = names.toDF("a", "low_a"), names.toDF("b", "low_b")
    return found.join(a, "a").join(b, "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"), "cosine")
