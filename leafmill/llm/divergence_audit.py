"""How far the sources of a language are apart in their words, by joint histograms of counts.

Every source's smoothed share of every kept term is an integer, and the divergence of two
sources is an integer function f of two shares, summed over all kept terms of the language. A
share depends on a term's count alone, so f is the same for all terms with the same two
counts: for each pair of sources the distinct combinations of counts are tallied, and f is worked out
once a combination and taken times its number. Only terms that both sources have
are tallied; combinations with a zero are implied by each source's own histogram of counts
less what the tally has of it, and that of two zeros by the number of kept terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.llm.shared import materialize
from leafmill.llm.words import text_chunks, thrifty

UNIT = 1_000_000_000
#: Terms that a task holds before it hands on what it has counted, characters that are cut into terms at once, and combinations that are held before they are tallied.
HELD, PIECE, COMBINATIONS = 300_000, 1 << 20, 1 << 22
#: Groups and languages are broadcast up to this number of rows, counted first.
BROADCAST_GROUPS = 100_000
# A byte of a term: a letter, folded to lower case, or part of a code point beyond ASCII. All others part terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """A text's terms, as UTF-8; a long text is cut into terms piece by piece."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches):
    """How often each term occurs in each source, and in how many documents; a term of no bytes stands for the source itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, _, texts in text_chunks(batch.column(2)):
            for i, text in enumerate(texts, lo):
                n, docs = held.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                size -= len(n)
                seen = set()
                for terms in terms_of(text):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n)
                if size >= HELD:
                    yield from _handed_on(held)
                    held, size = {}, 0
    yield from _handed_on(held)


def _handed_on(held):
    for (lang, source), (n, docs) in held.items():
        terms = [b"", *n]
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), pa.array(terms, pa.binary()).view(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
            ["lang", "source", "term", "n", "docs"],
        )


def _codes(column: pa.Array, known: dict[str, int]) -> np.ndarray:
    coded = column.dictionary_encode()
    return np.array([known.setdefault(v, len(known)) for v in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]


def _tallied(batches):
    """For terms with the counts of their sources: how many terms have which counts in which two sources, and in each one (b is a, nb 0)."""
    langs: dict[str, int] = {}
    sources: dict[str, int] = {}
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(1)
        number = pc.list_value_length(cells).to_numpy()
        term = np.repeat(np.arange(len(number)), number)
        flat = cells.flatten()
        source, n = _codes(flat.field("source"), sources), flat.field("n").to_numpy(zero_copy_only=False)
        order = np.lexsort((source, term))
        lang, source, n = _codes(batch.column(0), langs)[term], source[order], n[order]
        held.append(np.stack((lang, source, source, n, np.zeros_like(n))))
        for k in range(1, int(number.max())):
            both = np.flatnonzero(term[k:] == term[:-k])
            held.append(np.stack((lang[both], source[both], source[both + k], n[both], n[both + k])))
            size += len(both)
            if size >= COMBINATIONS:
                yield from _told(held, list(langs), list(sources))
                held, size = [], 0
        size += len(n)
    yield from _told(held, list(langs), list(sources))


def _told(held: list[np.ndarray], langs: list[str], sources: list[str]):
    if not any(h.size for h in held):
        return
    rows = np.concatenate(held, axis=1)
    tops = [int(r.max()) + 1 for r in rows]
    if math.prod(tops) < 1 << 62:  # one number tells a combination
        packed = np.zeros(rows.shape[1], np.int64)
        for r, top in zip(rows, tops, strict=True):
            packed = packed * top + r
        packed, k = np.unique(packed, return_counts=True)
        parts = []
        for top in reversed(tops):
            packed, r = np.divmod(packed, top)
            parts.append(r)
        lang, a, b, na, nb = reversed(parts)
    else:
        (lang, a, b, na, nb), k = np.unique(rows, axis=1, return_counts=True)
    names = [s.encode("utf-8", "surrogatepass") for s in sources]
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    turn = rank[a] > rank[b]
    a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
    of_lang, of_source = pa.array(langs, pa.string()), pa.array(sources, pa.string())
    for at in range(0, len(k), 1 << 16):
        cut = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([of_lang.take(pa.array(lang[cut])), of_source.take(pa.array(a[cut])), of_source.take(pa.array(b[cut])), *(pa.array(x[cut].astype(np.int64)) for x in (na, nb, k))], ["lang", "a", "b", "na", "nb", "k"])


def share(count: str, total: str, terms: str) -> Column:
    """A term's smoothed share of a group, in billionths, plus one. Where 64 bits don't hold the product, decimals do."""
    whole = f"cast(({total}) + ({terms}) as decimal(38, 0))"
    return F.expr(f"1 + case when {count} < 9000000000 then {UNIT} * ({count} + 1) div ({total} + {terms}) else (cast({UNIT} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div {whole} end")


def apart(p: str, q: str) -> Column:
    """f: the squared difference of two shares over the second, rounded down; both are at most a billion and one, so it fits 64 bits."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each source of each language.

    Terms are runs of letters A-Z, lower-cased, and code points beyond ASCII; a language keeps the V
    terms of at least min_docs of its documents. With N occurrences of kept terms in a
    group, a term's p is 1 + 1e9 * (count + 1) // (N + V), and f = (p - q)^2 // q. Part
    pair: item is each other source of the language, q its p, value the sum of f over all kept
    terms. Part term: item is each kept term that the source has with p over the
    language's q, value f, ranks to `top`. Ranks run from 1, values descending, then items by code point.

    Null texts, languages and sources are empty ones. A source without terms counts as one with
    zeros; a language without kept terms has pairs of value 0. Every row is a document, repeated ones
    too; texts of any length are read whole. Other columns are not read. An empty table gives an empty result.
    """
    none = F.lit("")
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), none).alias("lang"), F.coalesce(F.col(source_col).cast("string"), none).alias("source"), F.coalesce(F.col(text_col).cast("string"), none).alias("text"))
    parts = read.mapInArrow(thrifty(_counted), "lang string, source string, term string, n long, docs long")
    # One exchange: sums by source and then by term alone both follow from it. A term's row holds a number for each
    # source that has it; the result has a row for each two of them.
    counts = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    by_term = materialize(by_term.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"), "terms")
    kept, every = by_term.where("term <> ''"), by_term.where("term = ''").select("lang", F.explode("cells.source").alias("source"))
    tallies = kept.select("lang", "cells").mapInArrow(thrifty(_tallied), "lang string, a string, b string, na long, nb long, k long").groupBy("lang", "a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    tallies = materialize(tallies, "tallies")
    sums = tallies.where("a = b").groupBy("lang", F.col("a").alias("source")).agg(F.sum(F.col("na") * F.col("k")).alias("total"), F.sum("k").alias("own"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    groups = materialize(every.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "own", "terms", "lang_total"]), "groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    return _pairs(tallies, groups).unionByName(_terms(kept, groups, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    cells = kept.select("lang", "term", "all_n", F.explode("cells").alias("cell")).select("lang", "term", "all_n", "cell.*")
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms")).withColumn("q", share("all_n", "lang_total", "terms"))
    return _ranked(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value")), "term").where(F.col("rank") <= top)


def joint_counts(tallies: DataFrame, groups: DataFrame) -> DataFrame:
    """For each two sources a < b of a language, how many of its kept terms have which two counts: (lang, a, b, na, nb, terms_so), zeros included.

    tallies (lang, a, b, na, nb, k) have the terms of both sources, and where b is a, of the source itself.
    """
    both, own = tallies.where("a <> b"), tallies.where("a = b").select("lang", F.col("a").alias("source"), F.col("na").alias("n"), "k")
    pair = [groups.select("lang", F.col("source").alias(x), F.col("own").alias(f"own_{x}"), *(["terms"] if x == "a" else [])) for x in "ab"]
    pairs = pair[0].join(pair[1], "lang").where("a < b")
    zero, columns = F.lit(0).cast("long"), ["lang", "a", "b", "na", "nb", "k"]
    less = both.withColumn("k", -F.col("k"))
    implied = [
        own.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("na"), zero.alias("nb"), "k"),
        own.withColumnRenamed("source", "b").join(pairs, ["lang", "b"]).select("lang", "a", "b", zero.alias("na"), F.col("n").alias("nb"), "k"),
        less.withColumn("nb", zero), less.withColumn("na", zero), both.withColumn("na", zero).withColumn("nb", zero),
        pairs.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), (F.col("terms") - F.col("own_a") - F.col("own_b")).alias("k")),
    ]
    rows = both
    for more in implied:
        rows = rows.unionByName(more.select(columns))
    return rows.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("k").alias("terms_so")).where("terms_so > 0")


def _pairs(tallies: DataFrame, groups: DataFrame) -> DataFrame:
    totals = [groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), *(["terms"] if x == "a" else [])) for x in "ab"]
    shares = joint_counts(tallies, groups).join(totals[0], ["lang", "a"]).join(totals[1], ["lang", "b"])
    shares = shares.withColumn("pa", share("na", "total_a", "terms")).withColumn("pb", share("nb", "total_b", "terms"))
    wide = lambda f: F.sum(f.cast("decimal(20,0)") * F.col("terms_so").cast("decimal(18,0)"))
    found = shares.groupBy("lang", "a", "b").agg(wide(apart("pa", "pb")).alias("ab"), wide(apart("pb", "pa")).alias("ba"))
    # A language without kept terms has no combination: its pairs are worth 0.
    empty = groups.where("terms = 0")
    no_terms = empty.select("lang", "source").join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("decimal(38,0)"))
    ways = [found.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), F.col(x + y).alias("value")) for x, y in ("ab", "ba")]
    return _ranked(ways[0].unionByName(ways[1]).unionByName(no_terms.select("lang", "source", "item", "value")), "pair")
