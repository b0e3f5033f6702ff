"""Quality rules with cross-document line frequency.

Each document gets counts of words, symbols, repeated lines and repeated word windows,
and a base rule over them. Beyond that, normalised lines are hashed and, for each host,
the distinct documents that hold a line are counted; lines found in more documents than
the host's limit are taken out, and a document that loses too many of its words with
them is rejected.

One scan turns documents into a table of counts and line hashes, a small part of the
input's size; all later steps read that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from leafmill.llm.shared import drop_since, mark, materialize
from leafmill.llm.words import mix, ngram_hashes, running, text_chunks, thrifty, word_hashes

#: (host, line) rows, or verdicts and the numbers of their lines, that may be broadcast: a verdict takes about 200 bytes there.
BROADCAST_LINES = 200_000
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def line_words(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Lines of all texts: (text's index, line's number, raw hash, hash of its lower-cased words, words), for lines with a word."""
    text_of, number, raw, norm, count = [], [], [], [], []
    flat, owner = [], []
    for i, t in enumerate(texts):
        lines = t.split("\n") if t else []
        flat += lines
        owner += [i] * len(lines)
    if not flat:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
    words, at = word_hashes(flat)
    owner = np.array(owner)
    n = np.diff(at)
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    number = np.arange(len(flat)) - np.maximum.accumulate(np.where(first, np.arange(len(flat)), 0))
    local = np.arange(len(words)) - np.repeat(at[:-1], n)
    sums = running(mix(words + mix(local.astype(np.uint64) + _U(7))))
    norm = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
    has = n > 0
    raw = np.array([hash(x) for x in flat], np.int64).view(np.uint64)
    return owner[has], number[has], raw[has], norm[has], n[has]


def repeated_window_words(words: np.ndarray, at: np.ndarray, n: int = 3) -> np.ndarray:
    """Per text, the words inside some n-word window that the text holds twice or more."""
    sizes = np.diff(at)
    windows = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    if not len(owner):
        return np.zeros(len(sizes), np.int64)
    place = at[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    key = ngram_hashes(words, n)[place] ^ mix(owner.astype(np.uint64))
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = place[counts[back] > 1]
    covered = np.zeros(len(words) + n, bool)
    for i in range(n):
        covered[hit + i] = True
    sums = np.concatenate(([0], np.cumsum(covered[: len(words)])))
    return sums[at[1:]] - sums[at[:-1]]


def base_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, and its lines."""
    words, at = word_hashes(texts, None)
    chars, symbols = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            chars[i] = len(t) - np.count_nonzero(_SPACE[raw])
            symbols[i] = np.count_nonzero(_SYMBOL[raw])
    owner, number, raw, norm, count = line_words(texts)
    dup = np.zeros(len(texts), np.int64)
    if len(owner):
        order = np.lexsort((raw, owner))
        same = (owner[order][1:] == owner[order][:-1]) & (raw[order][1:] == raw[order][:-1])
        dup = np.bincount(owner[order][1:][same], minlength=len(texts))
    return {"n_words": np.diff(at), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated_window_words(words, at), "lines": (owner, number, norm, count)}


@thrifty
def _measured(batches):
    task = TaskContext.get()
    rid = (task.partitionId() if task else 0) << 40
    for batch in batches:
        ids, hosts = batch.column(0), batch.column(1)
        for lo, hi, part in text_chunks(batch.column(2)):
            c = base_counts(part)
            owner, number, norm, count = c.pop("lines")
            at = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32())
            sums = running(mix(norm + mix(number.astype(np.uint64))))
            bound = np.searchsorted(owner, np.arange(len(part) + 1))
            text_hash = mix(sums[bound[1:]] - sums[bound[:-1]]).view(np.int64)
            lines = pa.ListArray.from_arrays(at, pa.array(norm.view(np.int64)))
            numbers = pa.ListArray.from_arrays(at, pa.array(number.astype(np.int32)))
            counts = pa.ListArray.from_arrays(at, pa.array(count.astype(np.int32)))
            own = pa.array(np.arange(rid, rid + len(part)))
            rid += len(part)
            yield pa.RecordBatch.from_arrays([own, ids.slice(lo, hi - lo), hosts.slice(lo, hi - lo), pa.array(text_hash), *(pa.array(v.astype(np.int64)) for v in c.values()), lines, numbers, counts], [*_COLUMNS])


_COLUMNS = {"rid": "long", "doc": "long", "host": "string", "text_hash": "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "line": "array<long>", "no": "array<int>", "words": "array<int>"}


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_docs: int = 5, host_share: float = 0.002, max_docs: int | None = 1000, max_lost: float = 0.5, copies_once: bool = True) -> DataFrame:
    """One row per document: its counts, base_failed, kept, n_lost_words and removed_lines.

    A line is its words, A-Z lower-cased; it is over the limit in a host when more than
    greatest(min_docs, host_share * documents of the host), but max_docs at most, distinct
    documents of that host hold it. The floor lets the limit act on small hosts, max_docs
    (None: no such bound) keeps it from growing with a large host. With copies_once, documents
    with the same lines are one document in that count, so that a group of whole copies doesn't
    reject itself to the last copy; without, every row counts. removed_lines are the numbers, from 0, of a
    document's lines over the limit; n_lost_words counts their words. kept is false for
    base_failed documents and for those that lose more than max_lost of their words.

    Null and empty texts have no words and fail the base rule. Null hosts are one host.
    Every input row gives a row, repeated and null ids included; other columns are not
    read. An empty table gives an empty result.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return _judged(read, min_docs, host_share, max_docs, max_lost, copies_once).withColumnRenamed("doc", id_col)


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs that judge keeps, with their removed_lines cut out of the text; limits are judge's.

    A verdict depends on a row's host and text alone, so rows meet theirs by a hash of
    both: each row by itself, whatever its id. All other columns are passed on, whatever their names.
    Verdicts are broadcast where they and the numbers of their lines are counted few, so that no text is sent about.
    """
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`")
    # A host's length goes before it, so that no other host and text make the same bytes.
    key = F.md5(F.concat(F.coalesce(F.concat(F.length(host), F.lit(":"), host), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    before = mark()
    judged = _judged(docs.select(key.alias("doc"), host.alias("host"), text.alias("text")), **limits)
    acted = judged.where(~F.col("kept") | (F.size("removed_lines") > 0)).groupBy(F.col("doc").alias("key")).agg(F.first("kept").alias("kept"), F.first("removed_lines").alias("gone"))
    acted = materialize(acted, "acted")
    drop_since(before, acted, docs)
    size = acted.agg(F.coalesce(F.sum(1 + F.size("gone")), F.lit(0))).first()[0]
    acted = F.broadcast(acted) if size <= BROADCAST_LINES else acted
    rows = docs.select(key.alias("own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = rows.join(acted, F.col("own") == F.col("key"), "left").where(F.coalesce("kept", F.lit(True)))
    whole = F.col("row")[text_col]
    cut = F.when(F.size("gone") > 0, F.array_join(F.filter(F.split(whole, "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")).otherwise(whole)
    return left.select(*((cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


def _judged(read: DataFrame, min_docs: int = 5, host_share: float = 0.002, max_docs: int | None = 1000, max_lost: float = 0.5, copies_once: bool = True) -> DataFrame:
    """What judge returns, of rows (doc, host, text)."""
    columns = _COLUMNS | {"doc": read.schema["doc"].dataType.simpleString()}
    docs_m = materialize(read.mapInArrow(_measured, ", ".join(f"{k} {v}" for k, v in columns.items())), "measured")
    lines = docs_m.select("rid", "text_hash", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.explode(F.arrays_zip("line", "no", "words")).alias("x")).select("rid", "text_hash", "host", "no_host", "x.*")
    most = float("inf") if max_docs is None else max_docs
    floor = min(min_docs, most)
    distinct = lines.select("host", "no_host", "line", "text_hash" if copies_once else "rid").distinct()
    seen = distinct.groupBy("host", "no_host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > floor)
    hosts = docs_m.groupBy(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host")).agg(F.least(F.count("*") * F.lit(host_share), F.lit(float(most))).alias("limit"))
    heavy = materialize(seen.join(hosts, ["host", "no_host"]).where("docs > limit").select("host", "no_host", "line"), "heavy")
    small = F.broadcast(heavy) if heavy.count() <= BROADCAST_LINES else heavy
    lost = lines.join(small, ["host", "no_host", "line"], "left_semi").groupBy("rid").agg(F.sum("words").alias("lost"), F.sort_array(F.collect_list("no")).alias("gone"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n_lost = F.coalesce("lost", F.lit(0)).cast("long")
    return docs_m.join(lost, "rid", "left").select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & (n_lost <= max_lost * F.col("n_words"))).alias("kept"),
        n_lost.alias("n_lost_words"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"),
    )
