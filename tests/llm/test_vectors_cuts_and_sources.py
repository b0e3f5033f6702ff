"""Cover-tree near duplicates, fill-in-the-middle cuts and the divergence audit, against brute force and on odd tables."""

import bisect
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import cover_tree, divergence_audit, fill_in_middle, registry

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vectors_of(seed, dim, scattered, bundles, size):
    rng = np.random.default_rng(seed)
    made = list(rng.normal(size=(scattered, dim)))
    for _ in range(bundles):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        made += [centre + s * rng.normal(size=dim) / dim**0.5 for s in (0.001, 0.1, 0.2, 0.3, 0.5) for _ in range(size)]
    made += [made[2]] * 30 + [made[3] * 4] * 2
    return [[float(x) for x in v] for v in made]


def by_hand(rows, threshold):
    """n_links, component_id and kept of each row, from all pairs."""
    fine = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = defaultdict(set)
    for size in {len(rows[i][1]) for i in fine}:
        own = [i for i in fine if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            linked[own[a]].add(own[b])
            linked[own[b]].add(own[a])
    seen, out = {}, []
    for i in range(len(rows)):
        if i in seen:
            continue
        reach, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - reach
            reach |= new
            todo += new
        low = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        seen |= dict.fromkeys(reach, low)
    for i, (k, _) in enumerate(rows):
        out.append((k, len(linked[i]), seen[i], k == seen[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "threshold"), [(65_536, 0.9), (90, 0.9), (90, 0.6)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, shard, threshold):
    monkeypatch.setattr(cover_tree, "SHARD", shard)
    rows = list(enumerate(vectors_of(4, 10, 250, 5, 12)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cover_tree.near_duplicates(frame, threshold=threshold).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, threshold)


def test_routing_prunes_far_cells_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "SHARD", 100)
    monkeypatch.setattr(cover_tree, "CELLS", 16)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] + 0.15 * rng.normal(size=8)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, cover_tree.near_duplicates(frame).collect()), key=str) == by_hand(rows, 0.9)
    x = np.array([v for _, v in rows])
    heads = cover_tree.cells(x / np.linalg.norm(x, axis=1)[:, None], 16)
    assert 8 <= len(heads) <= 16  # the eight bundles are told apart


def test_vectors_without_a_direction_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [1e-30, 0.0], [-0.0, 1.0], [0.0, 1.0]]
    rows = [*enumerate(odd), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("key", F.lit("x")).withColumn("v", F.lit(2))
    got = cover_tree.near_duplicates(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(k, n, c, k == c) for k, n, c, _ in by_hand(rows, 0.9)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert cover_tree.near_duplicates(frame.where("false")).count() == 0
    assert cover_tree.near_duplicates(frame.where("vec_id < 3")).count() == 3


def test_links_are_all_pairs_of_distinct_vectors(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "SHARD", 120)
    rows = list(enumerate(vectors_of(5, 8, 200, 3, 10)))
    got = {(r.a, r.b): r.cosine for r in cover_tree.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    first = {tuple(v): k for k, v in reversed(rows)}
    keys = sorted(first.values())
    x = np.array([rows[k][1] for k in keys])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(keys[a], keys[b]): (x @ x.T)[a, b] for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_bundle_of_many_is_linked_by_nodes_not_pairs():
    rng = np.random.default_rng(2)
    x = np.zeros(16)
    x[0] = 1
    rows = x + 0.01 * rng.normal(size=(20_000, 16))
    table = pa.table({"gid": np.arange(len(rows)), "dim": np.full(len(rows), 16, np.int32), "cell": np.zeros(len(rows), np.int32), "shard": np.zeros(len(rows), np.int32), "copies": np.ones(len(rows), np.int64), "v": pa.array([r.tobytes() for r in rows], pa.binary())})
    built = cover_tree._built("<f8", cover_tree.radii(0.9))(None, table)
    side = cover_tree._Side(built, "<f8")
    dual = cover_tree.Dual(side, side, 0.9)
    looked = []
    steps = dual._children
    dual._children = lambda *a: (looked.append(len(p[0])) or p for p in steps(*a))
    assert not list(dual.run())
    _, n, root = dual.result()
    assert (n == len(rows) - 1).all() and len(set(root)) == 1
    assert sum(looked) < len(rows)  # of two hundred million pairs


def test_heads_cover_and_keep_apart():
    x = np.random.default_rng(0).normal(size=(700, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    head = cover_tree.cover(x, 0.5, start=9)
    heads = np.unique(head)
    assert 9 in heads and (cover_tree.chord(x, x[head]) <= 0.5 + 1e-9).all()
    assert all(np.linalg.norm(x[a] - x[b]) > 0.5 for a, b in itertools.combinations(heads, 2))


# Fill in the middle


def cut_by_hand(doc_id, text, seed="1", rate=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(11)
    pieces = ["word", "Ünï", " ", "\n", "\r\n", "\x00", "数", "😀", "é", "<", "P>", "<S", ".", "aB", "￾", "1"]
    texts = [None, "", "a", "é", "<P>", "x<S>y", "<M", "<<S", "abc<", "a" * 9000, "é" * 9000, "😀a" * 3000]
    return texts + ["".join(rng.choices(pieces, k=rng.randrange(1, 400))) for _ in range(300)]


def test_cuts_and_texts_rebuilt(spark):
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (5, "again"), (5, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("output", F.lit(2)).withColumn("h1", F.lit(3))
    moved = fill_in_middle.transform(frame)
    got = [tuple(r) for r in moved.collect()]
    assert sorted(got, key=str) == sorted(((k, *cut_by_hand(k, t)) for k, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digests = fill_in_middle.digest(moved)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r.doc_id, r.restored_sha256) for r in digests.where("doc_id is not null").collect()) == sorted((k, sha(t)) for k, t in rows if k is not None)
    assert fill_in_middle.transform(frame.where("false")).count() == 0


def test_rates_and_seeds_are_parameters(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some text, here").alias("text"))
    forms = lambda **k: Counter(r.form for r in fill_in_middle.transform(frame, **k).collect())
    assert set(forms(rate=0)) == {"plain"} and set(forms(rate=100, spm=100)) == {"spm"} and set(forms(rate=100, spm=0)) == {"psm"}
    assert fill_in_middle.transform(frame, seed="2").collect() != fill_in_middle.transform(frame).collect()


@pytest.mark.parametrize(("step", "piece"), [(1, 7), (3, 5), (16, 64), (4096, 1 << 18)])
def test_checkpoints_find_every_cut(step, piece):
    for text in ["", "abc", "a b c", "ééé a", "x" * 500 + " é " + "y" * 300, "😀" * 40 + "ab12" * 30]:
        data, units = text.encode(), UNIT.findall(text)
        index = fill_in_middle.Checkpoints(data, step, piece)
        assert (index.units, index.length, len(index.bytes)) == (len(units), len(text), -(-len(units) // step))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


def test_a_very_long_text_keeps_few_checkpoints(spark):
    text = "word and 数 " * 400_000
    index = fill_in_middle.Checkpoints(text.encode())
    assert index.units == len(UNIT.findall(text)) and len(index.points) == -(-index.units // fill_in_middle.STEP)
    assert bisect.bisect(index.points, index.length) == len(index.points)
    (r,) = fill_in_middle.transform(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()
    assert tuple(r)[1:] == cut_by_hand(3, text)


# Divergence of sources


def audit_by_hand(rows, min_docs=3, top=200):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(fold)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in own for t in d[2]).items() if n >= min_docs)
        count = lambda of: {t: sum(d[2][t] for d in of) for t in kept}
        share = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        counts = {s: count([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        shares, whole = {s: share(c) for s, c in counts.items()}, share(count(own))
        for s in counts:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(shares[s][t], whole[t]), t) for t in kept if counts[s][t] and shares[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(spark, rows, **k):
    frame = spark.createDataFrame([(i, t, la, s, 0) for i, (la, s, t) in enumerate(rows)], DOCS)
    clashing = frame.withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).withColumn("total", F.lit(3)).withColumn("value", F.lit(4))
    got = divergence_audit.audit(clashing, **k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def sources(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("wo", "Ünd", "数", "x", "THE", "é") for b in "abcdefgh"][:words]
    out = []
    for _ in range(n):
        text = " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(30)))
        out.append((rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None]), rng.choice([text, text.replace(" ", "-7_"), None])))
    return out


def test_divergence_is_that_of_every_term(spark):
    rows = sources(6, 200, 48) + [("fr", "only", "un deux trois")] + [("zz", "none", "1 2 3"), ("zz", "empty", None), ("zz", "", "")]
    assert audited(spark, rows) == audit_by_hand(rows)
    assert audited(spark, rows[:60], min_docs=1, top=3) == audit_by_hand(rows[:60], 1, 3)


def test_divergence_of_odd_tables(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None)]) == []
    rows = [("en", "a", "one one two")] * 3 + [("en", "b", "")] + [("en", "c", "one " * 500 + "three")] * 3
    assert audited(spark, rows) == audit_by_hand(rows)
    ties = [("en", s, "x y z") for s in "abcd"]
    assert audited(spark, ties) == audit_by_hand(ties)


def test_joint_counts_hold_every_kept_term_once(spark):
    tallies = spark.createDataFrame([("en", "a", "b", 3, 2, 1), ("en", "a", "a", 3, 0, 2), ("en", "b", "b", 2, 0, 2), ("en", "c", "c", 1, 0, 1)], "lang string, a string, b string, na long, nb long, k long")
    groups = spark.createDataFrame([("en", "a", 6, 2, 4), ("en", "b", 4, 2, 4), ("en", "c", 1, 1, 4)], "lang string, source string, total long, own long, terms long")
    got = {(r.a, r.b, r.na, r.nb): r.terms_so for r in divergence_audit.joint_counts(tallies, groups).collect()}
    assert got == {
        ("a", "b", 3, 2): 1, ("a", "b", 3, 0): 1, ("a", "b", 0, 2): 1, ("a", "b", 0, 0): 1,
        ("a", "c", 3, 0): 2, ("a", "c", 0, 1): 1, ("a", "c", 0, 0): 1,
        ("b", "c", 2, 0): 2, ("b", "c", 0, 1): 1, ("b", "c", 0, 0): 1,
    }


def test_terms_of_long_texts_are_cut_at_their_ends(monkeypatch):
    text = "Word 12 wörd-" * 50
    monkeypatch.setattr(divergence_audit, "PIECE", 5)
    pieces = list(divergence_audit.terms_of(text))
    assert len(pieces) > 50 and Counter(itertools.chain(*pieces)) == Counter({b"word": 50, "wörd".encode(): 50})


@pytest.mark.parametrize("wide", [1, 1 << 50])
def test_tallies_by_one_number_and_by_five(monkeypatch, wide):
    monkeypatch.setattr(divergence_audit, "COMBINATIONS", 2)
    cells = [("en", [("b", 2), ("a", 3 * wide)]), ("en", [("a", 3 * wide), ("b", 2), ("c", wide)]), ("de", [("c", 1)])]
    batch = pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells]), pa.array([[{"source": s, "n": n} for s, n in c[1]] for c in cells])], ["lang", "cells"])
    got = Counter()
    for told in divergence_audit._tallied([batch]):
        for r in told.to_pylist():
            got[tuple(r.values())[:5]] += r["k"]
    assert got == {
        ("en", "a", "a", 3 * wide, 0): 2, ("en", "b", "b", 2, 0): 2, ("en", "c", "c", wide, 0): 1, ("de", "c", "c", 1, 0): 1,
        ("en", "a", "b", 3 * wide, 2): 2, ("en", "a", "c", 3 * wide, wide): 1, ("en", "b", "c", 2, wide): 1,
    }


@pytest.mark.parametrize("name", ["op11_cover_tree", "op12_fill_in_middle", "op13_divergence_audit"])
def test_query_matches_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registry.queries()[name](spark, small).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
