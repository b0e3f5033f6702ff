"""Secret scan: patterns for known shapes, and character Markov models for the rest.

Two bigram models, one of random strings and one of ordinary identifiers, are counted from
labelled samples; a token whose log-likelihood ratio per character is high enough reads
like a key. Counting, scoring and matching are DataFrame functions throughout; only the
table of character pairs, of a fixed size, passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.llm.shared import hash_sample
from leafmill.llm.spans import apart, joined, kept, matches, readable

#: Characters of the models; any other counts as the last one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")


def labelled_samples(docs: DataFrame, text_col: str = "text", rows: int = 400, random_rows: int = 4000) -> DataFrame:
    """(token, random): samples to count the models from.

    Random strings are hex and base64 forms of hashes of running numbers. Ordinary
    identifiers are the letter words of about `rows` texts, chosen by hash, bare, as snake_case pairs, as camelCase pairs and with a number behind. Both bounds are parameters:
    the models have a few thousand cells, which more rows would not change.
    """
    spark = docs.sparkSession
    n = F.col("id")
    made = spark.range(random_rows)
    sha = F.sha2(n.cast("string"), 256)
    code = F.base64(F.unhex(sha))
    # Base64 in pieces shows all its characters, hex its sixteen.
    random = made.select(F.explode(F.array(F.substring(sha, 1, 40), F.substring(code, 1, 40), F.translate(F.substring(code, 1, 32), "+/=", "xQ7"), F.upper(F.translate(F.substring(code, 1, 20), "+/=", "xQ7")))).alias("token"))
    chosen = hash_sample(docs.select(F.col(f"`{text_col}`").alias("text")).where("text is not null").select("text", F.xxhash64("text").alias("h")), ["h"], rows).dropDuplicates(["h"])
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    pairs = chosen.select(words.alias("w")).select("w", F.slice("w", 2, 1_000_000_000).alias("x"))
    pairs = pairs.select(F.explode(F.arrays_zip("w", "x")).alias("p")).where("p.x is not null")
    numbered = F.concat_ws("_", F.lower("p.x"), (F.length("p.w") * 7 % 100).cast("string"))
    ordinary = pairs.select(F.explode(F.array(F.col("p.w"), F.concat_ws("_", "p.w", "p.x"), F.concat(F.lower("p.w"), F.initcap("p.x")), numbered)).alias("token"))
    return random.select("token", F.lit(True).alias("random")).unionByName(ordinary.select("token", F.lit(False).alias("random")))


def pair_table(samples: DataFrame, token_col: str = "token", random_col: str = "random") -> list[float]:
    """Log ratio of P(second | first) between the two models, by pairs of characters, row by row."""
    k = len(ALPHABET) + 1
    code = lambda at: F.instr(F.lit(ALPHABET), F.substring(F.col("t"), at, F.lit(1)))
    pairs = samples.select(F.col(token_col).alias("t"), F.col(random_col).alias("r")).where(F.length("t") >= 2)
    pairs = pairs.select("r", F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: code(i) * k + code(i + 1)).alias("p"))
    counts = {(r.r, r.p): r.n for r in pairs.select("r", F.explode("p").alias("p")).groupBy("r", "p").agg(F.count("*").alias("n")).collect()}
    # A pair's probability leans on its second character's, so pairs never seen still tell.
    total = {r: sum(n for (s, _), n in counts.items() if s == r) for r in (True, False)}
    second_p = {r: [(sum(counts.get((r, a * k + b), 0) for a in range(k)) + 0.5) / (total[r] + 0.5 * k) for b in range(k)] for r in (True, False)}
    table = []
    for a in range(k):
        sums = {r: sum(counts.get((r, a * k + b), 0) for b in range(k)) for r in (True, False)}
        for b in range(k):
            p = {r: (counts.get((r, a * k + b), 0) + 5 * second_p[r][b]) / (sums[r] + 5) for r in (True, False)}
            table.append(math.log(p[True] / p[False]))
    return table


def likeness(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the token's character pairs."""
    k = len(ALPHABET) + 1
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), F.when(a["last"] < 0, F.lit(0.0)).otherwise(a["sum"] + F.get(table, a["last"] * k + c)).alias("sum"))
    return F.aggregate(codes, zero, step, lambda a: a["sum"]) / (F.length(token) - 1)


def scan(docs: DataFrame, samples: DataFrame, text_col: str = "text", min_length: int = 20, min_ratio: float = 0.8) -> DataFrame:
    """docs with found: array<struct<start, rank, end, kind, value, score>>, by start, then kind.

    assign, access and hex are the base patterns; a random span is a run of
    [A-Za-z0-9+/_=-] of at least min_length characters with a digit whose mean log ratio is
    at least min_ratio and that overlaps no base span. Its score is that ratio. Null and
    empty texts have no spans. All columns of docs are passed on, but for one named found.
    """
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in pair_table(samples))), ",").cast("array<double>")
    text = F.col("__read")
    # The row travels as one column, so that no name of it can clash.
    own = [c for c in docs.columns if c != "found"]
    read = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("__row"), readable(F.col(f"`{text_col}`")).alias("__read"))
    long_run = rf"[A-Za-z0-9+/_=-]{{{min_length},}}+"
    read = read.withColumns(
        {
            "__assign": kept(matches(text, ASSIGN, text.contains("=") | text.contains(":")), lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6, "assign", 0),
            "__access": kept(matches(text, "AKIA[A-Z0-9]+", text.contains("AKIA")), lambda v: F.length(v) >= 20, "access", 1),
            "__hex": kept(matches(text, "[0-9a-f]{24,}+", text.rlike("[0-9a-f]{24}")), lambda v: F.length(v) >= 24, "hex", 2),
            "__long": matches(text, long_run, text.rlike(rf"[A-Za-z0-9+/_=-]{{{min_length}}}")),
        }
    )
    read = read.withColumn("__base", F.concat("__assign", "__access", "__hex"))
    free = apart(F.filter("__long", lambda s: s["value"].rlike("[0-9]")), F.col("__base"))
    read = read.withColumn("__random", kept(free, lambda v: likeness(v, table) >= min_ratio, "random", 3, lambda s: likeness(s["value"], table)))
    return read.select("__row", F.array_sort(F.concat("__base", "__random")).alias("__found")).select(*(F.col(f"__row.`{c}`").alias(c) for c in own), F.col("__found").alias("found"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, a hash of the base spans, and all spans as text."""
    base = F.filter("found", lambda s: s["rank"] < 3)
    count = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    return scanned.select(F.col(id_col), *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
