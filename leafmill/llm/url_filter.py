"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features are computed by DataFrame functions from the url alone: lengths, depth, digit
ratio, entropy, parameter counts, and how often a suffix occurs among blocked
labels. The trees are MLlib's and score inside the JVM; they are trained from labelled
urls. What decided the labels can be masked: from urls that rules label, the trees
could only learn to repeat the rules, which don't reach the urls left to the trees.

A quarter of the hosts is held out from training, and the cut is the lowest one above which
held-out urls are blocked with the precision asked for. Where no cut reaches it, the labels
tell nothing about other hosts, and the trees block nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.llm.shared import drop_since, mark, materialize

#: (host and path that a url must begin with, verdict)
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_hyphens", "f_entropy", "f_params", "f_param_length", "f_fragment", "f_https", "f_vowels", "f_suffix", "f_suffix_seen"]


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null: its host is the url's or one above it, and the url's path starts with its path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        out = F.when(((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest)), F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character, over the characters' own frequencies."""
    chars = F.split(text, "")
    n = F.length(text)
    per = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(per, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def lexical(url: Column, name: Column, rest: Column) -> dict[str, Column]:
    """Features of a url by what its mask leaves of host and path, and its query and fragment."""
    count = lambda c, chars: (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    full = F.concat(name, rest)
    return {
        "f_length": F.length(full) + F.length(query), "f_host_length": F.length(name), "f_path_length": F.length(rest), "f_depth": count(rest, "/"), "f_labels": count(name, "."),
        "f_digits": count(full, "0123456789") / F.greatest(F.length(full), F.lit(1)), "f_hyphens": count(name, "-"), "f_entropy": entropy(name),
        "f_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "f_param_length": F.length(query), "f_fragment": url.contains("#"), "f_https": F.startswith(F.lower(url), F.lit("https:")),
        "f_vowels": count(name, "aeiou") / F.greatest(F.length(name), F.lit(1)),
    }


def masked(host: Column, path: Column, mask: tuple[int, int]) -> tuple[Column, Column]:
    """The host without a leading www and its last mask[0] labels, and the path without its first mask[1] segments."""
    name = F.regexp_replace(host, r"^www\.", "") if any(mask) else host
    for _ in range(mask[0]):
        name = F.regexp_replace(name, r"(?:^|\.)[^.]*$", "")
    rest = path
    for _ in range(mask[1]):
        rest = F.regexp_replace(rest, r"(?s)^/[^/]*", "")
    return name, rest


#: Rows of one suffix and two counts that may be broadcast.
BROADCAST_SUFFIXES = 200_000
#: Parts of the hosts that are learnt from; a url's suffix is told by the other parts.
FOLDS = 5


@dataclass
class UrlModel:
    """Trees and suffix statistics learnt from labelled urls, and the cut that held-out hosts give."""

    suffixes: DataFrame
    prior: float
    trees: object
    mask: tuple[int, int]
    #: Scores above it are blocked; None where no cut reaches the precision.
    cut: float | None
    #: Of held-out urls above the cut, the share that is labelled blocked, and their number.
    precision: float | None
    held_out: int
    #: Whether only urls whose suffix was learnt from were measured, and so may be blocked.
    seen_only: bool = False


def featured(urls: DataFrame, suffixes: DataFrame, prior: float, mask: tuple[int, int], fold: bool = False) -> DataFrame:
    """urls (url, host, path, ...) with FEATURES; the rate of the suffix, the last two labels that the mask leaves, is smoothed by two urls.

    With fold, urls have a fold and suffixes are told by fold: a url that is learnt from takes its suffix's
    rate from the other folds' hosts, or the trees would read its label there.
    """
    name, rest = masked(F.col("host"), F.col("path"), mask)
    named = urls.withColumns({"__name": name, "__rest": rest}).withColumn("suffix", F.substring_index("__name", ".", -2))
    joined = named.join(suffixes, ["suffix", "fold"] if fold else "suffix", "left")
    seen, bad = F.coalesce("suffix_urls", F.lit(0)), F.coalesce("suffix_blocked", F.lit(0))
    out = joined.withColumns({k: v.cast("double") for k, v in lexical(F.col("url"), F.col("__name"), F.col("__rest")).items()})
    out = out.withColumns({"f_suffix": (bad + 2 * prior) / (seen + 2.0), "f_suffix_seen": F.log1p(seen.cast("double")), "seen": seen > 0}).drop("suffix_urls", "suffix_blocked", "__name", "__rest", "suffix")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(out).drop(*FEATURES)


def _fitted(rows: DataFrame, trees: int, depth: int, mask: tuple[int, int]) -> tuple[DataFrame, float, object] | None:
    """Suffix statistics, share of blocked ones and trees of labelled urls; None where they have only one label."""
    stats = rows.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if stats[0] is None or stats[1] == stats[2]:
        return None
    name = masked(F.col("host"), F.col("path"), mask)[0]
    folded = rows.withColumns({"suffix": F.substring_index(name, ".", -2), "fold": F.pmod(F.xxhash64(name, F.lit(1)), F.lit(FOLDS))})
    by_fold = folded.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    suffixes = materialize(by_fold.groupBy("suffix").agg(F.sum("n").alias("suffix_urls"), F.sum("bad").alias("suffix_blocked")), "suffixes")
    others = by_fold.join(suffixes, "suffix").select("suffix", "fold", (F.col("suffix_urls") - F.col("n")).alias("suffix_urls"), (F.col("suffix_blocked") - F.col("bad")).alias("suffix_blocked"))
    features = materialize(featured(folded.drop("suffix"), others, float(stats[0]), mask, fold=True).select("features", "label"), "features")
    return suffixes, float(stats[0]), GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, stepSize=0.3, cacheNodeIds=False, maxMemoryInMB=64).fit(features)


def _scored(urls: DataFrame, fitted: tuple[DataFrame, float, object], mask: tuple[int, int], seen_only: bool) -> list[tuple[int, float, int]]:
    """(hundredth of the score, blocked urls, urls) of labelled urls that were not learnt from; with seen_only, of those whose suffix was."""
    suffixes, prior, model = fitted
    score = F.floor(vector_to_array("probability")[1] * 100)
    return [(int(r[0]), float(r[1]), int(r[2])) for r in model.transform(featured(urls, suffixes, prior, mask).where(F.col("seen") | F.lit(not seen_only))).groupBy(score.alias("bin")).agg(F.sum("label"), F.count("*")).collect()]


def train(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", trees: int = 12, depth: int = 3, mask: tuple[int, int] = (0, 0), precision: float = 0.9, rule_col: str | None = None) -> UrlModel | None:
    """Fit on all distinct labelled urls; None where they have only one label.

    Urls are distinct, so a frequent one counts once; one with
    both labels counts as blocked. A quarter of the hosts, by a hash, is held out: it is not learnt from, and gives the cut.

    Where labels are rules' (rule_col), what a rule looks at tells its label, and hosts alone
    say nothing of urls that no rule fits. Then each rule in turn is left out with all its urls: trees of the others'
    learn, and are measured on it and on the held-out hosts; the cut is taken from all turns, and the model learns from
    all urls. A rule without which there is only one label is not left out. The rules are few: each costs a fit.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rule = F.col(rule_col) if rule_col else F.lit("")
    before = mark()
    known = labelled.select(url.alias("url"), F.col(blocked_col).cast("double").alias("label"), rule.cast("string").alias("rule")).where("label is not null").groupBy("url").agg(F.max("label").alias("label"), F.max("rule").alias("rule"))
    known = known.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = materialize(known.withColumn("held", F.pmod(F.xxhash64(masked(F.col("host"), F.col("path"), mask)[0]), F.lit(4)) == 0), "labelled")
    if rule_col:
        bins = []
        for (left_out,) in sorted(known.select(F.coalesce("rule", F.lit(""))).distinct().collect()):
            own = F.coalesce("rule", F.lit("")) == left_out
            fold = _fitted(known.where(~own & ~F.col("held")), trees, depth, mask)
            bins += _scored(known.where(own | F.col("held")), fold, mask, True) if fold else []
        fitted = _fitted(known, trees, depth, mask)
    else:
        fitted = _fitted(known.where("not held"), trees, depth, mask)
        bins = _scored(known.where("held"), fitted, mask, False) if fitted else []
    if fitted is None:
        return None
    cut = reached = None
    for low in range(50, 100):
        bad, of = (sum(b[i] for b in bins if b[0] >= low) for i in (1, 2))
        if of >= 20 and bad >= precision * of:
            cut, reached = low / 100, bad / of
            break
    drop_since(before, fitted[0], labelled)
    return UrlModel(*fitted, mask, cut, reached, sum(b[2] for b in bins), rule_col is not None)


def judge(pages: DataFrame, model: UrlModel | None, rules: list[tuple[str, str]] = RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, verdict and score of every row.

    verdict is the rule's, or else block where the model's score, the probability of
    block, is at or above its cut and, where the cut was measured on such only, labelled urls have the url's suffix;
    otherwise, and without a model or a cut, it is allow. Null urls and urls without :// have
    empty host and path, fit no rule and are scored as the empty url's features say.
    Repeated rows give repeated rows. Columns not named are not read; keep can't hold a
    name of the result.
    """
    if {"host", "path", "rule", "verdict", "score"} & set(keep):
        raise ValueError("host, path, rule, verdict and score are names of the result")
    row = F.struct(*(F.col(f"`{k}`") for k in keep)).alias("__row") if keep else F.lit(None).alias("__row")
    read = pages.select(row, F.col(f"`{url_col}`").alias("raw")).select("__row", F.coalesce("raw", F.lit("")).alias("url"), host_of(F.col("raw")).alias("host"), path_of(F.col("raw")).alias("path"))
    read = read.withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    if model is None:
        scored = read.withColumns({"score": F.lit(0.0), "seen": F.lit(False)})
    else:
        suffixes = F.broadcast(model.suffixes) if model.suffixes.count() <= BROADCAST_SUFFIXES else model.suffixes
        scored = model.trees.transform(featured(read, suffixes, model.prior, model.mask)).withColumn("score", vector_to_array("probability")[1])
    cut = model.cut if model is not None else None
    verdict = F.lit("allow") if cut is None else F.when((F.col("score") >= cut) & (F.col("seen") | F.lit(not model.seen_only)), "block").otherwise("allow")
    for rule, decided in rules:
        verdict = F.when(F.col("rule") == rule, decided).otherwise(verdict)
    return scored.select(*(F.col(f"__row.`{k}`").alias(k) for k in keep), "host", "path", "rule", verdict.alias("verdict"), F.col("score"))


def rule_labels(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """(url, blocked, rule) of the urls that a rule decides."""
    rule = ruled(host_of(F.col(url_col)), path_of(F.col(url_col)), rules)
    blocked = [r for r, v in rules if v == "block"]
    return pages.select(F.col(url_col).alias("url"), rule.alias("rule")).where("rule is not null").select("url", F.col("rule").isin(blocked).alias("blocked"), "rule")


def rule_mask(rules: list[tuple[str, str]] = RULES) -> tuple[int, int]:
    """Labels of a host, from its end, and segments of a path, from its start, that the rules look at."""
    hosts = [r.partition("/")[0] for r, _ in rules]
    return max(len(h.removeprefix("www.").split(".")) for h in hosts), max(r.partition("/")[2].count("/") for r, _ in rules)
