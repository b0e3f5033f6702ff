"""Queries over whole tables, one for each operator of this package, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import cover_tree, decontamination, divergence_audit, fill_in_middle, html_extract, jaccard_join, line_dedup, personal_data, quality_model, quality_rules, secret_scan, source_mix, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(_table(spark, sf_dir, "documents"), [3.0, 1.0, 2.0])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages, url_filter.train(url_filter.rule_labels(pages), rule_col="rule"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.drop("removed_lines")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.labelled_samples(docs)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(_table(spark, sf_dir, "documents")))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.component_ids(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transform(_table(spark, sf_dir, "documents")))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(_table(spark, sf_dir, "documents"))


OPERATORS = (op1_source_mix, op2_url_filter, op3_quality_model, op4_decontamination, op5_quality_rules, op6_secret_scan, op7_line_dedup, op8_personal_data, op9_html_extract, op10_jaccard_join, op11_cover_tree, op12_fill_in_middle, op13_divergence_audit)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SETS = f"""
words AS (SELECT doc_id, {WORDS.format(text=LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words)"""

OP10 = f"""
WITH RECURSIVE {_SETS},
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS low FROM sets UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.low) AS component_id
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


OP5 = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, {WORDS.format(text="t")} AS w FROM texts),
lines AS (SELECT rid, host, no_host, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS no FROM texts),
worded AS (SELECT rid, host, no_host, line, no, array_to_string({WORDS.format(text=LOWER.format(text="line"))}, ' ') AS norm, len({WORDS.format(text="line")}) AS n
  FROM lines WHERE len({WORDS.format(text="line")}) > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY rid),
grams AS (SELECT rid, unnest(range(len(w) - 2)) AS pos, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS g FROM words WHERE len(w) >= 3),
twice AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS c FROM grams),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM twice WHERE c > 1) GROUP BY rid),
shape AS (SELECT rid, string_agg(no || ':' || norm, chr(10) ORDER BY no) AS shape FROM worded GROUP BY rid),
seen AS (SELECT host, no_host, norm, count(DISTINCT shape) AS docs FROM worded JOIN shape USING (rid) GROUP BY ALL),
hosts AS (SELECT host, no_host, least(0.002 * count(*), 1000) AS lim FROM texts GROUP BY ALL),
heavy AS (SELECT host, no_host, norm FROM seen JOIN hosts USING (host, no_host) WHERE docs > 5 AND docs > lim),
lost AS (SELECT rid, sum(n) AS n_lost FROM worded SEMI JOIN heavy USING (host, no_host, norm) GROUP BY rid),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost_words
  FROM words LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lost USING (rid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND n_lost_words <= 0.5 * n_words AS kept FROM base
"""

OP7 = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
norm AS (SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS x FROM lines),
firsts AS (SELECT x, doc_id, no, length(x) AS n FROM norm WHERE length(x) >= 1 QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, no) = 1),
near AS (SELECT DISTINCT a.doc_id, a.no FROM firsts a JOIN (SELECT *, unnest([n - 1, n, n + 1]) AS m FROM firsts) b
  ON a.n >= 25 AND b.n >= 25 AND a.n = b.m AND (b.doc_id, b.no) < (a.doc_id, a.no) AND (left(a.x, 10) = left(b.x, 10) OR right(a.x, 10) = right(b.x, 10)) AND levenshtein(a.x, b.x) <= 1),
kept AS (SELECT doc_id, no FROM firsts ANTI JOIN near USING (doc_id, no) UNION ALL SELECT doc_id, no FROM norm WHERE length(x) < 1),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text, count(*) AS k FROM lines JOIN kept USING (doc_id, no) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
  CAST(len(string_split(d.text, chr(10))) - coalesce(k, 0) AS BIGINT) AS n_removed, coalesce(t.text, '') AS text
FROM documents d LEFT JOIN texts t USING (doc_id)
"""


OP11 = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings),
sound AS MATERIALIZED (SELECT rid, vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS d FROM rows
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.rid AS a, b.rid AS b FROM sound a JOIN sound b ON a.d = b.d AND a.rid <> b.rid AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT rid AS node, vec_id AS low FROM rows UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node),
lows AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN lows ON rid = node LEFT JOIN counts ON rid = a
"""

OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS k2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS k3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS k4 FROM t),
c AS (SELECT doc_id, t, len(u) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k3 >= 90 THEN 'plain' WHEN k4 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m, array_to_string(u[greatest(k1, k2) + 1:], '') AS s FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c
"""

OP13 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tokens AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
sources AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n, v FROM sources s JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, CAST(1 + 1000000000 * CAST(n + 1 AS HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + v) AS HUGEINT) AS p,
  CAST(1 + 1000000000 * CAST(all_n + 1 AS HUGEINT) // (sum(all_n) OVER (PARTITION BY lang, source) + v) AS HUGEINT) AS q FROM grid),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5, "op7_line_dedup": OP7, "op10_jaccard_join": OP10, "op11_cover_tree": OP11, "op12_fill_in_middle": OP12, "op13_divergence_audit": OP13}
