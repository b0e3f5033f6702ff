"""Personal data: regular expressions propose, checksums confirm, context words adjust.

Everything is DataFrame functions. A span starts from its kind's score; a context word
near it adds to that, and kinds without a checksum need one to pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.llm.spans import apart, joined, kept, matches, readable

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Score before context, and words that raise it when they stand near.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "mail|e-mail|contact|write to", "ip": "ip|server|host|address|login", "card": "card|visa|mastercard|amex|credit|payment|tarjeta|karte|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono|téléphone", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social security|taxpayer|tax id",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.split(F.reverse(digits), "")
    worth = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN, without spaces, leaves 1 when its letters are read as 10 to 35 and its first four characters last."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def near(span: Column, words: str) -> Column:
    """Whether one of the words stands near the span: in what matches() gives as before and after."""
    return F.lower(F.concat_ws(" | ", span["before"], span["after"])).rlike(rf"(?<![a-z])(?:{words})(?![a-z])")


def find(docs: DataFrame, text_col: str = "text", reach: int = 40, min_score: float = 0.5) -> DataFrame:
    """docs with found: array<struct<start, rank, end, kind, value, score>>, by kind, then start.

    email, ip, card and phone spans stay whatever their score. iban spans need their
    checksum, ssn spans a context word, as they reach min_score only so; both overlap no
    other span. Null and empty texts have no spans. All columns of docs are passed on, but
    for one named found.
    """
    text = F.col("__read")
    # The row travels as one column, so that no name of it can clash.
    own = [c for c in docs.columns if c != "found"]
    read = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("__row"), readable(F.col(f"`{text_col}`")).alias("__read"))

    def score(kind: str):
        return lambda s: F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near(s, CONTEXT[kind]), 0.3).otherwise(0.0))

    bare = lambda v: F.regexp_replace(v, "[^0-9]", "")
    digits = lambda v, low, high: F.length(bare(v)).between(low, high)
    read = read.withColumns(
        {
            "__email": kept(matches(text, EMAIL, text.contains("@"), reach), lambda v: F.lit(True), "email", 0, score("email")),
            "__ip": kept(matches(text, IP, text.rlike(r"[0-9]\.[0-9]"), reach), lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), "ip", 1, score("ip")),
            "__card": kept(matches(text, CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), reach), lambda v: F.when(digits(v, 13, 19), luhn(bare(v))).otherwise(F.lit(False)), "card", 2, score("card")),
            "__phone": kept(matches(text, PHONE, text.contains("+"), reach), lambda v: digits(v, 9, 15), "phone", 3, score("phone")),
            "__iban": kept(matches(text, IBAN, text.rlike("[A-Z]{2}[0-9]{2}"), reach), lambda v: mod97(F.translate(v, " ", "")), "iban", 4, score("iban")),
            "__ssn": kept(matches(text, SSN, text.rlike("[0-9]-[0-9]{2}-[0-9]"), reach), lambda v: F.lit(True), "ssn", 5, score("ssn")),
        }
    )
    read = read.withColumn("__base", F.concat("__email", "__ip", "__card", "__phone"))
    added = apart(F.filter(F.concat("__iban", "__ssn"), lambda s: s["score"] >= min_score), F.col("__base"))
    by_kind = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"].alias("r"), s["start"].alias("s"), s.alias("span")))), lambda x: x["span"])
    return read.select("__row", by_kind(F.concat("__base", added)).alias("__found")).select(*(F.col(f"__row.`{c}`").alias(c) for c in own), F.col("__found").alias("found"))


def digest(searched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, a hash of the base spans, all spans as text, and their scores in the same order."""
    base = F.filter("found", lambda s: s["rank"] < 4)
    count = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    return searched.select(F.col(id_col), *(count(i).alias(f"n_{KINDS[i]}") for i in range(4)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
