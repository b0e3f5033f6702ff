"""Texts of pages: escaping, words, and markup of recognised text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def legal(text: Column) -> Column:
    """Text with characters that XML can't hold replaced."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "�")


def _legal_words(text: Column) -> Column:
    """The text with the characters of its words made legal, one for one; white space stays, as it parts words."""
    return F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F￾￿]", "�")


def xml_text(text: Column) -> Column:
    return escaped(legal(text))


def escaped(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, n, word): words of each line, numbered from 0."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    return lines.select(id_col, F.col("line").cast("long").alias("line"), F.posexplode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("n", "word")).withColumn("n", F.col("n").cast("long"))


def books(pages: DataFrame, book: str, order: str, text: str) -> DataFrame:
    """One text a book, pages in order and parted by form feeds. A book is one file, so its size is a file's."""
    g = pages.groupBy(book).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("p"), F.count("*").alias("pages"))
    return g.select(book, F.array_join(F.transform("p", lambda s: s[text]), "\f").alias("book"), "pages")


def numbered_name(position: Column, total: Column, rest: Column) -> Column:
    width = F.greatest(F.length(total.cast("string")), F.lit(4))
    return F.concat(F.lpad(position.cast("string"), width, F.lit("0")), rest)


#: Words of a line that are put together at once; a line has any number of such pieces.
PIECE = 64


def _word_boxes(line: Column, i: Column, char_w: int, line_h: int, shown: Callable[..., Column]) -> Column:
    """shown(word, left, top, right, bottom) of each word of line i, joined; a character is char_w wide, a line line_h high.

    Each step copies what its piece has so far, so lines are taken in pieces and cost as their length.
    """
    top, bottom = (i * line_h).cast("string"), ((i + 1) * line_h).cast("string")

    def step(a: Column, w: Column) -> Column:
        end = a["at"] + F.length(w)
        return F.struct((end + 1).alias("at"), F.concat(a["out"], shown(w, (a["at"] * char_w), top, end * char_w, bottom)).alias("out"))

    def piece(a: Column, words: Column) -> Column:
        made = F.aggregate(words, F.struct(a["at"].alias("at"), F.lit("").alias("out")), step)
        return F.transform(F.array(made), lambda m: F.struct(m["at"].alias("at"), F.concat(a["out"], F.array(m["out"])).alias("out")))[0]

    def pieces(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(PIECE)), lambda k: F.slice(found, k, PIECE))

    # The words stand in an array of one, so that they are found once.
    split = F.transform(F.array(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))), pieces)[0]
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.array_join(F.aggregate(split, zero, piece, lambda a: a["out"]), "")


def hocr_head(title: Column, engine: str) -> Column:
    """What comes before the pages of an hOCR file."""
    return F.concat(
        F.lit("<?xml version='1.0' encoding='UTF-8'?>\n<html xmlns='http://www.w3.org/1999/xhtml'>\n<head>\n<title>"), xml_text(title),
        F.lit(f"</title>\n<meta http-equiv='Content-Type' content='text/html;charset=utf-8'/>\n<meta name='ocr-system' content='{engine}'/>\n<meta name='ocr-capabilities' content='ocr_page ocr_line ocrx_word'/>\n</head>\n<body>\n"),
    )


def hocr_pages(docs: DataFrame, id_col: str, text_col: str, char_w: int = 10, line_h: int = 20) -> DataFrame:
    """One hOCR page a document: a line for each line, a word span with its box for each word."""

    def shown(w: Column, *box: Column) -> Column:
        return F.concat(F.lit("<span class='ocrx_word' title='"), F.concat_ws(" ", F.lit("bbox"), *(b.cast("string") for b in box)), F.lit("'>"), escaped(w), F.lit("</span> "))

    line_span = lambda line, i: F.concat(F.lit("<span class='ocr_line'>"), _word_boxes(line, i, char_w, line_h, shown), F.lit("</span>"))
    body = F.array_join(F.transform(F.split(_legal_words(F.col(text_col)), "\n"), line_span), "\n")
    return docs.select(id_col, F.concat(F.lit("<div class='ocr_page'>\n"), body, F.lit("\n</div>")).alias("page"))


def alto_pages(docs: DataFrame, id_col: str, text_col: str, char_w: int = 10, line_h: int = 20) -> DataFrame:
    """One ALTO page a document: a TextLine for each line, a String with its place and size for each word."""

    def shown(w: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
        parts = (("HPOS", left), ("VPOS", top), ("WIDTH", right - left), ("HEIGHT", F.lit(line_h)))
        return F.concat(F.lit('<String CONTENT="'), escaped(w), F.lit('"'), *(F.concat(F.lit(f' {n}="'), v.cast("string"), F.lit('"')) for n, v in parts), F.lit("/>"))

    line_element = lambda line, i: F.concat(F.lit("<TextLine>"), _word_boxes(line, i, char_w, line_h, shown), F.lit("</TextLine>"))
    body = F.array_join(F.transform(F.split(_legal_words(F.col(text_col)), "\n"), line_element), "\n")
    return docs.select(id_col, F.concat(F.lit("<Page><PrintSpace>\n"), body, F.lit("\n</PrintSpace></Page>")).alias("page"))
