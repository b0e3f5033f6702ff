"""HTML extraction: block rules in two passes.

The page is cut into blocks of text at block-level tags. The first pass classifies each by
link density, length and stop-word density. In the second, blocks that it can't decide, short
ones and middling ones, inherit from the nearest decided neighbours.

What containers say is one more feature of a block. One whose tag or name says that it holds
something else (menus, footers, adverts, comments, forms) makes its blocks bad, and they
tell their neighbours nothing. An article or main element is believed if at least half of
the text that the first pass finds good on the page, by density alone, is inside: then blocks
outside are bad, inside ones need fewer stop words, and the element's edges count as good. If
it isn't (teasers and comments are articles, too), or if there is none, the rules decide all.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: What HTML says of its elements.
DROPPED = frozenset("script style noscript template svg math iframe object canvas select option textarea button title head".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SHELL = frozenset("nav footer aside form menu dialog header fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in an element's class, id or role that say that it is not the article.
NOTABLE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|disqus|replies|respond|cookie|cookies|consent|notice|notices|gdpr|footer|header|masthead|menu|nav|navbar|navigation|newsletter|subscribe|signup|login|popup|modal|promo|promoted|sponsor|sponsored|related|recommended|share|sharing|social|sidebar|widget|toolbar|pagination|pager|search|complementary|contentinfo|alert)(?:$|[\s_-])",
    re.I,
)
#: Frequent words of the languages at hand; a parameter of extract().
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their "
    "der die das und ist von zu mit den des im für auf dem nicht ein eine als auch es sich "
    "le la les de des du et est une un que qui dans pour pas sur au par avec ne il ce "
    "el los las y en que del se por con para una su al lo como más".split()
)
TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([!?/][^>]*+>))")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LOOSE = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|([!?/][^>]*+>))")  # a quote is left open
SPACE = re.compile(r"\s+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}


class Block:
    """A run of text without a block boundary inside."""

    __slots__ = ("chars", "decided", "label", "linked", "text", "words", "stops", "heading", "article", "shell", "list")

    def __init__(self, parts: list[tuple[str, bool]], heading: bool, article: bool, shell: bool, in_list: bool, stop_words: frozenset[str]) -> None:
        self.text = SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
        self.chars = len(self.text)
        self.linked = min(self.chars, sum(len(SPACE.sub(" ", t).strip()) for t, link in parts if link))
        words = self.text.lower().split()
        self.words = len(words)
        self.stops = sum(w.strip(".,;:!?()[]\"'*#%$&") in stop_words for w in words)
        self.heading, self.article, self.shell, self.list = heading, article, shell, in_list
        self.label, self.decided = "", False


def blocks(html: str, stop_words: frozenset[str] = STOP_WORDS) -> list[Block]:
    """All blocks with text, in page order. Unclosed and stray tags are borne."""
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are shells
    parts: list[tuple[str, bool]] = []
    shells = articles = links = breaks = lists = 0
    heading = 0
    at, n = 0, len(html)
    last = html.rfind(">")  # no tag ends after it
    unclosed: set[str] = set()

    def close() -> None:
        nonlocal parts, breaks
        breaks = 0
        if parts:
            block = Block(parts, heading > 0, articles > 0, shells > 0, lists > 0, stop_words)
            if block.text:
                out.append(block)
            parts = []

    def count(name: str, shell: bool, by: int) -> None:
        nonlocal shells, articles, links, heading, lists
        shells += by * shell
        articles += by * (name in ("article", "main"))
        links += by * (name == "a")
        heading += by * (name in HEADING)
        lists += by * (name == "li")

    def text(piece: str) -> None:
        nonlocal breaks
        if piece:
            if not piece.isspace():
                breaks = 0
            parts.append((unescape(piece), links > 0))

    while at < n:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        if start > last:
            text(html[at:])
            break
        m = TAG.match(html, start) or LOOSE.match(html, start)
        if not m:
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        at = m.end()
        if m[1]:  # a comment, to its end
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[5]:
            continue
        name = m[3].lower()
        if m[2]:
            if name == "br":
                parts.append((" ", links > 0))
                continue
            if name in BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for other, shell in stack[i:]:
                        count(other, shell, -1)
                    del stack[i:]
                    break
                # An inline end tag reaches over inline elements only.
                if stack[i][0] in BLOCK and name not in BLOCK:
                    break
            continue
        if name == "br":
            breaks += 1
            parts.append((" ", links > 0))
            if breaks > 1:
                close()
            continue
        if name in RAW:
            end = None if name in unclosed else RAW_END[name].search(html, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = n
            else:
                unclosed.add(name)  # its tag alone is passed over
            continue
        if name in BLOCK:
            close()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in HEADING:
                # An open paragraph, and what it left open, ends here.
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name or (name != "p" and stack[i][0] == "p"):
                        for other, shell in stack[i:]:
                            count(other, shell, -1)
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
        if name in VOID or m[4].endswith("/"):
            continue
        names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(m[4]))
        # An article's own header holds its title.
        shell = name in DROPPED or (name in SHELL and not (name == "header" and articles)) or (name not in ("html", "body", "article", "main") and bool(NOTABLE.search(names))) or "hidden" in m[4].lower().split()
        stack.append((name, shell))
        count(name, shell, 1)
    close()
    return out


def label(found: list[Block], max_links: float = 0.5, short: int = 70, long: int = 200, low: float = 0.05, high: float = 0.2) -> None:
    """Both passes; each block ends as good or bad."""
    for b in found:
        stops = b.stops / max(1, b.words)
        if b.shell or b.linked > max_links * b.chars:
            b.label = "bad"
        elif b.chars < short:
            b.label = "short"
        elif stops >= high:
            b.label = "good" if b.chars > long else "near"
        else:
            b.label = "near" if stops >= low else "bad"
    good = [b for b in found if b.label in ("good", "near") and not b.shell]
    believed = any(b.article and not b.shell for b in found) and 2 * sum(b.chars for b in good if b.article) >= sum(b.chars for b in good)
    if believed:
        for b in found:
            if not b.article:
                b.label = "bad"
            elif not b.shell and b.linked <= max_links * b.chars:
                b.label = "short" if b.chars < short else "good" if b.stops >= low * b.words else "near"
            elif not b.shell and not b.list:
                b.label = "short" if b.chars < short else "near"  # a link in running text
    for b in found:
        b.decided = b.label in ("good", "bad")
    # Middling blocks are decided first, then the short ones.
    for kind in ("near", "short"):
        before, after = _nearest(found, believed), [(x, d) for x, d in reversed(_nearest(found[::-1], believed))]
        for b, (x, far_x), (y, far_y) in zip(found, before, after, strict=True):
            if b.label != kind or b.decided:
                continue
            if b.heading:  # what it heads comes after it
                b.label = y
            elif x == y or (kind == "near" and not believed):
                b.label = "good" if "good" in (x, y) else "bad"
            elif believed:
                b.label = x if far_x < far_y else y if far_y < far_x else "good"
            else:
                b.label = "bad"
        for b in found:
            b.decided = b.label in ("good", "bad")


def _nearest(found: list[Block], believed: bool) -> list[tuple[str, int]]:
    """For each block, the label of the last decided one before it that may tell, and how far off it is."""
    out, last, far = [], "good" if believed else "bad", 1 << 30
    for b in found:
        out.append((last, far))
        if b.shell or (believed and not b.article):
            continue
        far += 1
        if b.decided:
            last, far = b.label, 1
    return out


def main_text(html: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """Text of the good blocks, one a line."""
    found = blocks(html or "", stop_words)
    label(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """keep, text and n_chars of every row.

    text is the article's: white space inside a block is one space, blocks are trimmed and
    joined by one line feed, in page order. Null and empty pages, and pages without an
    article's text, give an empty text. A script or style that is never closed takes the rest
    of its page; other elements of raw text then lose their tag only. Repeated rows give repeated rows; columns outside
    keep are not read.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are names of the result")
    read = pages.select(*(F.col(f"`{k}`") for k in keep), F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{k}` {read.schema[k].dataType.simpleString()}" for k in keep) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), stop_words) for h in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return read.mapInArrow(run, schema)
