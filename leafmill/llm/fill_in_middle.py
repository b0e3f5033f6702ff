"""Fill-in-the-middle: texts cut at two places and rearranged, so that a model learns to fill a gap.

A text is counted in units: a run of letters A-Z in either case, or any other single code
point. Counting reads a text once, piece by piece, and writes down the byte and the
code-point offset of every STEP-th unit. A cut after k units is then found by a binary
search among these checkpoints and a short scan from the last one before it, so that neither the
units nor the code points of a text are ever held as a list, however long it is.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.llm.words import text_chunks, thrifty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints, and bytes that are counted or rescanned at once.
STEP, PIECE = 4096, 1 << 18
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _begins(raw: np.ndarray, before: int) -> np.ndarray:
    """Whether a unit begins at each byte; before is the byte ahead of them, or 0."""
    letter = _LETTER[raw]
    follows = np.empty(len(raw), bool)
    follows[:1] = _LETTER[before]
    follows[1:] = letter[:-1]
    return _POINT[raw] & ~(letter & follows)


class Checkpoints:
    """Offsets of every step-th unit of a text, given as UTF-8."""

    def __init__(self, data: bytes, step: int = STEP, piece: int = PIECE):
        self.data, self.step, self.piece = data, step, piece
        self.bytes: list[int] = []  # where unit 0, step, 2 * step, ... begins
        self.points: list[int] = []
        units = points = 0
        for at in range(0, len(data), piece):
            raw = np.frombuffer(data, np.uint8, min(piece, len(data) - at), at)
            begins = np.flatnonzero(_begins(raw, data[at - 1] if at else 0))
            marks = begins[-units % step :: step]
            if len(marks):
                before = np.cumsum(_POINT[raw])
                self.bytes += (at + marks).tolist()
                self.points += (points + before[marks] - 1).tolist()
            units += len(begins)
            points += int(np.count_nonzero(_POINT[raw]))
        self.units, self.length = units, points

    def cut(self, k: int) -> tuple[int, int]:
        """Byte and code-point offset of the place after the first k units."""
        if k >= self.units:
            return len(self.data), self.length
        near = bisect.bisect_right(range(0, self.units, self.step), k) - 1
        at, point, unit = self.bytes[near], self.points[near], near * self.step
        size = max(256, 4 * self.step)
        while True:
            raw = np.frombuffer(self.data, np.uint8, min(size, len(self.data) - at), at)
            begins = np.flatnonzero(_begins(raw, self.data[at - 1] if at else 0))
            if unit + len(begins) > k:
                place = int(begins[k - unit])
                return at + place, point + int(np.count_nonzero(_POINT[raw[:place]]))
            at, point, unit = at + len(raw), point + int(np.count_nonzero(_POINT[raw])), unit + len(begins)
            size = self.piece


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = 90, spm: int = 20) -> DataFrame:
    """The id, n, form, prefix_chars, middle_chars and output of every row.

    The text is cut after the smaller and the larger of two numbers of units, both drawn
    from 0 to n, into prefix, middle and suffix. form is spm (suffix first) for `spm` of a
    hundred, else psm; rows beyond `rate` of a hundred, empty texts and texts that hold a
    marker stay as they are and are plain, without prefix_chars and middle_chars. Draws are
    a hash of seed and id, so reruns agree, rows that share an id draw alike, and a null id draws
    as an empty one.

    A null text is an empty one. Texts of any length are read whole, by pieces. Repeated
    rows give repeated rows; columns other than id and text are not read. An empty table gives an
    empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    read = docs.select(F.col(id_col).alias("id"), *draws, F.col(text_col).cast("string").alias("text"))
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    if len(set(names)) < len(names):
        raise ValueError(f"{id_col} is a name of the result")

    @thrifty
    def run(batches):
        for batch in batches:
            h = [batch.column(i).to_numpy() for i in range(1, 5)]
            for lo, hi, texts in text_chunks(batch.column(5)):
                rows = [_rearranged((t or "").encode("utf-8", "surrogatepass"), *(int(x[lo + i]) for x in h), rate, spm) for i, t in enumerate(texts)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())], names
                )

    return read.mapInArrow(run, f"`{id_col}` {read.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def _rearranged(data: bytes, h1: int, h2: int, h3: int, h4: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    index = Checkpoints(data)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not data or h3 % 100 >= rate or any(m in data for m in marks):
        return index.units, "plain", None, None, data
    first, last = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
    (a, a_points), (b, b_points) = index.cut(first), index.cut(last)
    prefix, middle, suffix = marks[0] + data[:a], marks[2] + data[a:b], marks[1] + data[b:]
    order = (suffix, prefix, middle) if h4 % 100 < spm else (prefix, suffix, middle)
    return index.units, "spm" if h4 % 100 < spm else "psm", a_points, b_points - a_points, b"".join(order)


def restored(output: Column, form: Column) -> Column:
    """The text that transform made output from: a text with markers of its own is plain, so each marker is found once."""

    def between(start: str, end: str | None) -> Column:
        at = F.instr(output, start) + len(start)
        return F.substring(output, at, F.length(output) if end is None else F.instr(output, end) - at)

    prefix, suffix = F.when(form == "psm", between(PREFIX, SUFFIX)).otherwise(between(PREFIX, MIDDLE)), F.when(form == "psm", between(SUFFIX, MIDDLE)).otherwise(between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, between(MIDDLE, None), suffix))


def digest(moved: DataFrame) -> DataFrame:
    """transform's rows with hashes in place of output: of itself, and of the text rebuilt from it."""
    return moved.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256)).drop("output")
