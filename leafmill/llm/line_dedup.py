"""Line dedup within an edit distance: of one by a deletion-neighbourhood join, of more by pieces.

Two lines are within one edit when deleting at most one character from each leaves the
same string. Each line therefore emits hashed keys of all strings it becomes by deleting
at most one character; lines that share a key join; the pair's edit distance is verified
on the texts, and the earlier line is kept.

A substitution shows as equal strings after deletions at one and the same place, an
insertion as one line being the other's variant. So a key group falls into cliques that
need their earliest member only, and no group is expanded into pairs.

Emitting every variant of every line would multiply the input by the lines' lengths.
Whatever one edit does, it leaves the first or the second half of the shorter line in
place, so lines first join on hashed halves, and only those with a partner there emit
variants. That loses no pair.

With a bound of k > 1 edits, variants would grow as the length to the power k. There lines
are cut into k + 1 pieces, of which k edits leave one in place, at most as far moved as
there are pieces before it. Lines that share a piece are compared first with the earliest of
their group, then, in small groups, those not yet found near anything with all earlier ones;
lines of large groups are cut into k + 2 pieces, of which two stay, and join on pairs of
pieces. Lengths and parity sketches of characters and character pairs, which k edits change
by a bounded number of bits, decide before texts travel. The edit distance is verified on
the texts.

Keys are counted before lines are sent to them: only keys that two lines have go on, so a
key of any number of lines is summed up where its lines are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from leafmill.llm.shared import drop, drop_since, mark, materialize
from leafmill.llm.words import mix, powers, running, thrifty

#: Values, of 8 bytes at most, in all rows of keys or places of lines that may be broadcast: the driver holds several times their size.
BROADCAST_VALUES = 500_000
#: Lines of a piece that are compared with one another; blocks that larger groups end up in.
SMALL_GROUP, BLOCKS = 50, 16
_U = np.uint64


def normalised(line):
    """Lower case, runs of white space as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, no, line): the normalised lines of at least min_chars characters, numbered from 0 in their document."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.select("doc", "no", normalised(F.col("line")).alias("line")).where(F.length("line") >= min_chars)


def _pieces(line, edits: int, stay: int = 1):
    """Keys of `stay` pieces each, of which two lines within so many edits share at least one; for one edit, of halves.

    Of edits + stay pieces of the shorter line, some `stay` have no edit. Piece i has moved in
    the longer line by at most i edits before it, and what it has moved by and what is moved
    between and after the pieces takes edits, too.
    """
    n = F.length(line)
    pieces, keys = edits + stay, []
    for more in range(edits + 1):  # the line as the one that is longer by so much
        shorter = n - more
        cut = lambda i: F.floor(shorter * i / pieces).cast("int")  # noqa: B023, E731
        for chosen in itertools.combinations(range(pieces), stay):
            for moved in itertools.product(*(range(-i, i + 1) for i in chosen)):
                if sum(abs(y - x) for x, y in itertools.pairwise((0, *moved, more))) <= edits:
                    keys.append(F.xxhash64(shorter, F.lit(",".join(map(str, chosen))), *(F.substring(line, cut(i) + m + 1, cut(i + 1) - cut(i)) for i, m in zip(chosen, moved, strict=True))))
    return keys


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line and of the line without each of its characters, and the places of these (-1: none)."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    up, down = powers(n + 1)
    terms = mix(codes + _U(1))
    sums = running(terms * up[:n])
    keys = np.empty(n + 1, np.uint64)
    keys[:1] = mix(sums[n:]) + _U(n)
    keys[1:] = mix(sums[:n] + (sums[n] - sums[1:]) * down[1]) + _U(n - 1)
    return mix(keys).view(np.int64), np.arange(-1, n, dtype=np.int32)


@thrifty
def _variants(batches):
    for batch in batches:
        for doc, no, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keys, places = variant_keys(line)
            for i in range(0, len(keys), 1 << 16):
                m = len(keys[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([doc] * m, pa.int64()), pa.array(np.full(m, no, np.int32)), pa.array(keys[i : i + m]), pa.array(places[i : i + m])], ["doc", "no", "key", "place"])


def _sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast in a join if its rows, of as many values as they have, are counted to be small."""
    width = sum(len(f.dataType.fields) if isinstance(f.dataType, StructType) else 1 for f in df.schema)
    return F.broadcast(df) if df.count() * width <= BROADCAST_VALUES else df


def _shared(keys: DataFrame, key: str) -> DataFrame:
    """Keys that several places (doc, no) have."""
    at = F.struct("doc", "no")
    return materialize(keys.groupBy(key).agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select(key), "shared")


def near_lines(docs: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """(doc, no) of those distinct lines with pieces, by first occurrence, that are within so many edits of an earlier one."""
    keys = firsts.select("doc", "no", F.explode("pieces").alias("piece"))
    partnered = materialize(keys.join(_sized(_shared(keys, "piece")), "piece", "left_semi").select("doc", "no").distinct(), "partnered")
    wanted = partnered.groupBy("doc").agg(F.collect_set("no").alias("wanted"))
    wanted = F.broadcast(wanted) if 2 * partnered.count() <= BROADCAST_VALUES else wanted
    raw = docs.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_picked, "doc long, no int, line string")
    lines = materialize(raw.select("doc", "no", normalised(F.col("line")).alias("line")).dropDuplicates(["doc", "no"]), "candidates")
    drop(partnered)
    return _within_one(lines) if edits == 1 else _within(lines, edits)


@thrifty
def _picked(batches):
    for batch in batches:
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            lines = text.as_py().split("\n")
            for i in range(0, len(wanted), 1 << 12):
                # Rows that share an id may have fewer lines than another of them.
                numbers = [no for no in wanted[i : i + (1 << 12)] if no < len(lines)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(numbers), pa.int64()), pa.array(numbers, pa.int32()), pa.array([lines[no] for no in numbers], pa.string())], ["doc", "no", "line"])


def _within_one(lines: DataFrame) -> DataFrame:
    keys = lines.mapInArrow(_variants, "doc long, no int, key long, place int")
    keys = materialize(keys.join(_sized(_shared(keys, "key")), "key", "left_semi").withColumn("at", F.struct("doc", "no")), "keys")
    whole, cut = (F.min(F.when(F.col("place") < 0 if out else F.col("place") >= 0, F.col("at"))) for out in (True, False))
    by_key = keys.groupBy("key").agg(whole.alias("whole"), cut.alias("cut"))
    by_place = keys.groupBy("key", "place").agg(F.min("at").alias("same"))
    joined = keys.join(by_key, "key").join(by_place, ["key", "place"])
    partner = F.least(F.when(F.col("place") >= 0, F.col("whole")), F.when(F.col("place") < 0, F.col("cut")), F.col("same"))
    pairs = joined.withColumn("partner", partner).where(F.col("partner") < F.col("at")).groupBy("doc", "no").agg(F.min("partner").alias("partner"))
    pairs = pairs.select("doc", "no", F.col("partner.doc").alias("doc2"), F.col("partner.no").alias("no2"))
    return _verified(pairs, lines, 1)


def _verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(doc, no) of the pairs (doc, no, doc2, no2) whose texts are within so many edits."""
    other = lines.select(F.col("doc").alias("doc2"), F.col("no").alias("no2"), F.col("line").alias("line2"))
    return pairs.join(lines, ["doc", "no"]).join(other, ["doc2", "no2"]).where(F.levenshtein("line", "line2", edits) >= 0).select("doc", "no").distinct()


def line_sketches(line: str) -> tuple[int, int]:
    """Parities, in 64 bits each, of the line's characters and of its pairs of neighbours; an edit changes at most 2 and 4 bits."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    both = (codes, codes[:-1] << _U(32) | codes[1:])
    return tuple(int(np.bitwise_xor.reduce(_U(1) << (mix(x + _U(1)) >> _U(58)), initial=_U(0)).view(np.int64)) for x in both)


@thrifty
def _sketched(batches):
    for batch in batches:
        both = [line_sketches(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array([x[i] for x in both], pa.int64()) for i in (0, 1)), batch.column(4)], ["doc", "no", "n", "chars", "twos", "keys"])


def _within(lines: DataFrame, edits: int) -> DataFrame:
    at = F.struct("doc", "no", "n", "chars", "twos")
    read = lines.select("doc", "no", "line", F.length("line").alias("n"))
    apart = lambda c: F.bit_count(F.col(f"at.{c}").bitwiseXOR(F.col(f"low.{c}")))
    near = (F.col("low") < F.col("at")) & (F.abs(F.col("at.n") - F.col("low.n")) <= edits) & (apart("chars") <= 2 * edits) & (apart("twos") <= 4 * edits)
    chosen = [F.col("at.doc").alias("doc"), F.col("at.no").alias("no"), F.col("low.doc").alias("doc2"), F.col("low.no").alias("no2")]
    out = None
    for stay in (1, 2):
        keyed = read.withColumn("keys", F.array_distinct(F.array(*_pieces(F.col("line"), edits, stay))))
        keys = keyed.mapInArrow(_sketched, "doc long, no int, n int, chars long, twos long, keys array<long>").select("doc", "no", at.alias("at"), F.explode("keys").alias("key"))
        groups = keys.groupBy("key").agg(F.min("at").alias("low"), F.count("*").alias("size")).where("size > 1")
        keys = materialize(keys.join(_sized(materialize(groups, "groups")), "key"), "keys")
        led = materialize(_verified(keys.where(near).select(chosen).distinct(), lines, edits), "led")
        out = led if out is None else out.unionByName(led)
        left = keys.join(_sized(led), ["doc", "no"], "left_anti")
        small = left.where(F.col("size") <= SMALL_GROUP).select("key", "at").join(keys.select("key", F.col("at").alias("low")), "key").where(near).select(chosen).distinct()
        out = out.unionByName(_verified(small, lines, edits))
        large = materialize(left.where(F.col("size") > SMALL_GROUP), "large")
        if large.isEmpty():
            return out
        # A line of a large group joins anew on more, with all that it has met there.
        members = keys.where(F.col("size") > SMALL_GROUP).select("doc", "no").distinct()
        read = read.join(_sized(members), ["doc", "no"], "left_semi")
    # What is left meets the earlier lines of its group block by block.
    block = F.pmod(F.xxhash64("at"), F.lit(BLOCKS)).cast("int")
    x = large.select("key", "at", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    pairs = x.join(keys.select("key", F.col("at").alias("low"), block.alias("block")), ["key", "block"]).where(near).select(chosen).distinct()
    return out.unionByName(_verified(pairs, lines, edits))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 25, exact_chars: int = 1, edits: int = 1) -> DataFrame:
    """docs with every line removed that repeats an earlier line or is within so many edits of it, and n_lines, n_removed.

    Lines are compared as lower case with white space runs as one space. A line of at
    least exact_chars characters then goes if an earlier one equals it, and one of at least
    min_chars also if an earlier one of at least min_chars is within edit distance edits of
    it, whether or not that one itself goes; shorter lines are left alone: with
    exact_chars 1, lines without a word. Lines come in the order of (id, number in the document).

    A null text stays null, an empty one empty, both with nothing removed. Rows that
    share an id count as one document: lines at one number in them stay or go together.
    Rows with a null id are compared with nothing and stay whole. All other columns are
    passed on as they are, whatever their names, but n_lines and n_removed are replaced.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    exact_chars = max(1, min(exact_chars, min_chars))
    kept = kept_lines(read, min_chars, exact_chars, edits)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # The text goes once: the row holds all but it.
    keyed = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text"), F.struct(*(F.col(f"`{c}`") for c in own if c != text_col)).alias("__row"))
    joined = keyed.join(kept, F.col("__doc") == F.col("doc"), "left").drop("doc")
    schema = joined.select("__row").schema

    def run(parts):
        for part in parts:
            texts, lines_n, gone = [], [], []
            for doc, text, keep in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                if doc is None or text is None:
                    left = lines
                else:
                    first = set(keep or ())
                    left = [x for i, x in enumerate(lines) if i in first or len(" ".join(_split(x)).lower()) < exact_chars]
                texts.append(None if text is None else "\n".join(left))
                lines_n.append(len(lines))
                gone.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(texts, pa.string()), pa.array(lines_n, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_removed"])

    out = joined.select("__doc", "__text", "__row", "kept").mapInArrow(thrifty(run), f"row {schema['__row'].dataType.simpleString()}, text string, n_lines long, n_removed long")
    return out.select(*((F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in own), "n_lines", "n_removed")


def _split(line: str) -> list[str]:
    return [w for w in line.translate(_BLANKS).split(" ") if w]


_BLANKS = {c: " " for c in range(0x09, 0x0E)}


def kept_lines(read: DataFrame, min_chars: int, exact_chars: int, edits: int) -> DataFrame:
    """(doc, kept): numbers of the lines of at least exact_chars characters that stay."""
    before, line = mark(), F.col("line")
    lines = _lines(read, exact_chars).select("doc", "no", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.length(line).alias("n"), F.when(F.length(line) >= min_chars, F.array(*_pieces(line, edits))).alias("pieces"))
    first = lines.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc", "no", "pieces")).alias("first"))
    firsts = materialize(first.select("first.doc", "first.no", "first.pieces"), "firsts")
    near = near_lines(read, firsts, edits)
    kept = firsts.select("doc", "no").join(near, ["doc", "no"], "left_anti")
    out = materialize(kept.groupBy("doc").agg(F.collect_set("no").alias("kept")), "kept")
    drop_since(before, out, read)
    return out
