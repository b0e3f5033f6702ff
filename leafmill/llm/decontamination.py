"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts become sequences of words (lower-cased, other ASCII than letters and digits as
blanks). An item of n words contaminates a document when some run of the document's words,
of any length, is within k = floor(max_edits * n) word edits of it; short items allow none.

A CGK walk reads a sequence with a pointer that, at each step, stays or advances by a
random bit that depends on the step and the word it points at. Sequences few edits apart
come back into step soon, so their embeddings differ in few places. An LSH key is the
words that a walk points at on some sampled steps. As the walk from a place in a document
reads the same words whatever the item's length, one walk from each place serves all
items; keys are sampled over the steps of the item's own length. Each repetition has its
own walk and sample. The number of repetitions is found by simulation on the items
themselves, edited as much as the bound allows, until the target recall is reached.

The first places to go are those where too few of the words occur in any item of the
length: of a run within k edits of an item of n words, the first n words hold at least n - k
words of it, and at least d - k of its d distinct words (an inserted word pushes at most one
out). This drops no match. A run may end with its text: the walk then points at nothing.

Items beyond what one index may hold are dealt into parts by a hash, each with an index of
its own and a scan of the documents.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from leafmill.llm.words import PLAIN, mix, text_chunks, thrifty, word_hashes

#: Characters of the items of one index, which is sent to every executor (some 4 million words of 8 bytes).
ITEM_CHARS = 32_000_000
#: Repetitions at most; an index that misses its recall with them is an error.
MOST_REPS = 200
_U = np.uint64


def plain_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts, and where each text begins."""
    return word_hashes([t.lower() if t else t for t in texts], PLAIN)


def edits(item: np.ndarray, run: np.ndarray, most: int) -> tuple[int, int]:
    """Smallest edit distance of the item to the first words of the run, and how many words that takes; most + 1 where it is larger."""
    step = np.arange(len(run) + 1)
    row = step.copy()
    for i in range(len(item)):
        best = np.minimum(row[1:] + 1, row[:-1] + (run != item[i]))
        row = np.minimum.accumulate(np.concatenate(([i + 1], best)) - step) + step
        if row.min() > most:
            return most + 1, 0
    return int(row.min()), int(row.argmin())


@dataclass
class Index:
    """Items of one benchmark with the walks and samples that find them."""

    ids: np.ndarray
    words: np.ndarray
    at: np.ndarray
    max_edits: float
    samples: int
    seed: int
    exact_below: int = 8

    def __post_init__(self) -> None:
        self.n = np.diff(self.at)
        self.k = self.allowed(self.n)
        self.vocabulary = np.unique(self.words)
        self.lengths = np.unique(self.n)
        self.kind = np.searchsorted(self.lengths, self.n)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        # Which classes of lengths, one bit each, have items with a word of the vocabulary.
        self.masks = np.zeros(len(self.vocabulary), np.uint64)
        bits = _U(1) << (self.kind % 64).astype(np.uint64)
        distinct = np.array([len(np.unique(self.words[a:b])) for a, b in zip(self.at[:-1], self.at[1:], strict=True)], np.int64)
        self.fewest = np.array([distinct[self.n == n].min() for n in self.lengths], np.int64)
        np.bitwise_or.at(self.masks, np.searchsorted(self.vocabulary, self.words), np.repeat(bits, self.n))

    def allowed(self, n: np.ndarray) -> np.ndarray:
        """Edits that items of n words allow."""
        return np.where(n < self.exact_below, 0, np.floor(self.max_edits * n + 1e-9)).astype(np.int64)

    def sampled(self, rep: int) -> np.ndarray:
        """By kind of length and step, whether the step is sampled: of twice the item's words, as a walk takes two steps a word."""
        out = np.zeros((len(self.lengths), 2 * int(self.lengths.max(initial=0))), bool)
        for i, n in enumerate(self.lengths):
            draw = random.Random(self.seed * 1_000_003 + rep * 1009 + int(n))
            out[i, draw.sample(range(2 * int(n)), min(self.samples, 2 * int(n)))] = True
        return out

    def walk(self, words: np.ndarray, start: np.ndarray, kind: np.ndarray, rep: int, ends: np.ndarray) -> np.ndarray:
        """Keys of the walks from start over items' lengths of that kind, which point at nothing beyond that or beyond ends."""
        sampled = self.sampled(rep)
        order = np.argsort(-kind, kind="stable")  # long ones first: the short ones end early
        at, of = start[order].copy(), kind[order]
        end, key = np.minimum(at + self.lengths[of], ends[order]), np.zeros(len(at), np.uint64)
        padded = np.append(words, _U(0))
        last = 2 * self.lengths[of]
        for step in range(sampled.shape[1]):
            m = int(np.searchsorted(-last, -step, "left"))  # walks of more than step steps
            if not m:
                break
            place = at[:m]
            word = np.where(place < end[:m], padded[np.minimum(place, len(words))], _U(0))
            turn = mix(word ^ _U((self.seed + 1) * 0x9E3779B97F4A7C15 + rep * 0xD1B54A32D192ED03 + step * 0x8CB92BA72F3D8DD7 & (2**64 - 1)))
            hit = np.flatnonzero(sampled[of[:m], step])
            if len(hit):
                key[hit] = mix(key[hit] * _U(31) + turn[hit])
            at[:m] += (turn >> _U(63)).astype(np.int64)
        out = np.empty(len(key), np.uint64)
        out[order] = mix(key + of.astype(np.uint64))
        return out

    def grow(self) -> None:
        """One more repetition."""
        keys = self.walk(self.words, self.at[:-1], self.kind, len(self.tables), self.at[1:])
        order = np.argsort(keys, kind="stable")
        self.tables.append((keys[order], order))

    def reach(self, recall: float, most: int, trials: int = 600) -> float:
        """Repeat until that share of copies of items with k random word edits is found; the share. Each item is tried, at least once."""
        if not len(self.n):
            return 1.0
        draw = random.Random(self.seed + 17)
        of = np.arange(max(trials, len(self.n))) % len(self.n)
        copies = []
        for i in of:
            own = list(self.words[self.at[i] : self.at[i + 1]])
            for _ in range(int(self.k[i])):
                sort, place = draw.randrange(3), draw.randrange(max(1, len(own)))
                own[place : place + (sort < 2)] = [] if sort == 1 else [_U(draw.getrandbits(63))]
            copies.append(np.array((own + [_U(draw.getrandbits(63)) for _ in range(int(self.n[i]))])[: int(self.n[i])], np.uint64))
        start = np.cumsum([0, *map(len, copies)])
        found = np.zeros(len(of), bool)
        while found.mean() < recall and len(self.tables) < most:
            self.grow()
            keys, order = self.tables[-1]
            own = np.empty(len(self.n), np.uint64)
            own[order] = keys
            found |= self.walk(np.concatenate(copies), start[:-1], self.kind[of], len(self.tables) - 1, start[1:]) == own[of]
        return float(found.mean())

    def matches(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, words, edits) of verified runs: the best of each text and item, the first of equals."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(words) or not len(self.vocabulary):
            return []
        real, longest = len(words), int(self.lengths[-1])
        words = np.append(words, np.zeros(longest, np.uint64))  # so that runs at the end have their length
        spot = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        mask = np.where(self.vocabulary[spot] == words, self.masks[spot], _U(0))
        mask[real:] = 0
        ends = np.append(np.repeat(at[1:], np.diff(at)), np.zeros(longest, np.int64))
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # Words that don't repeat one of the two before: a window has at most two more distinct ones.
        fresh = np.ones(len(words), bool)
        fresh[1:] &= words[1:] != words[:-1]
        fresh[2:] &= words[2:] != words[:-2]
        known, varied = np.zeros(len(words) + 1, np.int32), np.zeros(len(words) + 1, np.int32)
        places, kinds = [], []
        left = np.arange(len(self.lengths))
        while len(left):
            # Lengths within a quarter of one another go together first, by their common mask.
            group = left[self.lengths[left] <= self.lengths[left[0]] * 5 // 4]
            left = left[len(group) :]
            low, slack = int(self.lengths[group[0]]), int(self.allowed(self.lengths[group]).max())
            own = (mask & np.bitwise_or.reduce(_U(1) << (group % 64).astype(np.uint64))) != 0
            np.cumsum(own, out=known[1:], dtype=np.int32)
            near = np.flatnonzero(known[low:] - known[:-low] >= low - slack)
            np.cumsum(own & fresh, out=varied[1:], dtype=np.int32)
            for kind in group if len(near) else ():
                n = int(self.lengths[kind])
                k = int(self.allowed(self.lengths[kind]))
                fit = near[(near + n - k <= ends[near]) & (near + n <= len(words))]
                fit = fit[varied[fit + n] - varied[fit] >= self.fewest[kind] - k - 2]
                bit = _U(kind % 64)
                fit = np.concatenate([f[((mask[f[:, None] + np.arange(n)] >> bit) & _U(1)).sum(axis=1) >= n - k] for f in np.array_split(fit, 1 + len(fit) // 20_000)])
                places.append(fit)
                kinds.append(np.full(len(fit), kind))
        place, kind = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, kinds))
        seen: set[tuple[int, int]] = set()
        for rep in range(len(self.tables) if len(place) else 0):
            keys, items = self.tables[rep]
            got = self.walk(words, place, kind, rep, ends[place])
            lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            for j in np.flatnonzero(hi > lo):
                seen.update((int(place[j]), int(i)) for i in items[lo[j] : hi[j]])
        for start, i in sorted(seen):
            n, k = int(self.n[i]), int(self.k[i])
            d, taken = edits(self.words[self.at[i] : self.at[i + 1]], words[start : min(start + n + k, int(ends[start]))], k)
            if d <= k:
                pair = (int(text[start]), i)
                best[pair] = min(best.get(pair, (k + 1, 0, 0)), (d, start - int(at[text[start]]), taken))
        return [(t, i, place, taken, d) for (t, i), (d, place, taken) in sorted(best.items())]


def build_index(items: DataFrame, id_col: str, text_col: str, max_edits: float, recall: float, samples: int, min_words: int, seed: int, exact_below: int = 8) -> Index:
    """Read the items, ITEM_CHARS characters or so, and repeat walks until the recall is reached, or fail."""
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(id_col).isNotNull()).collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    words, at = plain_words([r[1] for r in rows])
    keep = np.diff(at) >= max(1, min_words)
    own = [words[at[i] : at[i + 1]] for i in np.flatnonzero(keep)]
    at = np.cumsum([0, *map(len, own)])
    words = np.concatenate(own) if own else np.empty(0, np.uint64)
    ids = np.array([r[0] for r, k in zip(rows, keep, strict=True) if k], np.int64)
    index = Index(ids, words, at, max_edits, samples, seed, exact_below)
    reached = index.reach(recall, MOST_REPS)
    if reached < recall:
        raise ValueError(f"{MOST_REPS} repetitions find {reached:.3f} of edited items, not {recall}; take fewer samples or edits")
    return index


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edits: float = 0.15, recall: float = 0.98, samples: int = 3, min_words: int = 1, seed: int = 1, exact_below: int = 8) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits) of each document and item found in it, by its best run of words.

    first_word counts the document's words from 0; of equally good runs it is the
    first, of n_words words. Items of fewer than exact_below words are found where they
    stand word for word, longer ones within floor(max_edits * words) edits; items of fewer than
    min_words words are not searched. Null and empty texts hold nothing. Rows
    with a null id are reported with it; repeated rows are reported once each. Without
    items nothing is contaminated; items with a null id are left out. Columns but the named
    ones are not read.
    """
    read, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for index in _indices(items, item_col, item_text_col, max_edits, recall, samples, min_words, seed, exact_below):
        found = read.mapInArrow(_searched(index), "doc_id long, item_id long, first_word long, n_words long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edits: float = 0.15, recall: float = 0.98, samples: int = 3, min_words: int = 1, seed: int = 1, exact_below: int = 8) -> DataFrame:
    """The rows of docs that hold no item, each judged by itself, whatever its id; all columns are passed on. Bounds are those of contaminated()."""
    at = docs.columns.index(text_col)
    for index in _indices(items, item_col, item_text_col, max_edits, recall, samples, min_words, seed, exact_below):
        docs = docs.mapInArrow(_cleaned(index, at), docs.schema)
    return docs


def _indices(items: DataFrame, item_col: str, item_text_col: str, *bounds) -> Iterator[Broadcast]:
    """One index for each part of the items, sent to all executors."""
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    total = items.select(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // ITEM_CHARS))
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else items
        yield items.sparkSession.sparkContext.broadcast(build_index(some, "item_id", "text", *bounds))


def _cleaned(index, at: int):
    def run(batches):
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for lo, _, texts in text_chunks(batch.column(at)):
                stay[[lo + t for t, *_ in index.value.matches(*plain_words(texts))]] = False
            yield batch.filter(pa.array(stay))

    return thrifty(run)


def _searched(index):
    def run(batches):
        own = index.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, texts in text_chunks(batch.column(1)):
                found = own.matches(*plain_words(texts))
                if found:
                    t, i, place, taken, d = map(list, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[lo + x] for x in t], pa.int64()), pa.array(own.ids[i]), *(pa.array(x, pa.int64()) for x in (place, taken, d))], ["doc_id", "item_id", "first_word", "n_words", "edits"])

    return thrifty(run)
