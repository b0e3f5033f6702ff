"""Word and shingle hashes of whole texts, computed on byte arrays with numpy.

A word is a maximal run of characters other than space and U+0009 to U+000D. Words
hash by value alone, so hashes agree between texts, batches and machines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed together; longer texts are cut at white space.
BLOCK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def thrifty(run: Callable) -> Callable:
    """run(batches), after which what Arrow holds free goes back to the machine: workers stay alive between tasks, beside the next stage."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def running(values: np.ndarray) -> np.ndarray:
    """Sums modulo 2 ** 64 of the first 0, 1, 2, ... values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:], dtype=np.uint64)
    return out


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i from 0 to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, _U(base))
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _blocks(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > BLOCK:
        piece = data[at : at + BLOCK]
        cut = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) + 1
        while not cut:  # one word longer than a block
            piece = data[at : at + 2 * len(piece)]
            cut = len(piece) if at + len(piece) >= len(data) else max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) + 1
        yield data[at : at + cut]
        at += cut
    yield data[at:]


def _hash_block(data: bytes, fold: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    if fold is not None:
        raw = fold[raw]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64), begin
    up, down = powers(len(raw))
    sums = running(_BYTE[raw] * up[: len(raw)])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


#: Tables from byte to byte, applied before words are cut out.
LOWER = _LOWER
PLAIN = _LOWER.copy()  # ASCII punctuation parts words, too
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def word_hashes(texts: list[str | None], fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text begins among them (one more entry than texts)."""
    found, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    first = size = 0

    def flush() -> None:
        nonlocal group, first, size
        if group:
            joined = b"\n".join(group)
            hashes, begin = _hash_block(joined, fold)
            found.append(hashes)
            starts = np.cumsum([0, *(len(g) + 1 for g in group)])
            counts[first : first + len(group)] = np.diff(np.searchsorted(begin, starts))
        first, group, size = first + len(group), [], 0

    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if len(data) > BLOCK:
            flush()
            parts = [_hash_block(b, fold)[0] for b in _blocks(data)]
            found.extend(parts)
            counts[first] = sum(map(len, parts))
            first += 1
            continue
        if size + len(data) >= BLOCK:
            flush()
        group.append(data)
        size += len(data) + 1
    flush()
    return np.concatenate(found) if found else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by the place of its first word; runs over a text's end are for the caller to drop."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out * _U(0xBF58476D1CE4E5B9) + words[i : i + count] + _U(i + 1))
    return out


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted, one text after the other, and where each begins.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, at = word_hashes(texts)
    sizes = np.diff(at)
    runs = ngram_hashes(words, n)
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - n + 1, 0))
    local = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(sizes - n + 1, 0)) - np.maximum(sizes - n + 1, 0), np.maximum(sizes - n + 1, 0))
    values = runs[at[:-1][owner] + local] if len(owner) else np.empty(0, np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        extra = []
        for i in short:
            own = words[at[i] : at[i + 1]]
            extra.append(ngram_hashes(own, len(own))[0] ^ _U(len(own)))
        owner, values = np.concatenate((owner, short)), np.concatenate((values, np.array(extra, np.uint64)))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    if len(values):
        keep = np.concatenate(([True], (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])))
        owner, values = owner[keep], values[keep]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def chunks(texts: list[str | None], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters at most, so that arrays over them stay small."""
    yield from _ranges([len(t or "") for t in texts], limit)


def text_chunks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """The same of an Arrow column, by bytes, with the texts of each range: no more of a batch is held as Python's strings."""
    for lo, hi in _ranges(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()


def _ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, n in enumerate(sizes):
        if size and size + n >= limit:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(sizes):
        yield first, len(sizes)
