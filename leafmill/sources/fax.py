"""Fax coding of bitonal pages (ITU-T T.4 and T.6), both ways.

A row is told by where its colour changes, either as lengths of runs or, in two
dimensions, as shifts against the changes of the row above. In T.6 all rows are coded in two
dimensions, and a row's code depends on itself and the row above alone: so all
rows of a page are coded side by side, one mode each a step. Decoding has to follow the
bits; it looks them up 13 at a time.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Codes of the standard. White runs of 0 to 63, then of 64, 128, ... 1728.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 "
    "101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 "
    "00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 "
    "00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 "
    "011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
#: Black runs of the same lengths.
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 "
    "0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 "
    "000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 "
    "0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
#: Runs of either colour of 1792, 1856, ... 2560.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: The modes pass and horizontal, and the shifts -3 to 3.
PASS, HORIZONTAL = "0001", "001"
SHIFTS = "0000010 000010 010 1 011 000011 0000011".split()
END_OF_LINE = "000000000001"

LENGTHS = [*range(64), *range(64, 1729, 64), *range(1792, 2561, 64)]
_RUNS = [dict(zip(LENGTHS, codes + LONG, strict=True)) for codes in (WHITE, BLACK)]
_PASS, _HORIZONTAL, _END = 100, 101, 102
_MODES = {_PASS: PASS, _HORIZONTAL: HORIZONTAL, **dict(zip(range(-3, 4), SHIFTS, strict=True)), _END: "0000000"}
BITS = 13


def _looked_up(codes: dict[int, str], bits: int) -> list[tuple[int, int] | None]:
    """(value, length) of the code that the next bits begin with."""
    table: list[tuple[int, int] | None] = [None] * (1 << bits)
    for value, code in codes.items():
        first = int(code, 2) << (bits - len(code))
        table[first : first + (1 << (bits - len(code)))] = [(value, len(code))] * (1 << (bits - len(code)))
    return table


_RUN_TABLES = [_looked_up(r, BITS) for r in _RUNS]
_MODE_TABLE = _looked_up(_MODES, 7)


def _bits(code: str) -> tuple[int, int]:
    return int(code, 2), len(code)


# Terminating codes and codes of whole multiples of 64, as (value, bits), by colour.
_LAST = np.array([[_bits(r[n]) for n in range(64)] for r in _RUNS])
_MANY = np.array([[(0, 0), *(_bits(r[n]) for n in range(64, 2561, 64))] for r in _RUNS])


def next_changes(page: np.ndarray) -> np.ndarray:
    """[y, x]: the first place from x on at which row y changes colour, or the width; x runs to the width + 1. Rows begin white."""
    height, width = page.shape
    out = np.full((height, width + 2), width, np.int32)
    before = np.zeros((height, 1), page.dtype)
    changes = page != np.concatenate((before, page[:, :-1]), axis=1)
    out[:, :width] = np.where(changes, np.arange(width, dtype=np.int32), width)
    out[:, width::-1] = np.minimum.accumulate(out[:, width::-1], axis=1)
    return out


class _Codes:
    """Codes of rows, given in any order and put together in the order of (row, step)."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.step = 0

    def put(self, rows: np.ndarray, value: np.ndarray | int, bits: np.ndarray | int) -> None:
        if len(rows):
            fill = lambda x: np.broadcast_to(np.asarray(x, np.int64), len(rows))
            self.parts.append((rows, np.full(len(rows), self.step), fill(value), fill(bits)))
        self.step += 1

    def run(self, rows: np.ndarray, length: np.ndarray, colour: np.ndarray) -> None:
        most = int(length.max(initial=0))
        for _ in range(max(0, most - 63) // 2560):  # a run of 2624 and more begins with codes of 2560
            far = length >= 2624
            self.put(rows[far], *_bits(LONG[-1]))
            length = np.where(far, length - 2560, length)
        many = _MANY[colour, length // 64]
        some = length >= 64
        self.put(rows[some], many[some, 0], many[some, 1])
        last = _LAST[colour, length % 64]
        self.put(rows, last[:, 0], last[:, 1])

    def packed(self, end: str) -> bytes:
        if self.parts:
            row, step, value, bits = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            order = np.lexsort((step, row))
            value, bits = value[order], bits[order]
            stop = np.cumsum(bits)
            code = np.repeat(np.arange(len(bits)), bits)
            flags = value[code] >> (stop[code] - 1 - np.arange(len(code))) & 1
        else:
            flags = np.empty(0, np.int64)
        return np.packbits(np.concatenate((flags, [int(b) for b in end])).astype(np.uint8)).tobytes()


class _Sizes(_Codes):
    """Bits of each row's codes, without the codes."""

    def __init__(self, height: int) -> None:
        super().__init__()
        self.bits = np.zeros(height, np.int64)

    def put(self, rows: np.ndarray, value: np.ndarray | int, bits: np.ndarray | int) -> None:
        self.bits[rows] += bits  # a row comes once a step


def _code(page: np.ndarray, begins: np.ndarray, codes: _Codes) -> None:
    """Put the codes of pages one below the other, whose first rows begin."""
    height, width = page.shape
    own = next_changes(page)
    above = np.concatenate((np.full((1, width + 2), width, np.int32), own[:-1]))
    above[begins] = width
    wide = np.concatenate((page, np.zeros((height, 1), np.uint8)), axis=1)
    tone = np.concatenate((np.zeros((1, width + 1), np.uint8), wide[:-1]))
    tone[begins] = 0
    shifts = np.array([_bits(s) for s in SHIFTS])
    rows, a0, colour = np.arange(height), np.full(height, -1), np.zeros(height, np.int64)
    while len(rows):
        a1 = own[rows, a0 + 1]
        b1 = above[rows, a0 + 1]
        wrong = (b1 < width) & (tone[rows, b1] == colour)  # a change to the colour that the row has
        b1 = np.where(wrong, above[rows, np.minimum(b1 + 1, width + 1)], b1)
        b2 = above[rows, np.minimum(b1 + 1, width + 1)]
        passing, shift = b2 < a1, a1 - b1
        near = ~passing & (np.abs(shift) <= 3)
        far = ~passing & ~near
        mode = shifts[np.clip(shift, -3, 3) + 3]
        value, bits = (np.where(passing, p, np.where(near, mode[:, i], h)) for i, (p, h) in enumerate(zip(_bits(PASS), _bits(HORIZONTAL), strict=True)))
        codes.put(rows, value, bits)
        a2 = own[rows, np.minimum(a1 + 1, width + 1)]
        codes.run(rows[far], (a1 - np.maximum(a0, 0))[far], colour[far])
        codes.run(rows[far], (a2 - a1)[far], 1 - colour[far])
        colour = np.where(near, 1 - colour, colour)
        a0 = np.where(passing, b2, np.where(near, a1, a2))
        left = a0 < width
        rows, a0, colour = rows[left], a0[left], colour[left]


def encode(page: np.ndarray) -> bytes:
    """A page of 0 and 1, where 1 is black, by T.6 (compression 4 of TIFF, K -1 of PDF)."""
    page = np.asarray(page).astype(np.uint8)
    codes = _Codes()
    if page.size:
        _code(page, np.arange(len(page)) == 0, codes)
    return codes.packed(END_OF_LINE * 2)


def encoded_sizes(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Bytes that encode gives for each of several pages of one width, one below the other; begins: their first rows."""
    codes = _Sizes(len(rows))
    _code(np.asarray(rows).astype(np.uint8), begins, codes)
    return (np.add.reduceat(codes.bits, np.flatnonzero(begins)) + 2 * len(END_OF_LINE) + 7) // 8


class _Bits:
    """The next 13 bits from each place on; beyond the end there are zeros."""

    def __init__(self, data: bytes):
        flags = np.unpackbits(np.frombuffer(data, np.uint8)).astype(np.uint16)
        self.size = len(flags)
        flags = np.concatenate((flags, np.zeros(2 * BITS, np.uint16)))
        ahead = np.zeros(self.size + BITS, np.uint16)
        for i in range(BITS):
            ahead <<= 1
            ahead |= flags[i : i + self.size + BITS]
        self.ahead = array("H", ahead.tobytes())
        self.ones = np.flatnonzero(flags)

    def run(self, at: int, colour: int) -> tuple[int, int]:
        """Length of a run, and the place behind its codes."""
        total, table = 0, _RUN_TABLES[colour]
        while True:
            found = table[self.ahead[at]] if at < self.size else None
            if found is None:
                raise ValueError("broken fax data")
            total, at = total + found[0], at + found[1]
            if found[0] < 64:
                return total, at

    def more(self, at: int) -> bool:
        return bool(len(self.ones) and self.ones[-1] >= at)

    def past_end_of_line(self, at: int) -> int | None:
        """The place behind an end of line, if eleven zeros or more and a one come next."""
        i = int(np.searchsorted(self.ones, at))
        return int(self.ones[i]) + 1 if i < len(self.ones) and self.ones[i] - at >= 11 else None


def _run_row(bits: _Bits, at: int, width: int) -> tuple[list[int], int]:
    """Changes of a row that is coded by its runs."""
    changes, x, colour = [], 0, 0
    while x < width:
        length, at = bits.run(at, colour)
        x += length
        _change(changes, min(x, width), width)
        colour ^= 1
    return changes, at


def _change(changes: list[int], x: int, width: int) -> None:
    if changes and changes[-1] == x:
        changes.pop()  # a run of no length
    elif x < width:
        changes.append(x)


def _shifted_row(bits: _Bits, at: int, width: int, above: list[int]) -> tuple[list[int] | None, int]:
    """Changes of a row that is coded against the row above; None at the end of the data."""
    ref, ahead, modes, size = [*above, width, width, width, width], bits.ahead, _MODE_TABLE, bits.size
    changes: list[int] = []
    a0, colour, i = -1, 0, 0
    while a0 < width:
        if at >= size:
            return None, at
        found = modes[ahead[at] >> 6]
        if found is None:
            raise ValueError("broken fax data")
        mode, length = found
        if mode == _END:
            if bits.more(at) and bits.past_end_of_line(at) is None:
                raise ValueError("broken fax data")
            return None, at
        at += length
        while i and ref[i - 1] > a0:  # a shift to the left can bring back a change that was passed
            i -= 1
        if i & 1 != colour:
            i += 1
        while ref[i] <= a0 and ref[i] < width:
            i += 2
        b1 = ref[i]
        if mode == _PASS:
            a0 = ref[i + 1]
        elif mode == _HORIZONTAL:
            one, at = bits.run(at, colour)
            two, at = bits.run(at, colour ^ 1)
            x = max(a0, 0) + one
            _change(changes, min(x, width), width)
            a0 = min(x + two, width)
            _change(changes, a0, width)
        else:
            if b1 + mode < max(a0, 0):
                raise ValueError("broken fax data")
            a0 = min(b1 + mode, width)
            _change(changes, a0, width)
            colour ^= 1
    return changes, at


def _painted(rows: list[list[int]], height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width + 1), np.uint8)
    y = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = np.fromiter((c for r in rows for c in r), np.int64, len(y))
    out[y, x] = 1
    return np.bitwise_xor.accumulate(out, axis=1)[:, :width]


def decode(data: bytes, height: int, width: int, compression: int = 4, options: int = 0) -> np.ndarray:
    """The page of 0 and 1, where 1 is black, of T.6 (compression 4), T.4 (3, with TIFF's T4Options) or T.4 without ends of lines (2).

    Rows that are missing at the end are white; broken codes are an error.
    """
    bits = _Bits(data)
    rows: list[list[int]] = []
    at, above = 0, []
    while len(rows) < height and at < bits.size:
        one_dimensional = compression != 4
        if compression == 3:
            behind = bits.past_end_of_line(at)
            if behind is not None:
                at = behind
                if options & 1 and at < bits.size:
                    one_dimensional, at = bool(bits.ahead[at] >> (BITS - 1)), at + 1
                if bits.past_end_of_line(at) == at + 12:  # one end of line after another: the page is over
                    break
            elif options & 1:
                raise ValueError("broken fax data: a row without an end of line")
        if one_dimensional:
            above, at = _run_row(bits, at, width)
        else:
            found, at = _shifted_row(bits, at, width, above)
            if found is None:
                break
            above = found
        if compression == 2:
            at = (at + 7) // 8 * 8
        rows.append(above)
    return _painted(rows, height, width)
