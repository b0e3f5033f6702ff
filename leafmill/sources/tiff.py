"""TIFF files as pages of pixels, and back: all images of a file, in strips or tiles, of 1 to 64 bits a sample.

Compression is none, fax (T.4 and T.6), PackBits, LZW or Deflate; others (JPEG) are reported as errors.
Files can be read by ranges, so that one image of many costs what it takes itself. What
is not a whole number of up to 8 bits is spread over 0 to 255: from the least to the largest
sample value that the file names or holds, or from 0 to 1 where all floats lie there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafmill.sources import fax

#: Numbers of the format.
NONE, FAX_RUNS, FAX3, FAX4, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 2, 3, 4, 5, 8, 32946, 32773
WHITE_IS_ZERO, BLACK_IS_ZERO, RGB, PALETTE = 0, 1, 2, 3
UNSIGNED, SIGNED, FLOAT = 1, 2, 3
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: Pixels a page may have; beyond it a file counts as damaged.
MAX_PIXELS, MAX_SIDE = 600_000_000, 32_767


@dataclass
class Page:
    """One image of a file: gray (height, width) or colour (height, width, 3) bytes, and its resolution."""

    pixels: np.ndarray
    dpi: tuple[float, float] = (0.0, 0.0)
    bitonal: bool = False


#: read(at, size) gives those bytes of a file, or fewer at its end.
Read = Callable[[int, int], bytes]


def reader(data: bytes | Read) -> Read:
    return data if callable(data) else lambda at, size: data[at : at + size]


def directories(data: bytes | Read) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image; what a tag says is read, the image is not."""
    read = reader(data)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(read(0, 4))
    if order is None:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", read(4, 4))[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(order + "H", read(at, 2))
        entries, tags = read(at + 2, 12 * n + 4), {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * i)
            if kind not in KINDS:
                continue
            form = f"{order}{KINDS[kind] * count}" if kind in (5, 10) else f"{order}{count}{KINDS[kind]}"
            size = struct.calcsize(form)
            value = entries[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else read(struct.unpack_from(order + "I", entries, 12 * i + 8)[0], size)
            if len(value) == size:
                tags[tag] = struct.unpack(form, value)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", entries, 12 * n)


def count(data: bytes | Read) -> int:
    """Images of a file."""
    return sum(1 for _ in directories(data))


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    """Runs of three and more equal bytes as runs, all else as it is."""
    out, at, plain = bytearray(), 0, bytearray()

    def flush() -> None:
        for i in range(0, len(plain), 128):
            out.append(len(plain[i : i + 128]) - 1)
            out.extend(plain[i : i + 128])
        plain.clear()

    while at < len(row):
        run = 1
        while run < 128 and at + run < len(row) and row[at + run] == row[at]:
            run += 1
        if run >= 3:
            flush()
            out += bytes((257 - run, row[at]))
        else:
            plain += row[at : at + run]
        at += run
    flush()
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    table: list[bytes] = []
    out, last, width, held, bits = bytearray(), b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, last, width = [bytes((i,)) for i in range(256)] + [b"", b""], b"", 9
            continue
        if code == 257:
            break
        if not table or code > len(table):
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def expand(data: bytes, compression: int, rows: int = 0, width: int = 0, options: int = 0) -> bytes:
    """The bytes of a block; rows, width and T4Options are for fax."""
    if compression == NONE:
        return data
    if compression in (FAX_RUNS, FAX3, FAX4):
        return np.packbits(fax.decode(data, rows, width, compression, options), axis=1).tobytes()
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data)
    raise ValueError(f"compression {compression} is not read")


def samples(raw: bytes, rows: int, per_row: int, bits: int, form: int, order: str) -> np.ndarray:
    """rows by per_row samples; rows begin at whole bytes, and missing data is 0."""
    row_bytes = (per_row * bits + 7) // 8
    flat = np.zeros(rows * row_bytes, np.uint8)
    given = np.frombuffer(raw[: rows * row_bytes], np.uint8)
    flat[: len(given)] = given
    table = flat.reshape(rows, row_bytes)
    if bits in (8, 16, 32, 64):
        kind = {UNSIGNED: "u", SIGNED: "i", FLOAT: "f"}.get(form)
        if kind is None or (kind == "f" and bits == 8):
            raise ValueError(f"{bits} bits of sample format {form} are not read")
        return np.ascontiguousarray(table).view(np.dtype(f"{order}{kind}{bits // 8}"))
    if form != UNSIGNED or bits > 32:
        raise ValueError(f"{bits} bits of sample format {form} are not read")
    ones = np.unpackbits(table, axis=1)[:, : per_row * bits].reshape(rows, per_row, bits)
    return ones.astype(np.uint64) @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))


def to_bytes(values: np.ndarray, bits: int, form: int, invert: bool, named: tuple[float, float] | None) -> np.ndarray:
    """Samples spread over 0 to 255."""
    if form == UNSIGNED and bits <= 8:
        out = (values.astype(np.int64) * 255 + ((1 << bits) - 1) // 2) // ((1 << bits) - 1)
        return (255 - out if invert else out).astype(np.uint8)
    x = values.astype(float)
    finite = x[np.isfinite(x)]
    low, high = named or ((float(finite.min()), float(finite.max())) if len(finite) else (0.0, 1.0))
    if named is None and form == FLOAT and 0 <= low and high <= 1:
        low, high = 0.0, 1.0
    if not high > low:
        high = low + 1
    x = np.clip(np.where(np.isnan(x), low, x), low, high)
    out = np.floor((x - low) * (255 / (high - low)) + 0.5)
    return (255 - out if invert else out).astype(np.uint8)


def decode(data: bytes | Read, first: int = 0, stop: int | None = None) -> list[Page]:
    """All images of a file, or those from first to before stop."""
    return list(each(data, first, stop))


def each(data: bytes | Read, first: int = 0, stop: int | None = None) -> Iterator[Page]:
    """decode's images one by one."""
    read = reader(data)
    for number, (order, tags) in enumerate(directories(read)):
        if number < first or (stop is not None and number >= stop):
            continue
        one = lambda tag, usual: tags.get(tag, (usual,))[0]  # noqa: B023, E731
        width, height, bits, form = one(256, 0), one(257, 0), one(258, 1), one(339, UNSIGNED)
        if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and width * height <= MAX_PIXELS):
            raise ValueError("size out of range")
        channels, planar, predictor, photometric = one(277, 1), one(284, 1), one(317, 1), one(262, BLACK_IS_ZERO)
        tiled = 322 in tags
        block_w, block_h = (one(322, width), one(323, height)) if tiled else (width, min(one(278, height) or height, height))
        places, sizes = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
        if not places or not sizes or block_w <= 0 or block_h <= 0:
            raise ValueError("no image data")
        if one(259, NONE) in (FAX_RUNS, FAX3, FAX4) and (bits, channels) != (1, 1):
            raise ValueError("fax coding is for one bit a pixel")
        planes, per_pixel = (channels, 1) if planar == 2 else (1, channels)
        across, down = -(-width // block_w), -(-height // block_h)
        page = None
        for i, (at, size) in enumerate(zip(places, sizes, strict=False)):
            plane, j = divmod(i, across * down)
            if plane >= planes:
                break
            top, left = j // across * block_h, j % across * block_w
            rows = block_h if tiled else min(block_h, height - top)
            raw = read(at, size)
            if one(266, 1) == 2:  # low bits first
                raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tobytes()
            block = samples(expand(raw, one(259, NONE), rows, block_w, one(292, 0)), rows, block_w * per_pixel, bits, form, order).reshape(rows, block_w, per_pixel)
            if predictor == 2 and form != FLOAT:
                block = np.cumsum(block, axis=1, dtype=block.dtype) & block.dtype.type((1 << bits) - 1 if form == UNSIGNED else -1)
            if page is None:
                page = np.zeros((height, width, channels), block.dtype)
            cut = block[: height - top, : width - left]
            page[top : top + cut.shape[0], left : left + cut.shape[1], plane : plane + cut.shape[2]] = cut
        if photometric == PALETTE:
            table = np.array(tags[320], np.int64).reshape(3, -1).T >> 8
            pixels = table[np.minimum(page[:, :, 0].astype(np.int64), len(table) - 1)].astype(np.uint8)
        else:
            named = (float(one(340, 0)), float(one(341, 0))) if 340 in tags and 341 in tags else None
            used = page[:, :, :3] if photometric == RGB and channels >= 3 else page[:, :, 0]
            pixels = to_bytes(used, bits, form, photometric == WHITE_IS_ZERO, named if named and named[1] > named[0] else None)
        scale = {2: 1.0, 3: 2.54}.get(one(296, 2), 0.0)
        dpi = tuple(tags[t][0] / tags[t][1] * scale if t in tags and tags[t][1] else 0.0 for t in (282, 283))
        yield Page(pixels, dpi, bits == 1 and channels == 1)


def body(page: Page, fax4: bool = False) -> tuple[bytes, int, int, int, int]:
    """An image's bytes, their compression, bits a sample, photometric and predictor: bitonal as PackBits or fax, gray and colour as Deflate with differences along rows."""
    height, width = page.pixels.shape[:2]
    if page.bitonal:
        ink = page.pixels < 128
        if fax4:
            return fax.encode(ink), FAX4, 1, WHITE_IS_ZERO, 1
        return b"".join(pack_bits(r.tobytes()) for r in np.packbits(ink, axis=1)), PACKBITS, 1, WHITE_IS_ZERO, 1
    flat = page.pixels.reshape(height, width, -1).astype(np.uint8)
    steps = np.concatenate((flat[:, :1], flat[:, 1:] - flat[:, :-1]), axis=1)
    return zlib.compress(steps.tobytes()), DEFLATE, 8, RGB if flat.shape[2] == 3 else BLACK_IS_ZERO, 2


class File:
    """A file written image by image, without going back: the tags of an image come before it, and the last image is held until it is known whether another follows."""

    def __init__(self, write: Callable[[bytes], object]):
        self.write, self.at, self.held = write, 8, b""
        write(b"II*\0\x08\0\0\0")

    def add(self, width: int, height: int, channels: int, dpi: tuple[float, float], data: bytes, compression: int, bits: int, photometric: int, predictor: int) -> None:
        self._put(more=True)
        tags_size = 2 + 12 * 13 + 4
        extra = self.at + tags_size
        place = extra + 24
        tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, channels, bits if channels == 1 else extra + 16), (259, 3, 1, compression), (262, 3, 1, photometric), (273, 4, 1, place), (277, 3, 1, channels), (278, 4, 1, height), (279, 4, 1, len(data)), (282, 5, 1, extra), (283, 5, 1, extra + 8), (296, 3, 1, 2), (317, 3, 1, predictor)]
        head = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        tail = struct.pack("<IIII", round(dpi[0] * 1000), 1000, round(dpi[1] * 1000), 1000) + struct.pack("<HHH", bits, bits, bits) + b"\0\0" + data + b"\0" * (len(data) % 2)
        self.held = (head, tail)
        self.at += tags_size + len(tail)

    def _put(self, more: bool) -> None:
        if self.held:
            head, tail = self.held
            if self.at >= 1 << 32:
                raise ValueError("a TIFF file can't be longer than 4 GB")
            self.write(head + struct.pack("<I", self.at if more else 0))
            self.write(tail)
            self.held = b""

    def finish(self) -> None:
        self._put(more=False)


def encode(pages: list[Page], fax4: bool = False) -> bytes:
    """A file of those images."""
    out = bytearray()
    file = File(out.extend)
    for page in pages:
        height, width = page.pixels.shape[:2]
        file.add(width, height, page.pixels.shape[2] if page.pixels.ndim == 3 else 1, page.dpi, *body(page, fax4))
    file.finish()
    return bytes(out)


def decode_png(data: bytes) -> list[Page]:
    """The image of a PNG file, without interlacing; transparency is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, palette, dpi = 8, b"", None, (0.0, 0.0)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if interlaced or not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and width * height <= MAX_PIXELS):
                raise ValueError("interlaced, or size out of range")
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"pHYs" and part[8] == 1:
            dpi = tuple(v * 0.0254 for v in struct.unpack(">II", part[:8]))
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, row_bytes = max(1, channels * bits // 8), (width * channels * bits + 7) // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, row_bytes + 1)
    rows, above = np.zeros((height, row_bytes), np.uint8), np.zeros(row_bytes, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step]) & 255
        elif kind in (3, 4):
            for x in range(row_bytes):
                left, corner = (line[x - step], above[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    near = [(abs(above[x] - corner), 0, left), (abs(left - corner), 1, above[x]), (abs(left + above[x] - 2 * corner), 2, corner)]
                    guess = min(near)[2]
                line[x] = (line[x] + guess) & 255
        rows[y], above = line, line
    values = samples(rows.tobytes(), height, width * channels, bits, UNSIGNED, ">").reshape(height, width, channels)
    if colour == 3:
        return [Page(palette[np.minimum(values[:, :, 0].astype(int), len(palette) - 1)], dpi)]
    used = values[:, :, :3] if colour in (2, 6) else values[:, :, 0]
    return [Page((used >> 8).astype(np.uint8) if bits == 16 else to_bytes(used, bits, UNSIGNED, False, None), dpi, bits == 1)]


def decoded(data: bytes, least: int = 0) -> list[Page]:
    """Images of a file by what its first bytes are; reduced by whole factors as long as the shorter side stays at least `least` (0: not reduced)."""
    return list(reduced(decode_png(data) if data.startswith(b"\x89PNG") else each(data), least))


def reduced(pages: Iterable[Page], least: int) -> Iterator[Page]:
    for page in pages:
        k = min(page.pixels.shape[:2]) // least if least else 1
        if k > 1:
            h, w = (n // k * k for n in page.pixels.shape[:2])
            cut = page.pixels[:h, :w].astype(float).reshape(h // k, k, w // k, k, -1).mean(axis=(1, 3))
            page.pixels, page.bitonal = np.floor(cut + 0.5).astype(np.uint8).reshape(h // k, w // k, *page.pixels.shape[2:]), False
            page.dpi = tuple(d / k for d in page.dpi)
        yield page


#: What a damaged file can raise.
DAMAGED = (ValueError, struct.error, IndexError, KeyError, UnboundLocalError, zlib.error)
SCHEMA = "path string, page int, height int, width int, channels int, dpi_x double, dpi_y double, pixels array<int>, error string"


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = [pa.string(), *[pa.int32()] * 4, pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.string()]


def row_of(path: str, number: int, page: Page) -> pa.RecordBatch:
    """A page as a batch of its own: it may be large."""
    row = (path, number, *page.pixels.shape[:2], page.pixels.shape[2] if page.pixels.ndim == 3 else 1, *page.dpi, page.pixels.ravel().astype(np.int32), None)
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, _KINDS, strict=True)], NAMES)


def error_of(path: str, number: int | None, error: Exception) -> pa.RecordBatch:
    row = (path, number, None, None, None, None, None, None, str(error) or type(error).__name__)
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, _KINDS, strict=True)], NAMES)


def read_pages(spark: SparkSession, path: str, glob: str = "*", least: int = 0) -> DataFrame:
    """A row for each image of the files under a path, its pixels row by row; a damaged file is one row with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [row_of(name, i, p) for i, p in enumerate(decoded(data.as_py(), least))]
                except DAMAGED as e:
                    rows = [error_of(name, None, e)]
                yield from rows

    return files.mapInArrow(run, SCHEMA)


def encoded(pages: DataFrame) -> DataFrame:
    """(page_id, tiff) of gray pages (page_id, height, width, pixels, bitonal, dpi), one file a page."""
    key = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                pixels = np.array(row["pixels"], np.uint8).reshape(row["height"], row["width"])
                made.append(encode([Page(pixels, (row["dpi"], row["dpi"]), row["bitonal"])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "tiff"])

    return pages.select("page_id", "height", "width", "pixels", "bitonal", "dpi").mapInArrow(run, f"page_id {key}, tiff binary")
