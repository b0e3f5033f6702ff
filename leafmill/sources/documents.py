"""Books of pages as files: plain text, hOCR, PDF and TIFF.

Pages are prepared in parallel, wherever they are. Then each book's pages meet in order in
one task, which writes them as they come and holds none of them; the files appear all at once, or not at all (see page_files).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmill.functions import text as tx
from leafmill.sources import fax, page_files, tiff


def _written(parts: DataFrame, path: str, kind: str, mode: str, **options: str) -> None:
    """Write prepared parts (book, position, ...) as one file a book."""
    page_files.register(parts.sparkSession)
    ordered = parts.repartition("book").sortWithinPartitions("book", "position")
    ordered.write.format(page_files.BOOKS).options(kind=kind, **options).mode(mode).save(path)


def write_text(pages: DataFrame, path: str, book: str, order: str, text: str, mode: str = "append") -> None:
    """One text file a book, its pages parted by form feeds; null texts are empty pages."""
    parts = pages.select(F.col(book).cast("string").alias("book"), F.col(order).alias("position"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    _written(parts, path, "txt", mode)


def write_hocr(docs: DataFrame, path: str, id_col: str, text_col: str, engine: str = "leafmill", mode: str = "append") -> None:
    """One hOCR file a document; a null text is an empty one."""
    pages = tx.hocr_pages(docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)), id_col, text_col).select(F.col(id_col).cast("string").alias("id"), "page")
    file = F.concat(tx.hocr_head(F.col("id"), engine), "page", F.lit("\n</body></html>"))
    _written(pages.select(F.col("id").alias("book"), F.lit(0).alias("position"), file.cast("binary").alias("data")), path, "hocr", mode)


def coded(width: int, height: int, rows: bytes, coding: str = "smaller") -> tuple[bytes, str]:
    """A bitonal image's bytes for PDF and how they are coded: fax, flate, or the smaller of the two."""
    if coding not in ("smaller", "fax", "flate"):
        raise ValueError("coding is smaller, fax or flate")
    found = []
    if coding != "flate":
        ink = np.unpackbits(np.frombuffer(rows, np.uint8).reshape(height, -1), axis=1)[:, :width]
        found.append((fax.encode(ink), "fax"))
    if coding != "fax":
        found.append((zlib.compress(rows), "flate"))
    return min(found, key=lambda f: len(f[0]))


class Pdf:
    """A PDF of bitonal pages, written page by page; only the objects' places are held."""

    def __init__(self, write: Callable[[bytes], object]):
        self.write, self.at, self.places, self.kids = write, 0, {}, []
        self._put(b"%PDF-1.4\n")
        self.count = 2  # the catalogue and the list of pages come last
        self.font = self._add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")

    def _put(self, data: bytes) -> None:
        self.write(data)
        self.at += len(data)

    def _add(self, body: bytes, number: int = 0) -> int:
        if not number:
            self.count += 1
            number = self.count
        self.places[number] = self.at
        self._put(b"%d 0 obj\n%s\nendobj\n" % (number, body))
        return number

    def add(self, width: int, height: int, data: bytes, coding: str, text: str) -> None:
        how = b"/Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns %d /Rows %d >>" % (width, height) if coding == "fax" else b"/Decode [1 0] /Filter /FlateDecode"
        image = self._add(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 1 %s /Length %d >>\nstream\n%s\nendstream" % (width, height, how, len(data), data))
        lines = text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").split(b"\n")
        words = b"".join(b"(%s) ' " % line for line in lines)
        stream = b"q %d 0 0 %d 0 0 cm /I Do Q BT 3 Tr /F 8 Tf 8 TL 0 %d Td %sET" % (width, height, height, words)
        content = self._add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
        self.kids.append(self._add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> /Font << /F %d 0 R >> >> >>" % (width, height, content, image, self.font)))

    def finish(self) -> None:
        self._add(b"<< /Type /Catalog /Pages 2 0 R >>", 1)
        self._add(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(self.kids), b" ".join(b"%d 0 R" % k for k in self.kids)), 2)
        start = self.at
        self._put(b"xref\n0 %d\n0000000000 65535 f \n" % (self.count + 1) + b"".join(b"%010d 00000 n \n" % self.places[i] for i in range(1, self.count + 1)))
        self._put(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (self.count + 1, start))


def pdf(pages: Iterable[tuple[int, int, bytes, str]], coding: str = "flate") -> bytes:
    """A PDF of bitonal pages (width, height, packed rows, text): 1 is black, text is there but not seen."""
    out = bytearray()
    file = Pdf(out.extend)
    for width, height, rows, text in pages:
        file.add(width, height, *coded(width, height, rows, coding), text or "")
    file.finish()
    return bytes(out)


def pdf_books(pages: DataFrame, book: str, order: str) -> DataFrame:
    """(book, pdf) from pages (book, order, width, height, rows, text), for books that fit a row; write_pdf has no such bound."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        made = pdf(zip(part["width"], part["height"], part["rows"], part["text"], strict=True))
        return pd.DataFrame({book: [part[book].iloc[0]], "pdf": [made]})

    return pages.groupBy(book).applyInPandas(run, f"{book} {pages.schema[book].dataType.simpleString()}, pdf binary")


_PREPARED = "book string, position long, width int, height int, data binary, coding string, text string"


def write_pdf(pages: DataFrame, path: str, book: str = "book", order: str = "position", coding: str = "smaller", mode: str = "append") -> None:
    """One PDF a book, of bitonal pages (book, order, width, height, rows, text); rows are packed bits, 1 is black."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, at, width, height, rows, text = (c[i].as_py() for c in batch.columns)
                row = (name, at, width, height, *coded(width, height, rows, coding), text or "")
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _TYPES, strict=True)], _NAMES)

    read = pages.select(F.col(book).cast("string"), F.col(order).cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "rows", "text")
    _written(read.mapInArrow(run, _PREPARED), path, "pdf", mode)


_NAMES = [c.split()[0] for c in _PREPARED.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in _PREPARED.split(", ")]
_IMAGES = "book string, position long, width int, height int, channels int, dpi_x double, dpi_y double, data binary, compression int, bits int, photometric int, predictor int"


def write_tiff(pages: DataFrame, path: str, book: str = "book", order: str = "position", mode: str = "append") -> None:
    """One TIFF file a book, of pages (book, order, height, width, channels, dpi_x, dpi_y, pixels, bitonal): bitonal ones as fax, others as Deflate."""
    names = [c.split()[0] for c in _IMAGES.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]] for c in _IMAGES.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, at, height, width, channels, dpi_x, dpi_y, bitonal = (c[i].as_py() for c in batch.columns[:8])
                pixels = np.asarray(batch.column(8)[i].values).astype(np.uint8).reshape((height, width) if channels == 1 else (height, width, channels))
                row = (name, at, width, height, channels, dpi_x, dpi_y, *tiff.body(tiff.Page(pixels, (dpi_x, dpi_y), bool(bitonal)), fax4=True))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    sizes = [F.col(c).cast("int") for c in ("height", "width", "channels")] + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("dpi_x", "dpi_y")]
    read = pages.select(F.col(book).cast("string"), F.col(order).cast("long"), *sizes, "bitonal", F.col("pixels").cast("array<int>"))
    _written(read.mapInArrow(run, _IMAGES), path, "tif", mode)
