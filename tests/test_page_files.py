"""Fax coding, page files and books, written and read back."""

import itertools
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.plans import page_queries
from leafmill.sources import documents, fax, page_files, tiff


def one_by_one(page):
    """T.6 by the flow of the standard, pixel by pixel, as bits."""
    shifts = dict(zip(range(-3, 4), fax.SHIFTS, strict=True))
    width = page.shape[1]

    def change(row, at, before):
        while at < width and row[at] == before:
            at += 1
        return at

    def run(length, colour):
        out = ""
        while length >= 64:
            part = min(length // 64 * 64, 2560)
            out, length = out + fax._RUNS[colour][part], length - part
        return out + fax._RUNS[colour][length]

    bits, above = "", np.zeros(width, int)
    for row in page:
        a0, colour = -1, 0
        while a0 < width:
            a1 = change(row, max(a0, 0), colour)
            b1 = a0 + 1
            while b1 < width and not (above[b1] != colour and (above[b1 - 1] if b1 else 0) == colour):
                b1 += 1
            b2 = change(above, b1, 1 - colour)
            if b2 < a1:
                bits, a0 = bits + fax.PASS, b2
            elif abs(a1 - b1) <= 3:
                bits, a0, colour = bits + shifts[a1 - b1], a1, 1 - colour
            else:
                a2 = change(row, a1, 1 - colour)
                bits, a0 = bits + fax.HORIZONTAL + run(a1 - max(a0, 0), colour) + run(a2 - a1, 1 - colour), a2
        above = row
    return bits + fax.END_OF_LINE * 2


def as_bytes(bits):
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def drawn(rng, n):
    h, w = (int(x) for x in rng.integers(1, (40, 90)))
    page = (rng.random((h, w)) < rng.random()).astype(int)
    if n % 4 == 1:
        page = np.repeat(page[:, : max(1, w // 9)], 9, axis=1)
    if n % 4 == 2:
        page = np.repeat(page, 3, axis=0)
    if n % 4 == 3:
        page[:] = n // 4 % 2
    return page


def test_fax_round_trips_of_a_thousand_pages():
    rng = np.random.default_rng(5)
    for n in range(1000):
        page = drawn(rng, n)
        assert (fax.decode(fax.encode(page), *page.shape) == page).all()


def test_fax_codes_are_those_of_the_standards_flow():
    rng = np.random.default_rng(6)
    for n in range(120):
        page = drawn(rng, n)
        assert fax.encode(page) == as_bytes(one_by_one(page))
    long = np.zeros((3, 9000), int)
    long[1, 2600:8800] = long[2, 2624:2625] = 1
    assert fax.encode(long) == as_bytes(one_by_one(long)) and (fax.decode(fax.encode(long), 3, 9000) == long).all()


def test_fax_codes_tell_themselves_apart():
    for codes in (fax.WHITE + fax.LONG, fax.BLACK + fax.LONG, [*fax.SHIFTS, fax.PASS, fax.HORIZONTAL, "0000000"]):
        assert not any(b.startswith(a) for a, b in itertools.permutations(codes, 2))
    assert sum(2.0 ** -len(c) for c in fax.WHITE + fax.LONG) == sum(2.0 ** -len(c) for c in fax.BLACK + fax.LONG) == 1 - 2**-8


def runs_of(row):
    out, colour, n = "", 0, 0
    for v in [*row, None]:
        if v == colour:
            n += 1
            continue
        while n >= 64:
            part = min(n // 64 * 64, 2560)
            out, n = out + fax._RUNS[colour][part], n - part
        out, n, colour = out + fax._RUNS[colour][n], 1, 1 - colour
    return out


@pytest.mark.parametrize("options", [0, 4, 1])
def test_rows_of_runs_and_mixed_rows(options):
    rng = np.random.default_rng(7)
    for n in range(60):
        page = drawn(rng, n)
        plain = b"".join(as_bytes(runs_of(row)) for row in page)
        assert (fax.decode(plain, *page.shape, compression=2) == page).all()
        bits = ""
        for y, row in enumerate(page):
            fill = "0" * (-(len(bits) + 12) % 8) if options & 4 else ""
            bits += fill + fax.END_OF_LINE
            if options & 1 and y % 3:
                both = one_by_one(np.stack((page[y - 1], row)))[: -len(fax.END_OF_LINE) * 2]
                bits += "0" + both[len(one_by_one(page[y - 1 : y])) - len(fax.END_OF_LINE) * 2 :]
            else:
                bits += ("1" if options & 1 else "") + runs_of(row)
        bits += (fax.END_OF_LINE + ("1" if options & 1 else "")) * 6
        assert (fax.decode(as_bytes(bits), *page.shape, compression=3, options=options) == page).all()


def test_broken_fax_data():
    page = np.eye(20, dtype=int)
    data = fax.encode(page)
    assert (fax.decode(data, 8, 20) == page[:8]).all() and fax.decode(b"", 3, 4).tolist() == [[0] * 4] * 3
    assert (fax.decode(data, 30, 20)[20:] == 0).all()
    for bad in (data[: len(data) // 2], b"\x01\xff\xff", b"\x20\x00\x00\x00\x00"):
        with pytest.raises(ValueError, match="broken fax data"):
            fax.decode(bad, 20, 20)
    rng = np.random.default_rng(1)
    for _ in range(300):  # noise is read or refused, and never runs on
        try:
            assert fax.decode(rng.bytes(40), 9, 30).shape == (9, 30)
        except ValueError:
            pass


def test_a_large_page_is_coded_in_seconds():
    import time

    rng = np.random.default_rng(3)
    page = np.zeros((3508, 2480), np.uint8)
    for y in range(100, 3400, 50):
        for x in range(100, 2380, 25):
            page[y : y + 30, x : x + 18] = np.kron(rng.random((10, 6)) < 0.45, np.ones((3, 3)))
    began = time.process_time()
    data = fax.encode(page)
    assert (fax.decode(data, *page.shape) == page).all() and time.process_time() - began < 5


def test_sizes_of_stacked_pages_are_those_of_each():
    rng = np.random.default_rng(4)
    for width in (1, 64, 3000):
        pages = [(rng.random((h, width)) < share).astype(np.uint8) for h, share in ((1, 0.5), (4, 0.0), (3, 1.0), (9, 0.1), (2, 0.9), (1, 1.0))]
        begins = np.zeros(sum(map(len, pages)), bool)
        begins[np.cumsum([0, *map(len, pages[:-1])])] = True
        assert fax.encoded_sizes(np.concatenate(pages), begins).tolist() == [len(fax.encode(p)) for p in pages]


def test_fax_lengths_are_those_of_each_text(spark, small):
    got = {r.page_id: (r.height, r.fax_bytes, r.plain_bytes) for r in page_queries.reg.queries["fax_lengths"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 0").collect()
    assert got.keys() == {d.doc_id for d in docs}
    for d in docs[:25]:
        ink = [0 if c in " \t\n\v\f\r" else 1 for c in d.text]
        page = np.array(ink + [0] * (-len(ink) % 64)).reshape(-1, 64)
        assert got[d.doc_id] == (len(page), len(as_bytes(one_by_one(page))), len(page) * 8)


def test_fax_in_tiff_files():
    rng = np.random.default_rng(0)
    ink = np.where(rng.random((30, 41)) < 0.3, 0, 255).astype(np.uint8)
    gray = rng.integers(0, 256, (7, 9)).astype(np.uint8)
    data = tiff.encode([tiff.Page(ink, (600, 300), True), tiff.Page(gray)], fax4=True)
    a, b = tiff.decode(data)
    assert (a.pixels == ink).all() and a.bitonal and a.dpi == (600, 300) and (b.pixels == gray).all()
    assert tiff.count(data) == 2 and (tiff.decode(data, 1, 2)[0].pixels == gray).all()
    # Strips are coded each on its own, and bits may be low first.
    strips = [fax.encode(ink[i : i + 10] < 128) for i in (0, 10, 20)]
    low = [np.packbits(np.unpackbits(np.frombuffer(s, np.uint8)), bitorder="little").tobytes() for s in strips]
    for parts, order in ((strips, 1), (low, 2)):
        out = bytearray(b"II*\0\0\0\0\0")
        places = []
        for part in parts:
            places.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        lists = len(out)
        out += struct.pack("<3I", *places) + struct.pack("<3I", *map(len, parts))
        tags = [(256, 4, 1, 41), (257, 4, 1, 30), (258, 3, 1, 1), (259, 3, 1, 4), (262, 3, 1, 0), (266, 3, 1, order), (273, 4, 3, lists), (278, 4, 1, 10), (279, 4, 3, lists + 12)]
        struct.pack_into("<I", out, 4, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"
        assert (tiff.decode(bytes(out))[0].pixels == ink).all()


def test_pdf_pages_are_faxed_where_that_is_smaller():
    rng = np.random.default_rng(0)
    edge = np.arange(64)[None, :] < 32 + np.cumsum(rng.integers(-1, 2, 64))[:, None]
    rows, noise = np.packbits(edge, axis=1).tobytes(), rng.bytes(8) * 64
    made = documents.pdf([(64, 64, rows, "diagonal"), (64, 64, noise, "noise")], "smaller")
    assert made.count(b"/CCITTFaxDecode /DecodeParms << /K -1 /Columns 64 /Rows 64 >>") == 1 and made.count(b"/FlateDecode") == 1
    stream = made.split(b"stream\n")[1].split(b"\nendstream")[0]
    assert (fax.decode(stream, 64, 64) == edge).all()
    start = int(made.split(b"startxref\n")[1].split()[0])
    places = [int(x[:10]) for x in made[start:].split(b"\n")[3:] if x.endswith(b" 00000 n ")]
    assert all(made[p:].startswith(b"%d 0 obj" % (i + 1)) for i, p in enumerate(places)) and len(places) == 9


@pytest.fixture
def book_pages(spark):
    n = F.col("id")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.when(F.pmod(F.xxhash64(n, i), F.lit(3)) == 0, 0).otherwise(255))
    return spark.range(90).select(
        F.element_at(F.array(F.lit("one"), F.lit("a/b"), F.lit(None)), (n % 3 + 1).cast("int")).alias("book"), (100 - n).alias("position"),
        F.lit(6).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.lit(300.0).alias("dpi_x"), F.lit(300.0).alias("dpi_y"), pixels.alias("pixels"), (n % 2 == 0).alias("bitonal"), n.alias("id"),
    )


def test_books_are_written_and_read_by_many_tasks(spark, tmp_path, book_pages):
    out = str(tmp_path / "books")
    documents.write_tiff(book_pages, out)
    assert sorted(os.listdir(out)) == ["%null.tif", "a%2Fb.tif", "one.tif"] and os.listdir(tmp_path) == ["books"]
    page_files.register(spark)
    read = spark.read.format(page_files.PAGES).options(split_bytes=1, images=7).load(out)
    assert read.rdd.getNumPartitions() == 15  # thirty images of each file, seven a task
    want = {(page_files.file_name(r.book, "tif"), 29 - i): r.pixels for i, r in ((r.id // 3, r) for r in book_pages.collect())}
    rows = read.collect()
    assert {(os.path.basename(r.path), r.page): r.pixels for r in rows} == want and len(rows) == 90
    assert spark.read.format(page_files.PAGES).option("glob", "one*").load(out).count() == 30
    with pytest.raises(Exception, match="FileExistsError"):
        documents.write_tiff(book_pages, out)
    assert os.listdir(tmp_path) == ["books"]
    documents.write_tiff(book_pages.where("book = 'one'"), out, mode="overwrite")
    assert os.listdir(out) == ["one.tif"] and os.listdir(tmp_path) == ["books"]


def test_a_failed_task_leaves_nothing(spark, tmp_path, book_pages):
    broken = book_pages.withColumn("pixels", F.when(F.col("id") == 89, F.array(F.lit(1))).otherwise(F.col("pixels")))
    with pytest.raises(Exception, match="reshape"):
        documents.write_tiff(broken, str(tmp_path / "books"))
    assert os.listdir(tmp_path) == []
    parts = spark.createDataFrame([("x", 1, b"a"), ("y", 1, b"b"), ("x", 2, b"c")], "book string, position int, data binary")
    for cut in (parts.coalesce(1), parts.repartition(3, "position", "data")):
        with pytest.raises(Exception, match="sorted by book|two tasks have written"):
            cut.write.format(page_files.BOOKS).option("kind", "txt").mode("append").save(str(tmp_path / "books"))
        assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="not sorted"):
        parts.where("book = 'x'").coalesce(1).orderBy(F.desc("position")).write.format(page_files.BOOKS).option("kind", "txt").mode("append").save(str(tmp_path / "books"))


def test_a_book_of_ten_thousand_pages(spark, tmp_path):
    rows = F.unhex(F.repeat(F.lpad(F.hex(F.pmod(F.col("id"), F.lit(65536))), 4, "0"), 4))
    pages = spark.range(10_000).select(F.lit("long").alias("book"), F.col("id").alias("position"), F.lit(16).alias("width"), F.lit(4).alias("height"), rows.alias("rows"), F.col("id").cast("string").alias("text"))
    documents.write_pdf(pages, str(tmp_path / "pdf"))
    data = (tmp_path / "pdf" / "long.pdf").read_bytes()
    assert data.count(b"/Type /Page ") == 10_000
    at = [data.index(b"(%d) '" % i) for i in (0, 1, 77, 5000, 9999)]
    assert at == sorted(at)
    documents.write_text(pages, str(tmp_path / "txt"), "book", "position", "text")
    assert (tmp_path / "txt" / "long.txt").read_text() == "\f".join(map(str, range(10_000)))


def test_hocr_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two\nthree"), (2, None), (3, "")], "doc_id long, text string")
    documents.write_hocr(docs, str(tmp_path / "h"), "doc_id", "text")
    one = (tmp_path / "h" / "1.hocr").read_text()
    assert one.startswith("<?xml") and "ocrx_word" in one and one.endswith("</body></html>")


def test_damaged_and_empty_collections(spark, tmp_path):
    page_files.register(spark)
    (tmp_path / "in").mkdir()
    read = lambda **o: spark.read.format(page_files.PAGES).options(**o).load(str(tmp_path / "in"))
    assert read().count() == 0
    good = tiff.encode([tiff.Page(np.zeros((3, 4), np.uint8))] * 2)
    z = zlib.compress(b"\0\x0a\x14")
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 2, 1, 8, 0, 0, 0, 0) + b"crc_" + struct.pack(">I4s", len(z), b"IDAT") + z + b"crc_"
    cut = bytearray(good)
    struct.pack_into("<H", cut, struct.unpack_from("<I", good, 8 + 2 + 12 * 13)[0] + 2 + 12 * 2, 999)  # the second image has no bits a sample
    for name, data in (("a.tif", good), ("b.png", png), ("c.tif", b"nothing"), ("d.tif", b""), ("e.tif", bytes(cut))):
        (tmp_path / "in" / name).write_bytes(data)
    rows = {(os.path.basename(r.path), r.page): r for r in read().collect()}
    assert ("b.png", 0) in rows, rows
    assert rows["b.png", 0].pixels == [10, 20] and rows["a.tif", 1].height == 3 and ("e.tif", 0) in rows
    assert rows["c.tif", None].error == "not a TIFF file" and rows["d.tif", None].error
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format(page_files.PAGES).load(str(tmp_path / "none")).count()
