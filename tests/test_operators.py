"""Operators on small cases drawn by hand."""

import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from leafmill.functions import geometry as g, text as tx
from leafmill.operators import catalogue as c, dependencies, kernels as k, raster as r
from leafmill.sources import documents, image_headers


def page(spark, rows, column="black"):
    return spark.createDataFrame([(1, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], f"page_id long, y int, x int, {column} int")


def grid(df, column):
    found = {(p.y, p.x): p[column] for p in df.collect()}
    return [[found[y, x] for x in range(1 + max(b for _, b in found))] for y in range(1 + max(a for a, _ in found))]


def test_spans_with_gaps_and_minimum_length(spark):
    def run(counts, gap, length):
        bins = spark.createDataFrame(list(enumerate(counts)), "i int, n int").withColumn("page_id", F.lit(1))
        return sorted((s.begin, s.end) for s in r.spans(bins, ["page_id"], gap, length).collect())

    assert run([0, 1, 0, 1, 1, 1, 0, 1, 1], 1, 2) == [(3, 6), (7, 9)]
    assert run([0, 1, 0, 1, 1, 0, 0, 1, 1], 2, 1) == [(1, 5), (7, 9)]
    assert run([0, 0, 0], 1, 1) == []


def test_projections_of_a_page(spark):
    p = page(spark, [[0, 1, 1], [0, 0, 0], [1, 1, 0]])
    found = {(x.axis, x.i): x.n for x in r.projections(p).collect()}
    assert [found["row", i] for i in range(3)] == [2, 0, 2]
    assert [found["column", i] for i in range(3)] == [1, 2, 1]


def test_otsu_of_two_tones_and_of_one(spark):
    two = spark.createDataFrame([(1, 0, i, 10 if i < 4 else 200) for i in range(9)] + [(2, 0, i, 7) for i in range(4)], "page_id long, y int, x int, v int")
    found = {x.page_id: x.threshold for x in r.otsu(two).collect()}
    assert 10 < found[1] <= 200 and found[2] == 0


def test_dilation_reaches_and_erosion_keeps_edges(spark):
    p = page(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])
    assert grid(r.dilate(p, 3, 3), "black") == [[1] * 3] * 3
    full = page(spark, [[1, 1], [1, 1]])
    assert grid(r.erode(full, 3, 3), "black") == [[1, 1], [1, 1]]


def test_opening_by_an_even_brick_is_no_shift(spark):
    rows = [[0, 0, 0, 0], [0, 1, 1, 0], [0, 1, 1, 0], [0, 0, 0, 1]]
    assert grid(r.opened(page(spark, rows), 2, 2), "black") == [[0, 0, 0, 0], [0, 1, 1, 0], [0, 1, 1, 0], [0, 0, 0, 0]]


@pytest.mark.parametrize("seed", range(20))
def test_components_against_flood_fill(seed):
    black = (np.random.default_rng(seed).random((6, 7)) < 0.45).astype(int)
    want, n = np.zeros(black.shape, int), 0
    for y in range(6):
        for x in range(7):
            if black[y, x] and not want[y, x]:
                n, todo = n + 1, [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 6 and 0 <= b < 7 and black[a, b] and not want[a, b]:
                        want[a, b] = n
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert (k.components(black) == want).all()


@pytest.mark.parametrize("seed", range(10))
def test_gray_reconstruction_against_single_steps(seed):
    rng = np.random.default_rng(seed)
    seed_page, mask = rng.integers(0, 256, (5, 5)), rng.integers(0, 256, (5, 5))
    now = np.maximum(seed_page, mask)
    for _ in range(100):
        for y in range(5):
            for x in range(5):
                around = now[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].min()
                now[y, x] = max(mask[y, x], min(now[y, x], around))
    assert (k.gray_reconstruct(seed_page, mask) == now).all()


def test_deviation_needs_three_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.1, 0.1, 0.1, 0.3])] + [(9, None)], "k int, v double")
    found = {x.k: x for x in c.deviations(df, "k", "v", 1.5, 1.0, False).collect()}
    assert found[4].deviant and not found[0].deviant and found[9].deviation == -1
    assert not any(x.deviant for x in c.deviations(df, "k", "v", 1.5, 1.0, True).collect())
    assert not any(x.deviant for x in c.deviations(df.where("k < 2"), "k", "v", 1.5, 1.0, False).collect())


def test_natural_order(spark):
    names = ["a_1.png", "a_0002.png", "a010_2.png", "a10_10.png", "010.png", "10.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [x.n for x in df.orderBy(c.natural_key(F.col("n")), "n").collect()]
    assert got.index("a_1.png") < got.index("a_0002.png") and got.index("a010_2.png") < got.index("a10_10.png") and got.index("010.png") < got.index("10.png")


def test_merge_order_puts_new_pages_after_their_neighbour(spark):
    project = spark.createDataFrame([("b", i, n) for i, n in enumerate("abcd")], "book string, pos int, key string")
    previous = spark.createDataFrame([(0, "c", False), (1, "a", True), (2, "gone", True)], "pos int, key string, ticked boolean")
    got = {x.new_pos: (x.key, x.ticked) for x in c.merge_order(previous, project).collect()}
    assert [got[i] for i in range(4)] == [("c", False), ("d", True), ("a", True), ("b", True)]


def test_removing_and_restoring_halves(spark):
    images = spark.createDataFrame([(1, 2, ""), (2, 1, "L"), (3, 2, "")], "image_id int, sub_pages int, removed string")
    gone = spark.createDataFrame([(1, "left"), (2, "left"), (3, "single")], "image_id int, sub_page string")
    left = {x.image_id: (x.sub_pages, x.removed) for x in c.remove_pages(images, gone).collect()}
    assert left == {1: (1, "L"), 2: (1, "L")}
    back = {x.image_id: (x.sub_pages, x.removed) for x in c.unremove_pages(images, gone).collect()}
    assert back == {1: (2, ""), 2: (2, ""), 3: (2, "")}


def test_zone_needs_an_area(spark):
    df = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 1D), named_struct('x', 2D, 'y', 2D)) AS line, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 0D, 'y', 1D)) AS tri")
    assert tuple(df.select(g.valid_zone(F.col("line")), g.valid_zone(F.col("tri"))).first()) == (False, True)


def test_headers_and_damaged_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 30, 20, 8, 0, 0, 0, 0) + b"crc_" + struct.pack(">I4sIIB", 9, b"pHYs", 11811, 11811, 1) + b"crc_" + struct.pack(">I4s", 0, b"IEND")
    tif = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 40) + struct.pack("<HHII", 257, 4, 1, 50) + struct.pack("<I", 0)
    for name, data in (("a.png", png), ("b.tif", tif), ("c.png", b"nothing")):
        (tmp_path / name).write_bytes(data)
    found = {x.path.rsplit("/", 1)[1]: x for x in image_headers.read_headers(spark, str(tmp_path)).collect()}
    assert (found["a.png"].width, found["a.png"].height, round(found["a.png"].dpi_x)) == (30, 20, 300)
    assert (found["b.tif"].width, found["b.tif"].height) == (40, 50)
    assert found["c.png"].error == "unknown format"


def test_pdf_has_its_pages():
    made = documents.pdf([(8, 2, b"\xf0\x0f", "one (1)"), (8, 2, b"\xff\x00", "two")])
    assert made.startswith(b"%PDF") and made.count(b"/Type /Page ") == 2 and b"one \\(1\\)" in made
    start = int(made.split(b"startxref\n")[1].split()[0])
    assert made[start : start + 4] == b"xref" and zlib.decompress(made.split(b"stream\n")[1].split(b"\nendstream")[0]) == b"\xf0\x0f"


def test_project_xml_skips_bad_rows(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        '<project><directories><directory id="1" path="/in"/></directories><files><file id="1" dirId="1" name="a.tif"/><file id="x" dirId="1" name="b.tif"/></files>'
        '<images><image id="1" fileId="1" fileImage="0" subPages="2"/><image id="2" fileId="1" fileImage="0" subPages="1"/><image id="3" fileId="9" subPages="1"/></images>'
        '<pages><page id="1" imageId="1" subPage="left"/><page id="2" imageId="7" subPage="left"/></pages></project>'
    )
    from leafmill.sources import project

    found = project.read_project(spark, str(tmp_path / "p.xml"))
    assert found["images"].count() == 1 and found["pages"].count() == 1
    assert {x.kind: x.n for x in found["skipped"].collect()} == {"directory": 0, "file": 1, "image": 2, "page": 1}


def test_hull_homography_skew():
    pts = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)])
    assert len(k.convex_hull(pts)) == 4
    h = k.homography(np.array([(0, 0), (1, 0), (1, 1), (0, 1)]), np.array([(0, 0), (2, 0), (2, 3), (0, 3)]))
    x = h @ np.array([0.5, 0.5, 1])
    assert np.allclose(x[:2] / x[2], (1, 1.5))
    black = np.zeros((120, 200), int)
    for y in range(20, 100, 12):
        for x in range(10, 190):
            black[int(round(y + np.tan(np.radians(2.0)) * (x - 100))), x] = 1
    assert abs(k.skew_angle(black) - 2.0) < 0.3


def around(a, y, x, r):
    return a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]


@pytest.mark.parametrize("seed", range(4))
def test_windows_of_pages_against_loops(seed):
    a = np.random.default_rng(seed).integers(0, 256, (9, 11))
    each = lambda f: np.array([[f(around(a, y, x, 2)) for x in range(11)] for y in range(9)])
    assert np.allclose(k.box_median(a, 2, at_once=100), each(np.median)) and np.allclose(k.box_median(a, 2), each(np.median))
    assert np.allclose(k.ring_means(a, 2), each(np.mean))
    assert (k.niblack(a, 2, 0.5) == np.floor(np.clip(each(np.mean) - 0.5 * each(np.std), 0, 255) + 1e-9)).mean() > 0.98


@pytest.mark.parametrize("seed", range(8))
def test_nearest_labels_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    label = np.where(rng.random((7, 9)) < 0.12, rng.integers(1, 5, (7, 9)), 0)
    squared, near = k.nearest(label)
    places = np.argwhere(label > 0)
    for y in range(7):
        for x in range(9):
            want = min(((p - y) ** 2 + (q - x) ** 2, label[p, q]) for p, q in places) if len(places) else (np.inf, 0)
            assert (squared[y, x], near[y, x]) == want


def test_blur_keeps_flat_pages_and_the_sum():
    assert np.allclose(k.blur(np.full((6, 7), 9), 2, 3), 9)
    spot = np.zeros((31, 31))
    spot[15, 15] = 1000
    made = k.blur(spot, 2.0, 2.0)
    want = np.exp(-0.5 * ((np.arange(31) - 15) / 2.0) ** 2)
    assert np.allclose(made, 1000 * np.outer(want, want) / want.sum() ** 2, atol=1e-3)
    assert (k.sharpen(np.full((5, 5), 80), 1, 0.8) == 80).all()


def test_despeckling_spreads_from_what_is_kept():
    black = np.zeros((12, 30), int)
    black[2:6, 2:6] = 1  # big
    black[3:5, 8] = 1  # two pixels, two away: stays for it
    black[3:5, 11] = 1  # stays for the one before
    black[9, 28] = 1  # one pixel: goes
    black[3:5, 25] = 1  # two pixels, far off: goes
    kept = k.despeckle(black, 2, 10, 2.2)
    assert kept[:, :12].sum() == 16 + 4 and kept[:, 12:].sum() == 0
    assert (k.despeckle(np.zeros((3, 3), int), 2, 10, 2.2) == 0).all()


def test_two_tones_lie_between_the_means():
    assert k.two_tones(np.array([[10] * 5 + [200] * 5])) == 105
    assert k.two_tones(np.array([[10] * 5 + [200] * 5]), delta=64) > 105 and k.two_tones(np.full((2, 2), 7)) in (7, 8)


def test_denoising_against_single_pixels():
    a = np.random.default_rng(1).integers(0, 256, (6, 7))
    made = k.denoise(a, 2, 0.5)
    for y in range(6):
        for x in range(7):
            colour, weight, alike = float(a[y, x]), 1.0, 1 / 25
            for r in (1, 2):
                mean = around(a, y, x, r).mean()
                w = np.exp(-(r * r / 25 + ((a[y, x] - mean) / 255 * r / 0.5) ** 2))
                colour, weight, alike = colour + mean * w * 8 * r, weight + w * 8 * r, alike + (8 * r / 25 if w > 0.02 else 0)
            colour /= weight
            assert made[y, x] == int(min(255, max(0, colour + (a[y, x] - colour) * (0.16 if alike > 0.66 else 0.84))) + 0.5)
    assert (k.denoise(np.full((5, 5), 77), 2, 0.5) == 77).all()


def test_ink_on_uneven_paper():
    y, x = np.indices((40, 60))
    paper = 120 + 2 * x
    page_ = np.where((y % 10 < 2) & (x % 7 < 4), paper - 90, paper)
    ink = (y % 10 < 2) & (x % 7 < 4)
    for black in (k.gatos(page_, 6, 0.2), (page_ < k.multi_scale(page_, 4, 0.5)), (r_ := k.robust(page_, 8, 0.2)) < k.two_tones(r_)):
        assert ((black > 0) == ink).mean() > 0.85
    assert k.robust(np.zeros((3, 3), int), 1, 0.5).tolist() == [[255] * 3] * 3


def test_patterns_are_replaced_and_may_reach_over_the_page():
    hole = np.array([[1, 1, 1], [1, 0, 1], [0, 1, 0]])
    assert k.hit_miss_replace(hole, ["XXX", "X+X", "?? "])[1, 1] == 1
    assert k.hit_miss_replace(np.array([[0, 1, 1]]), ["   ", " -X", "   "]).tolist() == [[0, 0, 1]]
    nub = np.array([[0, 0, 0, 0], [0, 1, 0, 0], [1, 1, 1, 1]])
    assert k.hit_miss_replace(nub, ["   ", " - ", "XXX"])[1, 1] == 0
    for turns in range(4):
        turned = np.rot90(nub, turns)
        assert (np.rot90(k.hit_miss_all_ways(turned, ["   ", " - ", "XXX"]), -turns)[1] == 0).all()
    assert (k.hit_miss_replace(nub, ["XX", "XX"]) == nub).all()


def test_surfaces_resampling_and_smoothing_of_planes():
    y, x = np.indices((8, 9))
    plane = 10 + 3 * x + 5 * y
    assert np.allclose(k.fit_surface(plane, 1, 1), plane) and (k.polynomial_smooth(plane)[2:-2, 2:-2] == plane[2:-2, 2:-2]).all()
    same = k.resample(plane, np.array([[1.0, 0, 0], [0, 1.0, 0]]), 8, 9)
    moved = k.resample(plane, np.array([[1.0, 0, 2], [0, 1.0, 0]]), 8, 9)
    assert (same == plane).all() and (moved[:, :7] == plane[:, 2:]).all() and (moved[:, 7:] == 255).all()
    assert (k.subtract_background(np.full((5, 5), 155), 2, 1.0) == 255).all()


def test_lines_hulls_and_colours():
    black = np.zeros((20, 20), int)
    black[7] = 1
    (angle, distance, votes), *_ = k.hough_peaks(black)
    assert (angle, distance, votes) == (18, 7, 20)
    means = k.colour_means(np.array([[0.0], [2.0], [100.0], [103.0]]), np.array([5, 5, 5, 10]), 2)
    assert sorted(means[:, 0].tolist()) == [1.0, 102.0]


def test_pages_as_rows_and_as_pixels_agree(spark):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 256, s) for s in ((3, 4), (1, 1), (5, 2))]
    rows = spark.createDataFrame([(i, *p.shape, p.ravel().tolist()) for i, p in enumerate(pages)], "page_id long, height int, width int, v array<int>")
    flat = spark.createDataFrame([(i, int(y), int(x), int(p[y, x])) for i, p in enumerate(pages) for y, x in np.argwhere(p >= 0)], "page_id long, y int, x int, v int")
    f = lambda a: 255 - a.T
    assert sorted(map(tuple, k.map_pages(rows, f).collect())) == sorted(map(tuple, k.per_page(flat, f).collect()))
    assert k.map_pages(rows, f, where=lambda a: a > 300).count() == 0
    assert {v.page_id: v.top for v in k.map_values(rows, lambda a: int(a.max()), "v", "top", "int").collect()} == {i: int(p.max()) for i, p in enumerate(pages)}


def test_stages_of_a_drawn_spread(spark):
    from leafmill.plans import stages

    spread = np.zeros((30, 61), int)
    for left in (4, 36):
        spread[6:26:4, left : left + 20] = 1
    assert stages.cut_of(spread, 3) == 30.0 and stages.cut_of(np.ones((4, 6), int), 3) == 3.0
    assert (stages.oriented(np.array([[1, 2], [3, 4]]), 90) == [[3, 1], [4, 2]]).all()
    rows = spark.createDataFrame([(5, 30, 61, spread.ravel().tolist())], "page_id long, height int, width int, black array<int>")
    boxes = {b.page_id: (b.left, b.top, b.right, b.bottom) for b in stages.prepared(rows).collect()}
    assert boxes == {10: (4, 6, 23, 22), 11: (6, 6, 25, 22)}
    out = stages.process(rows, margin=2).toPandas()
    assert (out["page_w"] == 24).all() and (out["page_h"] == 21).all() and out.groupby("page_id").size().tolist() == [100, 100]
    assert out["x"].min() == 2 and out["y"].min() == 2


def test_tones_by_single_steps(spark):
    from leafmill.operators import tones

    df = spark.range(256).select((F.col("id") / 255.0).alias("x"))
    run = lambda **tone: [v[0] for v in df.select(tones.half_up(tones.adjusted(F.col("x"), **tone) * 255)).collect()]
    assert run() == list(range(256)) and run(exposure=1.0)[100] == 200 and run(contrast=100)[128] == 129
    assert run(blacks=100)[0] == 64 and run(blacks=-100)[64] == 0 and run(whites=100)[255] == 255 and run(highlights=-100)[255] == 153 and run(shadows=100)[0] == 102


def test_tiff_and_png_round_trips(spark, tmp_path):
    from leafmill.sources import tiff

    rng = np.random.default_rng(0)
    gray, colour = rng.integers(0, 256, (13, 17)).astype(np.uint8), rng.integers(0, 256, (5, 9, 3)).astype(np.uint8)
    ink = np.where(rng.random((11, 21)) < 0.5, 0, 255).astype(np.uint8)
    data = tiff.encode([tiff.Page(gray, (300, 300)), tiff.Page(colour, (72, 72)), tiff.Page(ink, (600, 600), True)])
    a, b, c_ = tiff.decode(data)
    assert (a.pixels == gray).all() and (b.pixels == colour).all() and (c_.pixels == ink).all() and c_.bitonal and c_.dpi == (600, 600)
    assert list(image_headers.tiff(data))[2][2:4] == (21, 11)
    z = zlib.compress(b"\0\x0a\x14\2\1\1")
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 2, 2, 8, 0, 0, 0, 0) + b"crc_" + struct.pack(">I4s", len(z), b"IDAT") + z + b"crc_" + struct.pack(">I4s", 0, b"IEND") + b"crc_"
    for name, content in (("a.tif", data), ("b.png", png), ("c.tif", b"II*\0" + b"\xff" * 9), ("d.tif", b"MM\0*\0")):
        (tmp_path / name).write_bytes(content)
    rows = tiff.read_pages(spark, str(tmp_path)).collect()
    found = {(r_.path.rsplit("/", 1)[1], r_.page): r_ for r_ in rows}
    assert found["b.png", 0].pixels == [10, 20, 11, 21] and found["a.tif", 1].channels == 3 and found["a.tif", 0].pixels == gray.ravel().tolist()
    assert found["c.tif", None].error and found["d.tif", None].error
    assert tiff.decoded(tiff.encode([tiff.Page(np.full((40, 60), 9, np.uint8), (300, 300))]), 10)[0].pixels.shape == (10, 15)
    pages = spark.createDataFrame([(1, 2, 3, [0, 255, 0, 255, 0, 255], True, 300.0)], "page_id long, height int, width int, pixels array<int>, bitonal boolean, dpi double")
    assert tiff.decode(bytes(tiff.encoded(pages).first().tiff))[0].pixels.tolist() == [[0, 255, 0], [255, 0, 255]]


def test_tiff_samples_of_other_kinds():
    from leafmill.sources import tiff

    def simple(order, width, bits, form, photometric, data):
        out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(data) + len(data) % 2)) + data + b"\0" * (len(data) % 2)
        tags = [(256, width), (257, 1), (258, bits), (259, 1), (262, photometric), (273, 8), (279, len(data)), (339, form)]
        return bytes(out + struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in tags) + b"\0\0\0\0")

    for order in "<>":
        read = lambda *args: tiff.decode(simple(order, *args))[0].pixels.tolist()  # noqa: B023, E731
        assert read(3, 16, 2, 1, np.array([-100, 0, 155], order + "i2").tobytes()) == [[0, 100, 255]]
        assert read(4, 32, 3, 1, np.array([0, 0.5, 1, np.nan], order + "f4").tobytes()) == [[0, 128, 255, 0]]
        assert read(3, 16, 3, 0, np.array([0, 2, 4], order + "f2").tobytes()) == [[255, 127, 0]]
        assert read(3, 4, 1, 1, bytes((0x0F, 0x70))) == [[0, 255, 119]]
    assert tiff.unpack_bits(tiff.pack_bits(b"aaaaab" * 60 + b"xyz")) == b"aaaaab" * 60 + b"xyz"
    codes = [256, 97, 258, 98, 257]  # a, aa, b
    bits = "".join(format(code, "09b") for code in codes)
    assert tiff.unpack_lzw(bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))) == b"aaab"


def test_outlines_and_names(spark):
    from leafmill.operators import dependencies as d

    names = {"a.tif": None, "": "empty", "a\tb": "control", "a:b": "character", "end.": "end", "end ": "end"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r_.n: r_.why for r_ in df.select("n", d.bad_name(F.col("n")).alias("why")).collect()} == names
    paths = {"/a/../b:c/../d": None, "/x./y": "end", "": "empty", "//a//./b": None, "/a/b?/c:d": "character"}
    df = spark.createDataFrame([(n,) for n in paths], "n string")
    assert {r_.n: r_.why for r_ in df.select("n", d.bad_path(F.col("n")).alias("why")).collect()} == paths


def test_scans_go_behind_one_another():
    from leafmill.streaming import scans

    state, seen = ("", ""), []
    for what, file in (("inserted", "s0"), ("selected", "a"), ("inserted", "s1"), ("selected", "s1"), ("inserted", "s2"), ("selected", "b"), ("cleared", "")):
        state = scans.moved_anchor(state, what, file)
        seen.append(state)
    assert seen == [("", ""), ("a", "a"), ("a", "s1"), ("a", "s1"), ("a", "s2"), ("b", "b"), ("", "")]


@pytest.mark.parametrize("size", [(1, 1), (3, 3), (4, 7), (2, 5)])
def test_box_extremes_and_openings_against_loops(size):
    from leafmill.operators import layout

    h, w = size
    a = np.random.default_rng(h * w).integers(0, 256, (8, 10))
    box = lambda y, x: a[max(0, y - h // 2) : y - h // 2 + h, max(0, x - w // 2) : x - w // 2 + w]
    for f, dark in ((np.min, True), (np.max, False)):
        assert (layout.box_extreme(a, h, w, dark) == [[f(box(y, x)) for x in range(10)] for y in range(8)]).all()
    black = np.zeros((12, 14), int)
    black[3 : 3 + h, 5 : 5 + w] = 1
    black[0, 0] = 1
    kept = layout.opened(black, h, w)
    assert kept[3 : 3 + h, 5 : 5 + w].all() and (size == (1, 1) or kept[1:].sum() == h * w)


def test_pictures_are_told_from_text():
    from leafmill.operators import layout

    page_ = np.full((90, 90), 240)
    page_[5:40:6, 5:80] = 20  # lines of text
    page_[50:85, 10:60] = 60 + np.add.outer(np.arange(35), np.arange(50)) % 90
    mask = layout.picture_mask(page_, 15)
    assert mask[55:80, 15:55].mean() > 0.95 and mask[:42].mean() < 0.05 and mask[:, 70:].mean() < 0.05
    assert layout.rectangles(np.array([[1, 1, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 1, 1]])) == [(0, 0, 2, 1), (3, 2, 2, 1)]
    ring = np.ones((6, 6), int)
    ring[1:5, 1:5] = 0
    ring[2, 2] = 1
    assert layout.rectangles(ring) == [(0, 0, 6, 6)]


def test_shadows_go_and_text_stays():
    from leafmill.operators import layout

    black = np.zeros((60, 80), int)
    black[:, :6] = 1
    black[10:50:8, 20:70] = 1
    left = layout.without_shadows(black, ((3, 40), (40, 3)))
    assert left[:, :6].sum() == 0 and left[:, 20:].sum() == black[:, 20:].sum()
    assert layout.page_box(black) == (20, 10, 69, 42)
    black[55, 78] = 1
    assert layout.trimmed_box(left | np.where(black > 0, np.indices(black.shape)[1] > 70, 0), (0, 0, 79, 59)) == (0, 0, 79, 42)


@pytest.mark.parametrize("seed", range(6))
def test_whitespaces_against_all_rectangles(seed):
    from leafmill.operators import layout

    black = (np.random.default_rng(seed).random((7, 9)) < 0.12).astype(int)
    clear = [(w * h) for y in range(7) for x in range(9) for h in range(1, 8 - y) for w in range(1, 10 - x) if not black[y : y + h, x : x + w].any()]
    found = layout.whitespaces(black, 1, 1, 3)
    assert found[0][2] * found[0][3] == max(clear) and all(not black[y : y + h, x : x + w].any() for x, y, w, h in found)
    for i, (x, y, w, h) in enumerate(found):
        assert all(x >= a + c or a >= x + w or y >= b + e or b >= y + h for a, b, c, e in found[:i])


def test_lines_are_found():
    from leafmill.operators import layout

    page_ = np.full((60, 80), 220)
    for y in range(60):
        page_[y, 38 + round(y * 4 / 59)] = 40
    (top, bottom), *_ = layout.vertical_lines(page_, 1)
    assert abs(top - 38) <= 1 and abs(bottom - 42) <= 1 and abs(layout.spine_split(page_) - 40) <= 1
    assert layout.spine_split(np.full((20, 20), 200)) is None
    strokes = np.zeros((100, 100), int)
    for x in range(10, 90, 9):
        for y in range(100):
            strokes[y, min(99, max(0, x + round(np.tan(np.radians(4)) * (y - 50))))] = 1
    assert abs(abs(layout.oblique_angle(strokes)) - 4) < 0.5
    assert np.allclose(layout.polynomial_line(np.array([1.0, 2.0, 5.0]), 2), [1, 0, 4])
    pts = np.array([(x, 2.0 * x + 1) for x in range(20)] + [(5, 40), (9, -7), (3, 30)], float)
    (a, b, c_), near = layout.ransac_line(pts, 0.01)
    assert near.sum() == 20 and abs(abs(-a / b) - 2) < 1e-9 and abs(c_ / b - 1) < 1e-6
    assert layout.ransac_line(np.zeros((0, 2)), 1)[1].sum() == 0


def test_cheapest_path_against_relaxation():
    from leafmill.operators import layout

    cost = np.random.default_rng(4).integers(1, 9, (6, 7)).astype(float)
    best = np.full(cost.shape, np.inf)
    best[0, 0] = 0
    for _ in range(60):
        for y in range(6):
            for x in range(7):
                for dy, dx in k.neighbours(8):
                    if 0 <= y + dy < 6 and 0 <= x + dx < 7:
                        best[y, x] = min(best[y, x], best[y + dy, x + dx] + cost[y, x] * (2**0.5 if dy and dx else 1))
    far, path = layout.cheapest_path(cost, (0, 0), (5, 6))
    assert far == pytest.approx(best[5, 6]) and path[0] == (0, 0) and path[-1] == (5, 6)


def test_bent_pages_come_out_straight():
    from leafmill.operators import layout

    x = np.arange(0, 101)
    bend = 8 * np.sin(np.pi * x / 100)
    page_ = np.full((80, 101), 255)
    for i in x:
        page_[int(20 + bend[i]) : int(60 + bend[i]), i] = 200
        page_[int(40 + bend[i]), i] = 0
    out = layout.dewarped(page_, np.stack((x, 20 + bend), 1), np.stack((x, 60 + bend), 1), 40, 100)
    assert out.shape == (40, 100) and (np.abs(out.argmin(axis=0) - 20) <= 1).all()
    flat = np.random.default_rng(2).integers(0, 256, (20, 30))
    same = layout.dewarped(flat, np.array([(0, 0), (30, 0)]), np.array([(0, 20), (30, 20)]), 20, 30)
    assert (same == flat).all()


def test_weak_colours_become_gray():
    from leafmill.operators import layout

    colour = np.zeros((9, 9, 3), int) + np.array([120, 118, 121])
    colour[:, 5:] = (220, 30, 30)
    made = layout.chroma_denoised(colour, 0.5, 20)
    assert (made[:, :3].max(axis=2) - made[:, :3].min(axis=2)).max() <= 1 and np.abs(made[:, 7:] - colour[:, 7:]).max() <= 3
    assert layout.add_component(np.array([[1, 0, 2]]), np.array([[0, 1, 1]])).tolist() == [[1, 3, 3]]


def test_all_threshold_methods_keep_their_bounds(spark):
    from leafmill.operators import binarize

    rng = np.random.default_rng(0)
    page_ = np.where(rng.random((12, 14)) < 0.2, rng.integers(0, 60, (12, 14)), rng.integers(190, 256, (12, 14)))
    pixels = page(spark, page_.tolist(), "v")
    assert len(binarize.ALL_METHODS) == 18
    for method in binarize.ALL_METHODS:
        made = np.array(grid(binarize.black_by(pixels, method, window=5, low=30, high=200), "black"))
        assert (made[page_ < 30] == 1).all() and (made[page_ > 200] == 0).all() and set(np.unique(made)) <= {0, 1}, method
    with pytest.raises(ValueError):
        binarize.black_by(pixels, "none")


def test_settings_of_steps_from_xml(spark, tmp_path):
    from leafmill.sources import project

    (tmp_path / "s.xml").write_text(
        '<project><pages><page id="1" imageId="1" subPage="left"/></pages><filters><a>'
        '<page id="1"><params contentDetectionMode="auto" pageDetectionMode="manual" fineTuneCorners="1"><content-rect x="1.5" y="2" width="x" height="4"/></params></page>'
        '<page id="1"><params contentDetectionMode="manual" pageDetectionMode="auto" fineTuneCorners="0"/></page><page id="q"><params contentDetectionMode="auto"/></page></a><b>'
        '<page id="2"><params autoMargins="1"><hardMarginsMM left="10" top="5" right="10" bottom="5.5"/><alignment hor="center" vert="top" null="0"/></params></page></b><c>'
        '<page id="3"><params blackOnWhite="1" despeckleLevel="1.5" depthPerception="2"><dpi horizontal="600" vertical="300"/><color-params colorMode="bw"><bw binarizationMethod="otsu" windowSize="200" sauvolaCoef="0.34" thresholdAdj="-7"/></color-params></params></page></c></filters></project>'
    )
    path = str(tmp_path / "s.xml")
    (c_,) = project.read_settings(spark, path, "content").collect()
    assert (c_.page_id, c_.content_mode, c_.page_mode, c_.corners, c_.content_x) == (1, "manual", "auto", 0, None)
    (m,) = project.read_settings(spark, path, "layout").collect()
    assert (m.page_id, m.margin_b, m.align_h, m.auto_margins) == (2, 5.5, "center", 1)
    (o,) = project.read_settings(spark, path, "output").collect()
    assert (o.page_id, o.dpi_x, o.method, o.window, o.delta, o.despeckle) == (3, 600, "otsu", 200, -7, 1.5)


def test_lines_of_text_bend_a_page_back():
    from leafmill.operators import layout

    page_ = np.full((120, 200), 255)
    x = np.arange(200)
    for base in (25, 50, 75, 100):
        for i in x[15:185]:
            if i % 9 < 6:  # letters
                y = int(base + 7 * np.sin(np.pi * i / 200))
                page_[y : y + 4, i] = 0
    black = (page_ < 128).astype(int)
    lines = layout.text_lines(black, 8, 80)
    assert len(lines) == 4 and all(abs(line[16, 1] - (base + 8.5)) < 1.5 and abs(line[0, 1] - line[16, 1]) > 3 for line, base in zip(lines, (25, 50, 75, 100), strict=True))
    flat = layout.straightened(page_, black, 8, 80)
    before, after = (np.diff((p < 128).sum(axis=1).astype(float)) ** 2 for p in (page_, flat))
    assert flat.shape == page_.shape and after.sum() > 4 * before.sum()
    assert (layout.straightened(np.full((20, 20), 200), np.zeros((20, 20), int), 3, 10) == 200).all()
    bar = black.copy()
    bar[:, 195:198] = 1
    mask = layout.text_mask(bar, 8)
    assert mask[:, 195:198].sum() == 0 and mask[:, :190].sum() == black[:, :190].sum()


def test_best_lines_against_a_fine_grid():
    from leafmill.operators import layout

    rng = np.random.default_rng(6)
    on = np.array([(x, 0.5 * x + 3) for x in range(0, 40, 2)]) + rng.normal(0, 0.1, (20, 2))
    points = np.concatenate((on, np.array([(30.0, y) for y in range(12)]), rng.random((15, 2)) * 40))
    (angle, distance, n), (angle2, distance2, n2) = layout.best_lines(points, 0.5, 2)
    near = lambda a, d: int((np.abs(points @ np.array([np.cos(a), np.sin(a)]) - d) <= 0.5).sum())
    grid_best = max(near(a, d) for a in np.linspace(0, np.pi, 181) for d in np.linspace(-45, 60, 211))
    assert n >= grid_best and near(angle, distance) >= n - 2
    assert abs(np.tan(angle + np.pi / 2) - 0.5) < 0.05 and (abs(angle2) < 0.1 or abs(angle2 - np.pi) < 0.1) and abs(abs(distance2) - 30) < 1 and n2 >= 10
    assert layout.best_lines(np.zeros((0, 2)), 1, 1) == []


def test_a_line_of_any_length_costs_as_its_length(spark):
    words = [f"w{i % 900}<" for i in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(words) + "\n\ntwo\x01 \x0bwords"), (2, None)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.page for r in tx.alto_pages(docs, "doc_id", "text").collect()}
    assert time.time() - began < 15
    at, line = 0, []
    for w in words:
        line.append(f'<String CONTENT="{w[:-1]}&lt;" HPOS="{at * 10}" VPOS="0" WIDTH="{len(w) * 10}" HEIGHT="20"/>')
        at += len(w) + 1
    last = '<String CONTENT="two\ufffd" HPOS="0" VPOS="40" WIDTH="40" HEIGHT="20"/><String CONTENT="words" HPOS="50" VPOS="40" WIDTH="50" HEIGHT="20"/>'
    assert got == {1: f"<Page><PrintSpace>\n<TextLine>{''.join(line)}</TextLine>\n<TextLine></TextLine>\n<TextLine>{last}</TextLine>\n</PrintSpace></Page>", 2: None}


def test_outlines_of_many_points(spark):
    ring = [(float(i % 173), float(i * i % 1009)) for i in range(30_000)]
    other = [*reversed(ring[77:] + ring[:77])]
    rows = [(ring, other), ([*ring, ring[0]], other), (ring, other[:-1]), (ring, [(x + 0.0005, y) for x, y in other]), ([], [(1.0, 1.0)]), ([], ring)]
    frame = spark.createDataFrame(rows, "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>").coalesce(1)
    began = time.time()
    assert [r.same for r in frame.select(dependencies.same_outline(F.col("a"), F.col("b")).alias("same")).collect()] == [True, True, False, True, True, False]
    assert time.time() - began < 15


def test_ranks_of_a_book_by_parts_of_it(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 3.5]), rng.randrange(300)) for _ in range(900)]
    frame = spark.createDataFrame(rows, "book string, w double, page_id long")
    found = c.with_rank(frame, "place", "book", [F.col("w").isNull(), F.coalesce("w", F.lit(0.0))], "page_id", 3)
    whole = frame.withColumn("place", F.rank().over(Window.partitionBy("book").orderBy(F.col("w").asc_nulls_last(), "page_id")).cast("long"))
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and found.dtypes == whole.dtypes
