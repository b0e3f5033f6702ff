"""Bent sheets and resampling by area, against drawn pages and shares of pixels; plans that must not shuffle twice."""

import numpy as np
import pytest

from leafmill.operators import sheets


def bent(n=41):
    x = np.linspace(0, 1000, n)
    return np.stack((x, 60 + 40 * np.sin(x / 400)), axis=1), np.stack((x, 1400 - 30 * np.sin(x / 350)), axis=1)


def test_places_go_there_and_back():
    for depth in (1.0, 2.0, 3.0):
        sheet = sheets.Sheet(*bent(), depth)
        u, v = np.meshgrid(np.linspace(0.01, 0.99, 25), np.linspace(-0.1, 1.1, 21))
        assert np.allclose(sheet.to_flat(*sheet.to_warped(u, v)), (u, v), atol=1e-9)
        assert sheet.length >= 1


def test_the_curves_are_the_sheets_edges():
    top, bottom = bent()
    sheet = sheets.Sheet(top, bottom)
    u = np.linspace(0, 1, 101)
    for v, curve in ((0, top), (1, bottom)):
        x, y = sheet.to_warped(u, np.full_like(u, v))
        assert np.allclose(y, np.interp(x, *curve.T), atol=1e-6)
    flat = sheets.Sheet(np.array([(0, 0), (500, 0), (1000, 0)]), np.array([(0, 800), (700, 800), (1000, 800)]))
    assert np.allclose(flat.to_warped([0.25, 0.75], [0.5, 0.1]), ([250, 750], [400, 80])) and flat.length == pytest.approx(1) and flat.level == 0.5


def test_a_slightly_bent_page_has_straight_lines_in_its_middle():
    near_spine = lambda x: np.maximum(0, 1 - x / 250) ** 2
    x = np.linspace(0, 1000, 101)
    line = lambda y: np.stack((x, y + near_spine(x) * np.interp(y, (100, 1400), (3, -10))), axis=1)
    sheet = sheets.Sheet(line(100), line(1400))
    assert sheet.level == pytest.approx(3 / 13, abs=0.05)
    for y in (100, 400, 750, 1100, 1400):
        _, v = sheet.to_flat(*line(y).T)
        assert np.ptp(v) * 1300 < 0.5, y


def test_damaged_curves_are_refused():
    good, nan = np.array([(0, 0), (50, 1), (100, 0)], float), float("nan")
    assert sheets.valid(good)
    for bad in ([(0, 0)], [(0, 0), (nan, nan), (100, 0)], [(0, 0), (float("inf"), 1), (100, 0)], [(5, 5), (9, 9), (5, 5)], []):
        assert not sheets.valid(np.array(bad))
        for curves in ((good, bad), (bad, good)):
            with pytest.raises(ValueError, match="finite points"):
                sheets.Sheet(*map(np.array, curves))


@pytest.mark.parametrize("size", [4, 1])
def test_large_footprints_keep_the_gray_level(size):
    page = np.full((2000, 2000), 200)
    made = sheets.flattened(page, np.array([(0, 0), (1000, 0), (2000, 0)]), np.array([(0, 2000), (1000, 2000), (2000, 2000)]), size, size)
    assert made.shape == (size, size) and (np.abs(made - 200) <= 1).all()


def test_a_drawn_page_is_laid_flat():
    x = np.arange(300)
    wave = 8 * np.sin(np.pi * x / 300)
    page = np.full((240, 300), 250)
    for base in range(30, 210, 20):
        for i in x:
            page[int(round(base + wave[i])) : int(round(base + wave[i])) + 4, i] = 20
    curve = lambda y: np.stack((x[::10], y + wave[::10]), axis=1)
    flat = sheets.flattened(page, curve(30), curve(190), 200, 300, above=0.1, below=0.15)
    contrast = lambda p: (np.diff((p < 128).sum(axis=1).astype(float)) ** 2).sum()
    assert contrast(flat) > 3 * contrast(page)


def test_box_means_are_shares_of_pixels():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (6, 7))
    for _ in range(200):
        left, top = rng.uniform(-2, 7, 2)
        right, bottom = left + rng.uniform(0.2, 5), top + rng.uniform(0.2, 5)
        total = 0.0
        for y in range(-4, 14):
            for x in range(-4, 14):
                share = max(0, min(right, x + 1) - max(left, x)) * max(0, min(bottom, y + 1) - max(top, y))
                total += share * (a[y, x] if 0 <= y < 6 and 0 <= x < 7 else 255)
        got = sheets.box_means(a, *(np.array([v]) for v in (left, right, top, bottom)))[0]
        assert got == pytest.approx(total / ((right - left) * (bottom - top)))


def test_affine_resampling_by_area():
    a = np.arange(64).reshape(8, 8) * 3
    assert (sheets.resampled(a, [[1, 0, 0], [0, 1, 0]], 8, 8) == a).all()
    assert sheets.resampled(a, [[2, 0, 0], [0, 2, 0]], 4, 4).tolist() == np.floor(a.reshape(4, 2, 4, 2).mean(axis=(1, 3)) + 0.5).astype(int).tolist()
    assert (sheets.resampled(a, [[0, -1, 8], [1, 0, 0]], 8, 8) == np.rot90(a)).all()
    assert (sheets.resampled(a, [[1, 0, 20], [0, 1, 20]], 2, 2) == 255).all()


def lines_of(seed, wrong=()):
    """Lines of a page that sinks to one side, with ragged right ends; some are wrong."""
    rng = np.random.default_rng(seed)
    out = []
    for n, y in enumerate(range(100, 1000, 60)):
        x = np.linspace(60 + 0.02 * y, 800 if n % 4 else 500, 40)
        wave = 25 * np.sin(x / 260) * (1 - y / 2000)
        out.append(np.stack((x, y + wave + rng.normal(0, 0.3, len(x)) + (30 * np.sin(x / 60) if n in wrong else 0)), axis=1))
    return out


def test_the_best_two_lines_make_all_level():
    lines = lines_of(1, wrong=(0, 7))
    top, bottom = sheets.model(lines)
    sheet = sheets.Sheet(top, bottom)
    spread = [np.std(sheet.to_flat(*line.T)[1]) * (bottom[:, 1].mean() - top[:, 1].mean()) for line in lines]
    assert all(s < 2.5 for i, s in enumerate(spread) if i not in (0, 7)) and min(spread[0], spread[7]) > 10
    assert bottom[:, 1].mean() - top[:, 1].mean() > 500
    # Both curves reach from side to side.
    assert abs(top[0, 0] - (60 + 0.02 * top[0, 1])) < 8 and abs(top[-1, 0] - 800) < 8 and abs(bottom[-1, 0] - 800) < 8


def test_sides_leave_few_ends_outside():
    y = np.arange(0, 1000, 50.0)
    ends = np.stack((100 + 0.05 * y, y), axis=1)
    ends[::5, 0] += 80  # indented
    slope, start = sheets.side(ends, True, 5)
    assert slope == pytest.approx(0.05, abs=1e-6) and start == pytest.approx(100, abs=1e-6)
    ends[3, 0] = 20  # one that sticks out
    assert sheets.side(ends, True, 5)[0] == pytest.approx(0.05, abs=1e-6)
    assert sheets.side(np.array([(7.0, 3.0)]), True, 5) == (0.0, 7.0) and sheets.side(np.array([(7.0, 3.0), (9.0, 3.0)]), False, 5) == (0.0, 9.0)


def test_lines_are_cut_or_drawn_to_the_sides():
    line = np.stack((np.linspace(10, 90, 17), np.linspace(5, 13, 17)), axis=1)
    made = sheets.drawn_to(line, (0, 0), (0, 100))
    assert np.allclose(made[[0, -1]], [(0, 4), (100, 14)])
    cut = sheets.drawn_to(line, (0, 20), (0, 80))
    assert cut[:, 0].min() >= 20 and cut[:, 0].max() <= 80


def test_pages_without_lines_stay():
    page = np.full((30, 40), 200)
    assert sheets.model([]) is None and (sheets.modelled(page, []) == page).all()
    one = np.array([(0.0, 5.0), (39.0, 5.0)])
    assert sheets.model([one]) is None and (sheets.modelled(page, [one, one + (0, 0.2)]) == page).all()


def test_a_page_is_laid_flat_by_its_lines():
    from leafmill.operators import layout, snakes

    rng = np.random.default_rng(2)
    x = np.arange(500)
    bend = lambda y: 14 * np.sin(x / 150) * (1 - y / 900)
    page = np.full((420, 500), 245)
    for y in range(40, 390, 30):
        for i in range(20, 470):
            if i % 9 < 6:
                top = int(round(y + bend(y)[i]))
                page[top : top + 9, i] = np.where(rng.random(9) < 0.8, 15, 245)
    black = (page < 128).astype(int)
    lines = snakes.refined_lines(page, layout.text_lines(black, 10, 200), 9)
    flat = sheets.modelled(page, lines)
    contrast = lambda p: (np.diff((p < 128).sum(axis=1).astype(float)) ** 2).sum()
    assert contrast(flat) > 3 * contrast(page)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("MapInArrow")


def test_local_statistics_shuffle_once_an_axis(spark, small):
    from leafmill.plans import page_queries, raster_queries

    assert exchanges(raster_queries.reg.queries["local_mean_and_deviation"](spark, small))[0] <= 3  # with the one that makes pixels of vectors, if any
    before = exchanges(raster_queries.reg.queries["binarize_sauvola"](spark, small))[0]
    assert before <= 3
    made = page_queries.reg.queries["processed_pages"](spark, small)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 2 and plan.count("MapInArrow") <= 2  # both read what one kernel has kept
    assert made.count() > 0
