"""Recursive blur against the sum it stands for, and snakes on drawn lines."""

import itertools
import time

import numpy as np
import pytest

from leafmill.operators import blurs, snakes


@pytest.mark.parametrize("sigma", [0.8, 2.0, 5.0, 20.0])
def test_blur_is_near_the_gaussian_sum(sigma):
    rng = np.random.default_rng(0)
    page = rng.integers(0, 256, (60, 45)).astype(float)
    r = int(8 * sigma) + 1
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    padded = np.pad(page, ((0, 0), (r, r)), mode="edge")
    rows = np.stack([padded[:, i : i + 45] * v for i, v in enumerate(w / w.sum())]).sum(axis=0)
    padded = np.pad(rows, ((r, r), (0, 0)), mode="edge")
    want = np.stack([padded[i : i + 60] * v for i, v in enumerate(w / w.sum())]).sum(axis=0)
    assert np.abs(blurs.gauss(page, sigma, sigma) - want).max() < 1.5
    assert np.allclose(blurs.gauss(np.full((9, 7), 88), sigma, sigma), 88) and (blurs.gauss(page, 0, 0) == page).all()
    assert blurs.gauss(page[:1, :1], sigma, sigma) == pytest.approx(page[:1, :1])


def test_blur_is_the_sum_of_its_waves():
    x = np.zeros((41, 1))
    x[20] = 1
    m = np.abs(np.arange(41) - 20) / 3.0
    wave = sum((c * np.cos(f * m) + s * np.sin(f * m)) * np.exp(-d * m) for c, s, d, f in blurs.WAVES)
    m = np.arange(-4000, 4001) / 3.0
    whole = sum((c * np.cos(f * abs(m)) + s * np.sin(f * abs(m))) * np.exp(-d * abs(m)) for c, s, d, f in blurs.WAVES).sum()
    assert np.allclose(blurs.gauss(x, 0, 3)[:, 0], wave / whole, atol=1e-12)


def test_a_wide_blur_costs_what_a_narrow_one_does():
    page = np.random.default_rng(1).random((700, 500))

    def cost(sigma):
        began = time.process_time()
        blurs.gauss(page, sigma, sigma)
        return time.process_time() - began

    cost(2)
    assert min(cost(100) for _ in range(3)) < 2 * min(cost(2) for _ in range(3)) + 0.05


def test_best_moves_are_those_of_all_choices():
    rng = np.random.default_rng(3)
    for _ in range(40):
        gain, bends = rng.normal(size=(5, 3)), rng.normal(size=5)
        step, bend, stretch = 0.5, rng.random(), rng.random()

        def worth(m):
            total = sum(gain[i, v + 1] for i, v in enumerate(m)) - stretch * step**2 * sum((a - b) ** 2 for a, b in itertools.pairwise(m))  # noqa: B023
            return total - bend * sum((bends[i] + step * (m[i - 1] - 2 * m[i] + m[i + 1])) ** 2 for i in range(1, 4))  # noqa: B023

        found = snakes.best_moves(gain, bends, step, bend, stretch)
        assert worth(found) == pytest.approx(max(worth(m) for m in itertools.product((-1, 0, 1), repeat=5)))


def drawn(curves, width=500, height=220, thick=10, seed=4):
    rng = np.random.default_rng(seed)
    page = np.full((height, width), 245.0)
    for curve in curves:
        x = 20
        while x < width - 30:
            letter = int(rng.integers(5, 9))
            for i in range(x, x + letter):
                y = int(round(curve(i) - thick / 2))
                page[y : y + thick, i] = np.where(rng.random(thick) < 0.75, 20, 245)
                page[y, i] = page[y + thick - 1, i] = 20
            x += letter + int(rng.integers(2, 5))
    return page


def test_a_curved_line_is_found_to_a_pixel():
    curves = [lambda x: 60 + 12 * np.sin(x / 90), lambda x: 110 + 12 * np.sin(x / 90), lambda x: 160 + 9 * np.cos(x / 120)]
    page = drawn(curves)
    x = np.linspace(25, 465, 12)
    for shift in (-3, 0, 3):
        lines = [np.stack((x, curve(x) + shift), axis=1) for curve in curves]
        for curve, line in zip(curves, snakes.refined_lines(page, lines, 10), strict=True):
            inner = line[(line[:, 0] > 40) & (line[:, 0] < 450)]
            off = inner[:, 1] - (curve(inner[:, 0]) - 0.5)
            assert len(inner) > 30 and np.abs(off).max() < 1.0, (shift, np.abs(off).max())


def test_a_straight_guess_bends_to_the_line():
    curve = lambda x: 100 + 4 * np.sin(x / 80)
    page = drawn([curve])
    (line,) = snakes.refined_lines(page, [np.array([(25.0, 100.0), (465.0, 100.0)])], 10)
    inner = line[(line[:, 0] > 40) & (line[:, 0] < 450)]
    assert np.abs(inner[:, 1] - (curve(inner[:, 0]) - 0.5)).max() < 1.0


def test_blank_pages_and_lines_without_length_stay():
    blank = np.full((40, 60), 200.0)
    line = np.array([(5.0, 20.0), (50.0, 20.0)])
    (found,) = snakes.refined_lines(blank, [line], 8)
    assert np.allclose(found[:, 1], 20) and np.isfinite(found).all()
    point = np.array([(5.0, 5.0), (5.0, 5.0)])
    assert snakes.refined_lines(blank, [point], 8)[0].tolist() == point.tolist() and snakes.refined_lines(blank, [], 8) == []
