"""Colour segments, tone tiles and the kernels under them, against loops over pixels and drawn pages."""

import collections
import time

import numpy as np
import pytest

from leafmill.operators import kernels as k, segments


def flood(black, connectivity):
    out, n = np.zeros(black.shape, int), 0
    for y, x in zip(*np.nonzero(black), strict=True):
        if out[y, x]:
            continue
        n += 1
        out[y, x], todo = n, [(y, x)]
        while todo:
            cy, cx = todo.pop()
            for dy, dx in k.neighbours(connectivity):
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < black.shape[0] and 0 <= nx < black.shape[1] and black[ny, nx] and not out[ny, nx]:
                    out[ny, nx] = n
                    todo.append((ny, nx))
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_are_those_of_a_flood(connectivity):
    rng = np.random.default_rng(1)
    for n in range(150):
        black = (rng.random(rng.integers(1, 14, 2)) < rng.random()).astype(int)
        assert (k.components(black, connectivity) == flood(black, connectivity)).all(), n
    assert k.components(np.zeros((0, 5), int)).shape == (0, 5)


def test_reconstruction_rests_where_steps_rest():
    rng = np.random.default_rng(2)
    for connectivity in (4, 8):
        for _ in range(40):
            mask = rng.integers(0, 256, rng.integers(1, 12, 2))
            seed = np.where(rng.random(mask.shape) < 0.2, mask, 255)
            now = np.maximum(seed, mask)
            while True:
                nxt = now
                for dy, dx in k.neighbours(connectivity):
                    nxt = np.minimum(nxt, k.shifted(now, dy, dx, 255))
                nxt = np.maximum(nxt, mask)
                if (nxt == now).all():
                    break
                now = nxt
            assert (k.gray_reconstruct(seed, mask, connectivity) == now).all()


def a4(rng):
    page = np.full((3508, 2480), 240)
    for y in range(200, 3300, 60):
        for x in range(200, 2280, 30):
            if rng.random() < 0.85:
                page[y : y + 36, x : x + 22] = np.kron(rng.integers(0, 2, (6, 4)), np.ones((6, 6)))[:, :22] * 200 + 20
    page[1000:1800, 600:1600] = rng.integers(40, 200, (800, 1000))
    return page


def test_kernels_of_a_page_of_real_size():
    from leafmill.operators import layout

    page = a4(np.random.default_rng(3))
    black = (page < 128).astype(int)
    half = page[::4, ::4]
    for name, run in (
        ("rectangles", lambda: layout.rectangles(black)), ("text_lines", lambda: layout.text_lines(black, 12, 200)), ("text_mask", lambda: layout.text_mask(black, 12)), ("vertical_lines", lambda: layout.vertical_lines(half, 3)), ("picture_mask", lambda: layout.picture_mask(page)),
        ("components", lambda: k.components(black)), ("reconstruct", lambda: k.gray_reconstruct(np.where(np.arange(2480) < 700, page, 255), page))):
        began = time.process_time()
        run()
        took = time.process_time() - began
        assert took < 5, (name, took)


def brute_segments(colour, ink, noise):
    h, w = ink.shape
    code = np.zeros((h, w), int)
    for i in range(3):
        channel = [int(colour[y, x, i]) if ink[y, x] else 255 for y in range(h) for x in range(w)]
        best, cuts = -1.0, [0]
        for t in range(256):
            low, high = [v for v in channel if v <= t], [v for v in channel if v > t]
            if low and high:
                var = (np.mean(low) - np.mean(high)) ** 2 * len(low) * len(high)
                if var > best * (1 + 1e-12):
                    best, cuts = var, [t]
                elif abs(var - best) <= 1e-12 * best:
                    cuts.append(t)
        cut = min(255, max(1, (cuts[0] + cuts[-1] + 2) // 2 if best >= 0 else 0))
        code += np.array([v < cut for v in channel]).reshape(h, w) << i
    label, n = np.zeros((h, w), int), 0
    for mask in segments.MASKS:
        own = flood(code == mask, 8)
        label[own > 0] = own[own > 0] + n
        n += own.max()
    kept = 0
    out = np.zeros((h, w), int)
    for i in range(1, n + 1):
        y, x = np.nonzero(label == i)
        if len(y) > round(noise ** 2**0.5) and len(y) / max(np.ptp(y) + 1, np.ptp(x) + 1) > 1.5:
            kept += 1
            out[label == i] = kept
    return out, kept


def test_segments_of_drawn_colours():
    colour = np.full((60, 90, 3), 255)
    ink = np.zeros((60, 90), int)
    for i, (r, g, b) in enumerate([(10, 10, 10), (220, 20, 30), (30, 200, 40), (20, 30, 210)]):
        colour[5:25, 5 + 20 * i : 20 + 20 * i] = r, g, b
        ink[5:25, 5 + 20 * i : 20 + 20 * i] = 1
    colour[40:42, 10:12] = 200, 30, 30  # a speck, far from all others
    ink[40:42, 10:12] = 1
    colour[25:27, 30:32] = 10, 10, 10  # one that touches the red block
    ink[25:27, 30:32] = 1
    label = segments.segments(colour, ink)
    assert [len(np.unique(label[5:25, 5 + 20 * i : 20 + 20 * i])) for i in range(4)] == [1] * 4 and label.max() == 5
    assert (label[25:27, 30:32] == label[10, 30]).all() and (label[40:42, 10:12] == 5).all() and (label[ink == 0] == 0).all()
    mean = segments.segment_colours(colour, ink)
    assert mean[40, 10].tolist() == [200, 30, 30] and mean[10, 70].tolist() == [20, 30, 210] and mean[0, 0].tolist() == [255] * 3
    red = colour[label == label[10, 30]]
    assert mean[10, 30].tolist() == [int(v + 0.5) for v in red.mean(axis=0)]


def test_segments_before_they_grow_are_those_of_loops():
    rng = np.random.default_rng(4)
    for _ in range(25):
        colour = np.kron(rng.integers(0, 2, (5, 6, 3)), np.ones((3, 3, 1), int)) * rng.integers(150, 250) + rng.integers(0, 5)
        ink = np.kron(rng.integers(0, 4, (5, 6)) > 0, np.ones((3, 3))).astype(int)
        want, kept = brute_segments(colour, ink, 2)
        got = segments.segments(colour, ink, noise=2)
        assert (got[want > 0] == want[want > 0]).all() and (got > 0).tolist() == (ink > 0).tolist()
        # What hangs together with a segment belongs to one of the kept, the rest to components of its own.
        whole = flood(ink, 8)
        reached = np.isin(whole, np.unique(whole[want > 0]))
        assert (got[reached & (ink > 0)] <= kept).all() and (got[~reached & (ink > 0)] > kept).all()


def test_labels_spread_through_ink_only():
    ink = np.array([[1, 1, 1, 0, 1], [0, 0, 1, 0, 1], [1, 1, 1, 0, 1]])
    label = np.zeros((3, 5), int)
    label[0, 0], label[2, 0] = 2, 1
    assert segments.spread(label, ink).tolist() == [[2, 2, 2, 0, 0], [0, 0, 1, 0, 0], [1, 1, 1, 0, 0]]


def by_loops(a):
    """Measures of one tile, pixel by pixel."""
    h, w = a.shape
    levels, blurred, total, middle, edges, halo = [0] * 16, [0] * 16, 0, 0, 0, 0
    for y in range(1, h - 1, 2):
        for x in range(1, w - 1, 2):
            v = int(a[y, x])
            steep = abs(v - int(a[y, x + 1])) + abs(v - int(a[y + 1, x]))
            levels[min(15, v // 16)] += 1
            total += 1
            middle += 40 < v < 216
            halo += 40 < v < 216 and steep > 55
            edges += steep > 70
    means = []
    for y in range(0, h - 7, 8):
        for x in range(0, w - 7, 8):
            means.append(sum(int(a[y + i, x + j]) for i in range(0, 8, 2) for j in range(0, 8, 2)) // 16)
            blurred[min(15, means[-1] // 16)] += 1
    e = lambda n: -sum(c / sum(n) * np.log2(c / sum(n)) for c in n if c) / 4
    return middle / total, e(levels), e(blurred), edges / total, halo / middle if middle else 0, np.var(means) / 255**2, sum(c >= max(2, len(means) // 200) for c in blurred)


def test_tone_tiles_are_those_of_loops():
    rng = np.random.default_rng(5)
    page = rng.integers(0, 256, (211, 163))
    page[60:150, 40:120] = (np.add.outer(np.arange(90), np.arange(80)) * 1.5).astype(int)
    tiles = segments.tone_tiles(page)
    assert len(tiles) == 81 and segments.tone_tiles(page[:99]) == []
    for gy, gx, top, left, height, width, *found in tiles[::7]:
        assert (top, left, height, width) == (8 + gy * 19, 6 + gx * 13, 40, 40)
        assert found[:7] == pytest.approx(by_loops(page[top : top + height, left : left + width]))


def test_photographs_have_continuous_tones_and_text_has_none():
    rng = np.random.default_rng(6)
    page = np.full((600, 500), 250)
    for y in range(40, 560, 14):
        page[y : y + 6, 30:470] = np.where(rng.random((6, 440)) < 0.4, 10, 250)
    flags = lambda p: np.array([t[-1] for t in segments.tone_tiles(p)]).reshape(9, 9)
    assert not flags(page).any() and segments.tone_regions(flags(page)) == []
    y, x = np.mgrid[0:300, 0:260]
    page[40:340, 30:290] = np.clip(128 + 110 * np.sin(x / 40) * np.cos(y / 50) + rng.normal(0, 6, x.shape), 0, 255)
    found = flags(page)
    region = max(segments.tone_regions(found), key=lambda r: r[1])
    assert region[1] > 3 and region[2] > region[1] and not found[7:].any() and not found[:, 7:].any()


def test_regions_of_flags():
    flags = np.array([[1, 1, 0], [0, 0, 0], [0, 1, 1]])
    assert segments.tone_regions(flags) == [(1, 2, 6), (2, 2, 6)]
    assert segments.tone_regions(np.eye(3, dtype=int)) == [(1, 1, 4), (2, 1, 4), (3, 1, 4)]


def test_segment_queries(spark, small):
    from leafmill.plans import layout_queries

    pages = {r.page_id: np.array(r.rgb).reshape(r.height, r.width) for r in layout_queries.packed_colours(spark, small).limit(40).collect()}
    got = collections.defaultdict(dict)
    for r in layout_queries.reg.queries["colour_segments"](spark, small).where(f"page_id in ({', '.join(map(str, pages))})").collect():
        got[r.page_id][r.y, r.x] = r.segment, r.mean
    for page_id, rgb in pages.items():
        colour, ink = layout_queries.unpacked(rgb)
        want, _ = brute_segments(colour, ink, 1)
        assert set(got[page_id]) == {(int(y), int(x)) for y, x in zip(*np.nonzero(ink), strict=True)}
        assert all(got[page_id][y, x][0] == want[y, x] for y, x in zip(*map(lambda i: i.tolist(), np.nonzero(want)), strict=True))
    tiles = layout_queries.reg.queries["tone_tiles"](spark, small)
    assert tiles.count() % 81 == 0 and tiles.columns == ["page_id", *segments.TILE_COLUMNS]


def test_rectangles_are_those_merged_one_by_one():
    from leafmill.operators import layout

    rng = np.random.default_rng(8)
    for _ in range(60):
        mask = (rng.random((14, 17)) < rng.uniform(0.02, 0.3)).astype(int)
        boxes = [tuple(int(v) for v in b) for b in k.component_boxes(k.components(mask))]
        again = True
        while again:
            again = False
            for i, a in enumerate(boxes):
                for j, b in enumerate(boxes):
                    if i < j and a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
                        boxes = [c for n, c in enumerate(boxes) if n not in (i, j)] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))]
                        again = True
                        break
                if again:
                    break
        assert layout.rectangles(mask) == sorted((a, b, c - a, d - b) for a, b, c, d in boxes)
