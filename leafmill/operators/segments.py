"""Parts of a page by colour and by tone: coloured segments of its ink, and where it holds continuous tones."""

from __future__ import annotations

import numpy as np

from leafmill.operators import kernels as k

#: Dark channels (1 red, 2 green, 4 blue) of the seven masks, in the order in which their components are numbered.
MASKS = (7, 3, 5, 6, 1, 2, 4)


def dark_channels(colour: np.ndarray, ink: np.ndarray, shifts: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """For each pixel the sum of 1, 2 and 4 for its red, green and blue if they are below their Otsu threshold, moved by the shifts; what is not ink counts as white."""
    out = np.zeros(ink.shape, np.int64)
    for i, shift in enumerate(shifts):
        channel = np.where(ink > 0, colour[:, :, i], 255)
        cut = min(max(k.otsu_level(channel.ravel()) + shift, 1), 255)
        out |= (channel < cut).astype(np.int64) << i
    return out


def spread(label: np.ndarray, ink: np.ndarray) -> np.ndarray:
    """Labels grown over the ink that hangs together with them: each pixel takes the nearest label that reaches it through ink, the smaller one of two as near."""
    h, w = label.shape
    wide = w + 2
    grown, open_ = np.zeros((h + 2, wide), np.int64), np.zeros((h + 2, wide), bool)
    grown[1:-1, 1:-1], open_[1:-1, 1:-1] = label, ink > 0
    grown, open_ = grown.ravel(), open_.ravel()
    far = np.where(grown > 0, 0, np.where(open_, np.int64(1) << 60, -1))
    dy, dx = np.zeros(len(grown), np.int64), np.zeros(len(grown), np.int64)
    edge = np.flatnonzero(grown)
    while len(edge):
        moved = []
        for sy, sx in k.neighbours(8):
            to = edge + sy * wide + sx
            ny, nx = dy[edge] + sy, dx[edge] + sx
            d = ny * ny + nx * nx
            better = (d < far[to]) | ((d == far[to]) & (grown[edge] < grown[to]))
            to = to[better]
            grown[to], far[to], dy[to], dx[to] = grown[edge[better]], d[better], ny[better], nx[better]
            moved.append(to)
        edge = np.unique(np.concatenate(moved))
    return grown.reshape(h + 2, wide)[1:-1, 1:-1]


def segments(colour: np.ndarray, ink: np.ndarray, dpi: float = 300.0, noise: int = 7, shifts: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """Labels 1, 2, ... of the ink's parts of one colour.

    The seven masks of dark channels are cut into components. Those of up to noise ** sqrt(2)
    pixels (at 300 dpi), and those that are a pixel and a half wide at most on average, are
    given to their neighbours; ink that no segment reaches makes segments of its own.
    """
    code, label, count = dark_channels(colour, ink, shifts), np.zeros(ink.shape, np.int64), 0
    for mask in MASKS:
        own = k.components((code == mask).astype(np.int64))
        label = np.where(own > 0, own + count, label)
        count += int(own.max(initial=0))
    y, x = np.nonzero(label)
    size = np.bincount(label[y, x], minlength=count + 1)
    low, high = np.full((2, count + 1), 1 << 40), np.full((2, count + 1), -1)
    for i, at in enumerate((y, x)):
        np.minimum.at(low[i], label[y, x], at)
        np.maximum.at(high[i], label[y, x], at)
    longest = np.maximum(1, (high - low + 1).max(axis=0))
    kept = (size > np.floor(noise ** (2**0.5) * dpi / 300 + 0.5)) & (size / longest > 1.5 * dpi / 300)
    kept[0] = False
    label = spread((np.cumsum(kept) * kept)[label], ink)
    return np.where((ink > 0) & (label == 0), k.components(((ink > 0) & (label == 0)).astype(np.int64)) + int(kept.sum()), label)


def mean_coloured(label: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """Each segment in the mean of its colours, rounded half up; white elsewhere."""
    flat = label.ravel()
    size = np.bincount(flat)
    out = np.full(colour.shape, 255, np.int64)
    for i in range(colour.shape[2]):
        total = np.bincount(flat, colour[:, :, i].ravel()).astype(np.int64)
        mean = (2 * total + size) // np.maximum(2 * size, 1)
        out[:, :, i] = np.where(label > 0, mean[label], 255)
    return out


def segment_colours(colour: np.ndarray, ink: np.ndarray, **options) -> np.ndarray:
    return mean_coloured(segments(colour, ink, **options), colour)


#: Fixed values of the tone measure: tiles along a side, the page's margin in hundredths, and the side of a blurred block.
TILES, MARGIN, BLOCK = 9, 4, 8
TILE_COLUMNS = ("grid_y", "grid_x", "top", "left", "height", "width", "midtones", "entropy", "blurred_entropy", "edges", "halo", "variance", "bins", "line_art", "continuous")


def entropy(levels: np.ndarray) -> float:
    """Of the shares of sixteen levels, in sixteenths of four bits: 0 for one level, 1 for all alike."""
    n = np.bincount(levels, minlength=16)
    p = n[n > 0] / max(1, n.sum())
    return float(-(p * np.log2(p)).sum() / 4) + 0.0


def tone_tile(a: np.ndarray) -> tuple[float, float, float, float, float, float, int, bool, bool]:
    """midtones to continuous of one tile.

    Every second pixel tells shares of midtones and of edges, and how many midtones lie at
    edges. Blocks of 8 by 8, each the mean of every second pixel, tell what is left without
    detail: a photograph still has many levels then, line art has few, or has its midtones at edges.
    """
    h, w = a.shape
    inner = a[1 : h - 1 : 2, 1 : w - 1 : 2]
    below, right = a[2:h:2, 1 : w - 1 : 2], a[1 : h - 1 : 2, 2:w:2]
    steep = np.abs(inner - right) + np.abs(inner - below)
    middle = (inner > 40) & (inner < 216)
    n = max(1, inner.size)
    rows, columns = h // BLOCK, w // BLOCK
    cut = a[: rows * BLOCK, : columns * BLOCK].reshape(rows, BLOCK, columns, BLOCK)[:, ::2, :, ::2]
    blocks = cut.sum(axis=(1, 3)).ravel() // 16
    midtones, edges = middle.sum() / n, (steep > 70).sum() / n
    halo = (steep[middle] > 55).sum() / max(1, middle.sum())
    levels = np.bincount(np.minimum(blocks // 16, 15), minlength=16)
    bins = int((levels >= max(2, blocks.size // 200)).sum())
    variance = float(max(0.0, blocks.astype(float).var()) / 255**2) if blocks.size else 0.0
    tones, blurred = entropy(np.minimum(inner.ravel() // 16, 15)), entropy(np.minimum(blocks // 16, 15))
    line_art = bins < 7 or blurred < 0.55 or variance < 0.012 or midtones > 0.76 or (edges > 0.18 and halo > 0.30)
    return float(midtones), tones, blurred, float(edges), float(halo), variance, bins, bool(line_art), bool(midtones >= 0.05 and tones >= 0.62 and not line_art)


def tone_tiles(a: np.ndarray) -> list[tuple]:
    """TILE_COLUMNS of the 81 overlapping tiles of a page, a fifth of it each; none for a page with a side under 100."""
    h, w = a.shape
    if min(h, w) < 100:
        return []
    margin = [max(2, n * MARGIN // 100) for n in (h, w)]
    inside = [n - 2 * m for n, m in zip((h, w), margin, strict=True)]
    tile = [max(40, n // 5) for n in inside]
    step = [max(1, (n - t) // (TILES - 1)) for n, t in zip(inside, tile, strict=True)]
    out = []
    for gy in range(TILES):
        for gx in range(TILES):
            top, left = margin[0] + gy * step[0], margin[1] + gx * step[1]
            height, width = min(tile[0], h - margin[0] - top), min(tile[1], w - margin[1] - left)
            out.append((gy, gx, top, left, height, width, *tone_tile(a[top : top + height, left : left + width])))
    return out


def tone_regions(flags: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, tiles, cells) of the regions of touching tiles with continuous tone; tiles overlap by half, so each covers two by two cells of a grid one larger."""
    label = k.components(flags.astype(np.int64), 4)
    out = []
    for i in range(1, int(label.max(initial=0)) + 1):
        covered = np.zeros((flags.shape[0] + 1, flags.shape[1] + 1), bool)
        y, x = np.nonzero(label == i)
        for dy in (0, 1):
            for dx in (0, 1):
                covered[y + dy, x + dx] = True
        out.append((i, len(y), int(covered.sum())))
    return out
