"""What is where on a page: pictures, shadows, whitespace, lines, and pages bent back, on numpy arrays."""

from __future__ import annotations

import heapq
import itertools

import numpy as np

from leafmill.operators import kernels as k


def box_extreme(a: np.ndarray, height: int, width: int, darkest: bool) -> np.ndarray:
    """Least or greatest value in a box around each pixel, as far as it is on the page; one axis after the other."""
    f, beyond = (np.minimum, np.iinfo(np.int64).max) if darkest else (np.maximum, np.iinfo(np.int64).min)
    out = a.astype(np.int64)
    for axis, size in ((0, height), (1, width)):
        before, after = size // 2, size - 1 - size // 2
        padded = np.pad(out, [(before, after) if i == axis else (0, 0) for i in (0, 1)], constant_values=beyond)
        # Steps of doubling length: a box of any size takes about log2(size) passes.
        have, now = 1, padded
        while have < size:
            step = min(have, size - have)
            n = now.shape[axis] - step
            now = f(now.take(range(n), axis), now.take(range(step, step + n), axis))
            have += step
        out = now
    return out


def opened(black: np.ndarray, height: int, width: int) -> np.ndarray:
    """Black where a brick of that size fits into the black."""
    inner = box_extreme(black, height, width, darkest=True)
    # The brick turned around, so that an even one doesn't shift the page.
    return box_extreme(inner[::-1, ::-1], height, width, darkest=False)[::-1, ::-1]


def stretched(a: np.ndarray, black_share: float, white_share: float) -> np.ndarray:
    """Tones spread over 0 to 255, with the given shares of pixels clipped at either end."""
    counts = np.bincount(a.ravel(), minlength=256).cumsum()
    low = int(np.searchsorted(counts, round(black_share * a.size), side="right"))
    high = int(np.searchsorted(counts, a.size - round(white_share * a.size), side="left"))
    if high <= low:
        return np.where(a < (low + high) // 2, 0, 255)
    return (255 * (np.clip(a, low, high) - low) + (high - low) // 2) // (high - low)


def picture_map(a: np.ndarray, size: int = 35) -> np.ndarray:
    """How much each pixel is part of a picture, 0 to 255.

    Where tones change, text changes to paper again within a box of that size and pictures
    don't; what is left of the change after such a box has passed is spread over all that is
    connected to it, and holes in that are filled.
    """
    wide = stretched(a, 0.01, 0.01)
    change = 255 - (255 - box_extreme(wide, 3, 3, True)) * box_extreme(wide, 3, 3, False) // 255
    spread = 255 - k.gray_reconstruct(box_extreme(change, size, size, False), change)
    frame = np.full(a.shape, 255, np.int64)
    frame[[0, -1], :] = frame[:, [0, -1]] = 0
    return k.gray_reconstruct(frame, spread)


def picture_mask(a: np.ndarray, size: int = 35, level: int = 48) -> np.ndarray:
    return (picture_map(a, size) >= level).astype(np.int64)


def without_shadows(black: np.ndarray, bricks: tuple[tuple[int, int], ...] = ((14, 200), (300, 14))) -> np.ndarray:
    """Black without the components that bricks of these heights and widths fit into: shadows of the binding and of the scanner's edge."""
    seeds = np.zeros(black.shape, bool)
    for height, width in bricks:
        seeds |= opened(black, height, width) > 0
    label = k.components(black)
    return np.where(np.isin(label, np.unique(label[seeds])) & (label > 0), 0, black)


def whitespaces(black: np.ndarray, min_height: int, min_width: int, count: int, quality=None) -> list[tuple[int, int, int, int]]:
    """The best `count` rectangles (x, y, width, height) without ink, each clear of those before, best first; by area unless quality(width, height) is given.

    The best region is taken from a queue; if it holds an obstacle, the one nearest to its
    middle parts it into four. A region's quality bounds that of its parts, so the first one
    without obstacles is the best.
    """
    quality = quality or (lambda w, h: w * h)
    h, w = black.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = (black > 0).cumsum(axis=0).cumsum(axis=1)
    order, found = itertools.count(), []
    queue = [(-quality(w, h), next(order), (0, 0, w, h))]
    taken: set[tuple[int, int, int, int]] = set()
    while queue and len(found) < count:
        _, _, (x, y, rw, rh) = heapq.heappop(queue)
        pivot, best = None, None
        for ox, oy, ow, oh in found:
            if ox < x + rw and x < ox + ow and oy < y + rh and y < oy + oh:
                far = (2 * ox + ow - 2 * x - rw) ** 2 + (2 * oy + oh - 2 * y - rh) ** 2
                if best is None or far < best:
                    pivot, best = (ox, oy, ox + ow, oy + oh), far
        if pivot is None and total[y + rh, x + rw] - total[y, x + rw] - total[y + rh, x] + total[y, x]:
            ys, xs = np.nonzero(black[y : y + rh, x : x + rw])
            i = int(np.argmin((2 * xs - rw + 1) ** 2 + (2 * ys - rh + 1) ** 2))
            pivot = (x + int(xs[i]), y + int(ys[i]), x + int(xs[i]) + 1, y + int(ys[i]) + 1)
        if pivot is None:
            found.append((x, y, rw, rh))
            continue
        left, top, right, bottom = pivot
        for part in ((x, y, rw, top - y), (x, bottom, rw, y + rh - bottom), (x, y, left - x, rh), (right, y, x + rw - right, rh)):
            if part[2] >= min_width and part[3] >= min_height and part not in taken:
                taken.add(part)
                heapq.heappush(queue, (-quality(part[2], part[3]), next(order), part))
    return found


def rectangles(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, width, height) around the components of a mask, those that overlap or touch made one, until none do."""
    boxes = k.component_boxes(k.components(mask))
    while len(boxes) > 1:
        left, top, right, bottom = boxes.T
        pairs = []
        for at in range(0, len(boxes), 512):
            own = slice(at, at + 512)
            meet = (left[own, None] <= right) & (left <= right[own, None]) & (top[own, None] <= bottom) & (top <= bottom[own, None])
            a, b = np.nonzero(meet)
            pairs.append(np.stack((a + at, b))[:, a + at < b])
        a, b = np.concatenate(pairs, axis=1)
        if not len(a):
            break
        root = k.joined(len(boxes), a, b)
        low, high = boxes.copy(), boxes.copy()
        np.minimum.at(low, root, boxes)
        np.maximum.at(high, root, boxes)
        boxes = np.concatenate((low[:, :2], high[:, 2:]), axis=1)[np.unique(root)]
    return sorted((int(a), int(b), int(c - a), int(d - b)) for a, b, c, d in boxes)


def oblique_angle(black: np.ndarray, limit: float = 10.0) -> float:
    """Lean of upright strokes in degrees: the angle whose horizontal shear makes column counts differ most, to a tenth."""
    return k.skew_angle(black.T, limit)


def vertical_lines(a: np.ndarray, count: int = 3, lean: float = 10.0) -> list[tuple[float, float]]:
    """Where near-upright dark lines cross the top and the bottom of a page, the strongest first."""
    dark = np.maximum(0, np.minimum(np.roll(a, 2, axis=1), np.roll(a, -2, axis=1)) - a).astype(float)
    dark[:, :2] = dark[:, -2:] = 0
    h, w = a.shape
    shifts = np.arange(-int(np.tan(np.radians(lean)) * h), int(np.tan(np.radians(lean)) * h) + 1)
    votes = np.zeros((len(shifts), w))
    y, x = np.nonzero(dark)
    tone = dark[y, x]
    for i, shift in enumerate(shifts):  # a line from (x, top) to (x + shift, bottom)
        at = x - np.floor(y * shift / max(1, h - 1) + 0.5).astype(int)
        inside = (at >= 0) & (at < w)
        votes[i] = np.bincount(at[inside], tone[inside], w)
    found: list[tuple[float, float]] = []
    while len(found) < count and votes.max() > 0:
        i, x = np.unravel_index(int(np.argmax(votes)), votes.shape)
        found.append((float(x), float(x + shifts[i])))
        middle = np.arange(w)[None, :] + shifts[:, None] / 2
        votes[np.abs(middle - (x + shifts[i] / 2)) < 8] = 0
    return found


def spine_split(a: np.ndarray) -> float | None:
    """Where an upright line near the middle parts a page in two; None without one."""
    w = a.shape[1]
    for top, bottom in vertical_lines(a, 5):
        if abs((top + bottom) / 2 - w / 2) < w / 6:
            return (top + bottom) / 2
    return None


def polynomial_line(values: np.ndarray, degree: int) -> np.ndarray:
    """Least-squares polynomial through values at even steps from 0 to 1: its coefficients, lowest first."""
    x = np.linspace(0, 1, len(values)) if len(values) > 1 else np.zeros(len(values))
    return np.linalg.lstsq(x[:, None] ** np.arange(degree + 1), values, rcond=None)[0]


def ransac_line(points: np.ndarray, tolerance: float, rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(a, b, c) of the line ax + by = c, a unit normal, that most points are near, fitted to those; and which they are."""
    rng = np.random.default_rng(seed)
    best = np.zeros(len(points), bool)
    for _ in range(rounds if len(points) > 1 else 0):
        i, j = rng.choice(len(points), 2, replace=False)
        along = points[j] - points[i]
        size = np.hypot(*along)
        if size:
            near = np.abs((points - points[i]) @ (np.array([-along[1], along[0]]) / size)) <= tolerance
            if near.sum() > best.sum():
                best = near
    middle = points[best].mean(axis=0) if best.any() else np.zeros(2)
    _, _, axes = np.linalg.svd(points[best] - middle) if best.any() else (0, 0, np.eye(2))
    return np.append(axes[1], axes[1] @ middle), best


def best_lines(points: np.ndarray, tolerance: float, count: int, least: int = 3, fine: float = 1e-3) -> list[tuple[float, float, int]]:
    """(angle, distance, points near it) of the lines x cos(angle) + y sin(angle) = distance that most points are within tolerance of, each with points of its own.

    Ranges of angle and distance are halved, best first: how many points could be near some line
    of a range bounds what its halves reach, so the first range that is fine enough is the best.
    """
    left = np.asarray(points, float).reshape(-1, 2)
    found: list[tuple[float, float, int]] = []
    while len(found) < count and len(left) >= least:
        r, phase = np.hypot(left[:, 0], left[:, 1]), np.arctan2(left[:, 1], left[:, 0])
        far = float(r.max()) + tolerance
        order = itertools.count()

        def reached(a0: float, a1: float, d0: float, d1: float) -> np.ndarray:
            ends = np.stack((r * np.cos(a0 - phase), r * np.cos(a1 - phase)))
            low, high = ends.min(axis=0), ends.max(axis=0)
            # Where the angle passes a point's own direction, or its opposite, the projection is longest.
            turns = lambda at: np.floor((a1 - at) / (2 * np.pi)) > np.floor((a0 - at) / (2 * np.pi))
            high, low = np.where(turns(phase), r, high), np.where(turns(phase + np.pi), -r, low)
            return (low <= d1 + tolerance) & (high >= d0 - tolerance)

        queue = [(-len(left), next(order), (0.0, np.pi, -far, far))]
        best = None
        while queue:
            bound, _, (a0, a1, d0, d1) = heapq.heappop(queue)
            if -bound < least:
                break
            if a1 - a0 <= fine and d1 - d0 <= max(fine, tolerance / 8):
                best = ((a0 + a1) / 2, (d0 + d1) / 2, -bound, reached(a0, a1, d0, d1))
                break
            # The side that moves points more is halved.
            if (a1 - a0) * far >= d1 - d0 and a1 - a0 > fine:
                parts = ((a0, (a0 + a1) / 2, d0, d1), ((a0 + a1) / 2, a1, d0, d1))
            else:
                parts = ((a0, a1, d0, (d0 + d1) / 2), (a0, a1, (d0 + d1) / 2, d1))
            for part in parts:
                n = int(reached(*part).sum())
                if n >= least:
                    heapq.heappush(queue, (-n, next(order), part))
        if best is None:
            break
        found.append((float(best[0]), float(best[1]), int(best[2])))
        left = left[~best[3]]
    return found


def cheapest_path(cost: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> tuple[float, list[tuple[int, int]]]:
    """Cost and pixels of the cheapest way between two pixels over the eight neighbours; a step costs what it enters, times its length."""
    best, came, queue = {start: 0.0}, {}, [(0.0, start)]
    while queue:
        far, at = heapq.heappop(queue)
        if at == end:
            break
        if far > best[at]:
            continue
        for dy, dx in k.neighbours(8):
            y, x = at[0] + dy, at[1] + dx
            if 0 <= y < cost.shape[0] and 0 <= x < cost.shape[1]:
                new = far + float(cost[y, x]) * (2**0.5 if dy and dx else 1.0)
                if new < best.get((y, x), float("inf")):
                    best[y, x], came[y, x] = new, at
                    heapq.heappush(queue, (new, (y, x)))
    path = [end]
    while path[-1] != start:
        path.append(came[path[-1]])
    return best[end], path[::-1]


def along(curve: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Points of a polyline at shares of its length."""
    steps = np.hypot(*np.diff(curve, axis=0).T)
    length = np.concatenate(([0], np.cumsum(steps)))
    return np.stack([np.interp(np.asarray(at) * length[-1], length, curve[:, i]) for i in (0, 1)], axis=-1)


def dewarped(a: np.ndarray, top: np.ndarray, bottom: np.ndarray, height: int, width: int, outside: int = 255, above: float = 0.0, below: float = 0.0) -> np.ndarray:
    """The page between two curves of (x, y) points, made straight.

    The page is taken as a bent sheet: straight lines join points of both curves, at depths that
    the four corners' perspective gives, and equal lengths along the curves come out equal. above
    and below add to the sheet, as shares of the distance between the curves.
    """
    share = (np.arange(width) + 0.5) / width
    upper, lower = along(np.asarray(top, float), share), along(np.asarray(bottom, float), share)
    corners = np.array([top[0], top[-1], bottom[-1], bottom[0]], float)
    flat = k.homography(np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float), corners)
    # How far down a straight line the share v of the sheet lies: as on the corners' plane.
    v = (np.arange(height) + 0.5) / height * (1 + above + below) - above
    depth = flat[2, 0] * share[None, :] + flat[2, 2]
    down = v[:, None] * (depth + flat[2, 1]) / (depth + flat[2, 1] * v[:, None])
    x = upper[None, :, 0] + down * (lower - upper)[None, :, 0] - 0.5
    y = upper[None, :, 1] + down * (lower - upper)[None, :, 1] - 0.5
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)

    def read(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        inside = (yy >= 0) & (yy < a.shape[0]) & (xx >= 0) & (xx < a.shape[1])
        return np.where(inside, a[np.clip(yy, 0, a.shape[0] - 1), np.clip(xx, 0, a.shape[1] - 1)], outside)

    fx, fy = x - x0, y - y0
    made = (read(y0, x0) * (1 - fx) + read(y0, x0 + 1) * fx) * (1 - fy) + (read(y0 + 1, x0) * (1 - fx) + read(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.floor(made + 0.5), 0, 255).astype(np.int64)


def text_lines(black: np.ndarray, gap: int, least_width: int, degree: int = 4) -> list[np.ndarray]:
    """Middle lines of lines of text as (x, y) points, from the top down.

    Letters within a gap of one another run together along rows; of each run at least so wide,
    a polynomial goes through the middles of its columns, so that ascenders and single
    letters don't bend it.
    """
    # Closed along rows: what is at most a gap apart runs together, without growing at the ends.
    smeared = box_extreme(box_extreme(black, 1, gap, darkest=False), 1, gap + 1 - gap % 2, darkest=True) | (black > 0)
    label, found = k.components(smeared), []
    y, x = np.nonzero(label)
    order = np.argsort(label[y, x], kind="stable")
    y, x = y[order], x[order]
    cut = np.searchsorted(label[y, x], np.arange(1, int(label.max(initial=0)) + 2))
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        own = slice(i, j)
        left, right = int(x[own].min()), int(x[own].max())
        if right - left + 1 < least_width:
            continue
        n = np.bincount(x[own] - left)
        middle = np.bincount(x[own] - left, y[own]) / np.maximum(n, 1)
        middle = np.interp(np.arange(len(n)), np.flatnonzero(n), middle[n > 0])
        weights = polynomial_line(middle, min(degree, len(middle) - 1))
        at = np.linspace(0, 1, 33)
        found.append(np.stack((left + at * (right - left), (at[:, None] ** np.arange(len(weights))) @ weights), axis=1))
    return sorted(found, key=lambda line: line[:, 1].mean())


def bent_between(lines: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The top and the bottom one of a page's lines that reach over most of its width, drawn out to both edges; None with fewer than two."""
    wide = [line for line in lines if line[-1, 0] - line[0, 0] >= 0.5 * width]
    if len(wide) < 2:
        return None

    def drawn_out(line: np.ndarray) -> np.ndarray:
        first, last = line[0], line[-1]
        at_left, at_right = (line[1] - first) / max(1e-9, line[1, 0] - first[0]), (last - line[-2]) / max(1e-9, last[0] - line[-2, 0])
        return np.concatenate(([first - at_left * first[0]], line, [last + at_right * (width - last[0])]))

    return drawn_out(wide[0]), drawn_out(wide[-1])


def straightened(a: np.ndarray, black: np.ndarray, gap: int, least_width: int) -> np.ndarray:
    """A page bent back by its own lines of text; as it is without two long ones."""
    curves = bent_between(text_lines(black, gap, least_width), a.shape[1])
    if curves is None:
        return a
    top, bottom = curves
    apart = bottom[:, 1].mean() - top[:, 1].mean()
    if apart < 1:
        return a
    return dewarped(a, top, bottom, *a.shape, above=top[:, 1].mean() / apart, below=(a.shape[0] - bottom[:, 1].mean()) / apart)


def text_mask(black: np.ndarray, gap: int, least: float = 1.5) -> np.ndarray:
    """Ink in runs of letters that are at least that many times as wide as high."""
    smeared = box_extreme(black, 1, gap, darkest=False)
    label = k.components(smeared)
    n = int(label.max(initial=0))
    left, top, right, bottom = k.component_boxes(label).T
    keep = np.zeros(n + 1, bool)
    keep[1:] = right - left >= least * (bottom - top)
    return ((black > 0) & keep[label]).astype(np.int64)


#: Weights of luma, and scales of the colour differences.
LUMA, BLUE_SCALE, RED_SCALE = (0.299, 0.587, 0.114), 0.564, 0.713


def chroma_denoised(colour: np.ndarray, radius: float, gray_limit: float) -> np.ndarray:
    """Colours (height, width, 3) with their colour differences blurred; weak ones, under the limit, become gray, and up to twice it they pass in part."""
    rgb = colour.astype(float)
    luma = rgb @ np.array(LUMA)
    blue, red = (np.clip(np.floor(128 + s * (rgb[:, :, c] - luma) + 0.5), 0, 255) for c, s in ((2, BLUE_SCALE), (0, RED_SCALE)))
    blue, red = (np.clip(np.floor(k.blur(d, radius, radius) + 0.5), 0, 255) - 128 for d in (blue, red))
    if gray_limit > 0:
        keep = np.clip((np.hypot(blue, red) - gray_limit) / gray_limit, 0, 1)
        blue, red = blue * keep, red * keep
    r, b = luma + red / RED_SCALE, luma + blue / BLUE_SCALE
    g = (luma - LUMA[0] * r - LUMA[2] * b) / LUMA[1]
    return np.clip(np.floor(np.stack((r, g, b), axis=2) + 0.5), 0, 255).astype(np.int64)


def add_component(label: np.ndarray, black: np.ndarray) -> np.ndarray:
    """Labels with the black pixels as one more component, over what was there."""
    return np.where(black > 0, int(label.max(initial=0)) + 1, label) if (black > 0).any() else label


def page_box(black: np.ndarray) -> tuple[int, int, int, int] | None:
    """Box (left, top, right, bottom) of the ink that no dark border touches: components that reach the scan's edge are left out."""
    label = k.components(black)
    border = np.unique(np.concatenate((label[0], label[-1], label[:, 0], label[:, -1])))
    y, x = np.nonzero((label > 0) & ~np.isin(label, border))
    return (int(x.min()), int(y.min()), int(x.max()), int(y.max())) if len(y) else None


def trimmed_box(black: np.ndarray, box: tuple[int, int, int, int], least: float = 0.02, gap: int = 3) -> tuple[int, int, int, int]:
    """A content box (left, top, right, bottom) without outer strips that hold under that share of its ink and that a gap of blank lines parts from the rest; again until none goes."""
    left, top, right, bottom = box
    while True:
        part = black[top : bottom + 1, left : right + 1] > 0
        before = (left, top, right, bottom)
        for axis in (0, 1):
            lines = part.sum(axis=1 - axis)
            inked = np.flatnonzero(lines)
            breaks = np.flatnonzero(np.diff(inked) > gap)
            if not len(breaks):
                continue
            first, last = breaks[0], breaks[-1]
            if lines[: inked[first] + 1].sum() < least * part.sum():
                left, top = (left, top + int(inked[first + 1])) if axis == 0 else (left + int(inked[first + 1]), top)
                break
            if lines[inked[last + 1] :].sum() < least * part.sum():
                right, bottom = (right, top + int(inked[last])) if axis == 0 else (left + int(inked[last]), bottom)
                break
        if before == (left, top, right, bottom):
            return before
