"""Bent sheets: a page whose lines are curves in the scan, seen as part of a cylinder and laid flat.

Two curves, the images of two lines of the page, span the sheet. Their four ends lie in a plane (x
and y from 0 to 1); the sheet stands off from it along straight lines that run from
curve to curve, one above each x. How much longer such a line looks between the curves than in the
plane tells how high it stands; lengths along the heights give a place's x on the
sheet. Along a straight line three points are known, both curves and the level at which the
sheet's lines are straight, and a projective map of one dimension goes through them.
"""

from __future__ import annotations

import numpy as np

from leafmill.operators import kernels as k

#: A level so near a curve tells nothing of its own; then the middle between the curves does.
NEAR = 0.05


def valid(curve: np.ndarray) -> bool:
    """Whether a curve has two points or more, all of them finite, and ends apart from one another."""
    curve = np.asarray(curve, float)
    return curve.ndim == 2 and len(curve) >= 2 and bool(np.isfinite(curve).all()) and bool((curve[0] != curve[-1]).any())


def _mapped(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projective map of points."""
    w = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    return (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / w, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / w


def _rising(x: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The points whose x is above that of all before."""
    keep = np.concatenate(([True], x[1:] > np.maximum.accumulate(x)[:-1]))
    return [x[keep], *(o[keep] for o in others)]


class Sheet:
    """The sheet between a top and a bottom curve of (x, y) points; depth is how far off it was seen, usually 1 to 3."""

    def __init__(self, top: np.ndarray, bottom: np.ndarray, depth: float = 2.0):
        top, bottom = np.asarray(top, float), np.asarray(bottom, float)
        if not (valid(top) and valid(bottom)):
            raise ValueError("a curve needs two finite points, and ends that are apart")
        self.to_image = k.homography(np.array([(0, 0), (1, 0), (0, 1), (1, 1)], float), np.array([top[0], top[-1], bottom[0], bottom[-1]]))
        self.to_plane = np.linalg.inv(self.to_image)
        self.curves = [_rising(*_mapped(self.to_plane, *c.T)) for c in (top, bottom)]
        x = np.unique(np.concatenate([c[0] for c in self.curves]))
        x = x[(x >= 0) & (x <= 1)]
        off1, off2 = self._curve(0, x), self._curve(1, x) - 1
        apart = ((off1 - off2) ** 2).sum()
        self.level = 0.5 if apart < 1e-9 else float((off1 * (off1 - off2)).sum() / apart)
        between = self._along(x, self._curve(1, x)) - self._along(x, self._curve(0, x))
        self.heights = np.clip(depth * (1 - 1 / between), -0.5, 0.5)
        length = np.concatenate(([0], np.cumsum(np.hypot(np.diff(x), np.diff(self.heights)))))
        self.length, self.x, self.arc = float(length[-1]), x, length / length[-1]

    def _curve(self, which: int, x: np.ndarray) -> np.ndarray:
        """y of a curve in the plane, drawn on straight beyond its ends."""
        cx, cy = self.curves[which]
        slope = [(cy[1] - cy[0]) / (cx[1] - cx[0]), (cy[-1] - cy[-2]) / (cx[-1] - cx[-2])]
        return np.interp(x, cx, cy) + np.minimum(x - cx[0], 0) * slope[0] + np.maximum(x - cx[-1], 0) * slope[1]

    def _along(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where a point of the plane lies in the image on the straight line from (x, 0) to (x, 1): 0 at the one, 1 at the other."""
        (ax, ay), (bx, by), (px, py) = (_mapped(self.to_image, x, v) for v in (np.zeros_like(x), np.ones_like(x), y))
        return ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)

    def _third(self, x: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> tuple[float, np.ndarray]:
        """The sheet's level that a third point is known at, and where it lies."""
        if abs(self.level) < NEAR or abs(self.level - 1) < NEAR:
            return 0.5, (p1 + p2) / 2
        return self.level, self._along(x, np.full_like(x, self.level))

    def _lines(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, b and c of (a v + b) / (c v + 1), the place on the straight line at x of the sheet's v."""
        p1, p2 = self._along(x, self._curve(0, x)), self._along(x, self._curve(1, x))
        v, p3 = self._third(x, p1, p2)
        # b = p1, a + b = p2 (c + 1), a v + b = p3 (c v + 1)
        with np.errstate(all="ignore"):
            c = (p1 + v * (p2 - p1) - p3) / (v * (p3 - p2))
        c = np.where(np.isfinite(c), c, 0.0)
        return p2 * (c + 1) - p1, p1, c

    def to_warped(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the scan of places of the flat sheet, both from 0 to 1."""
        u, v = np.broadcast_arrays(np.asarray(u, float), np.asarray(v, float))
        x = np.interp(u, self.arc, self.x) + np.minimum(u, 0) + np.maximum(u - 1, 0)
        a, b, c = self._lines(x)
        at = (a * v + b) / (c * v + 1)
        (x0, y0), (x1, y1) = _mapped(self.to_image, x, np.zeros_like(x)), _mapped(self.to_image, x, np.ones_like(x))
        return x0 + at * (x1 - x0), y0 + at * (y1 - y0)

    def to_flat(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other way round."""
        px, py = np.broadcast_arrays(np.asarray(px, float), np.asarray(py, float))
        x, y = _mapped(self.to_plane, px, py)
        a, b, c = self._lines(x)
        at = self._along(x, y)
        return np.interp(x, self.x, self.arc) + np.minimum(x, 0) + np.maximum(x - 1, 0), (at - b) / (a - c * at)


def box_means(a: np.ndarray, left: np.ndarray, right: np.ndarray, top: np.ndarray, bottom: np.ndarray, outside: float = 255.0) -> np.ndarray:
    """Means of boxes with edges anywhere, each pixel by the share of it that is in the box; what is off the page has the tone `outside`."""
    h, w = a.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = a.astype(float).cumsum(axis=0).cumsum(axis=1)

    def upto(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        y, x = np.clip(y, 0, h), np.clip(x, 0, w)
        y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
        fy, fx = y - y0, x - x0
        return (total[y0, x0] * (1 - fx) + total[y0, x0 + 1] * fx) * (1 - fy) + (total[y0 + 1, x0] * (1 - fx) + total[y0 + 1, x0 + 1] * fx) * fy

    whole = (right - left) * (bottom - top)
    inside = np.maximum(np.clip(right, 0, w) - np.clip(left, 0, w), 0) * np.maximum(np.clip(bottom, 0, h) - np.clip(top, 0, h), 0)
    return (upto(bottom, right) - upto(top, right) - upto(bottom, left) + upto(top, left) + outside * (whole - inside)) / whole


def footprints(a: np.ndarray, x: np.ndarray, y: np.ndarray, outside: float = 255.0) -> np.ndarray:
    """A page of tones at places (x, y) of another, which are those of its pixels' corners: each pixel is the mean of the box around its corners, of a pixel at least."""
    corners = lambda c: np.stack((c[:-1, :-1], c[:-1, 1:], c[1:, :-1], c[1:, 1:]))
    edges = []
    for c in (corners(x), corners(y)):
        low, high = c.min(axis=0), c.max(axis=0)
        more = np.maximum(1 - (high - low), 0) / 2
        edges += [low - more, high + more]
    finite = np.isfinite(edges).all(axis=0)
    edges = [np.where(finite, e, e0) for e, e0 in zip(edges, (-2.0, -1.0, -2.0, -1.0), strict=True)]
    return np.clip(np.floor(box_means(a, *edges, outside) + 0.5), 0, 255).astype(np.int64)


def flattened(a: np.ndarray, top: np.ndarray, bottom: np.ndarray, height: int, width: int, depth: float = 2.0, outside: float = 255.0, above: float = 0.0, below: float = 0.0) -> np.ndarray:
    """The sheet between two curves as a page; above and below add to it, as shares of the distance between the curves."""
    v = np.linspace(-above, 1 + below, height + 1)[:, None]
    x, y = Sheet(top, bottom, depth).to_warped(np.linspace(0, 1, width + 1)[None, :], v)
    return footprints(a, x, y, outside)


def resampled(a: np.ndarray, matrix: np.ndarray, height: int, width: int, outside: float = 255.0) -> np.ndarray:
    """Affine resampling by area: the corners of each target pixel are read at matrix (2 by 3)."""
    y, x = np.mgrid[0 : height + 1, 0 : width + 1].astype(float)
    m = np.asarray(matrix, float)
    return footprints(a, m[0, 0] * x + m[0, 1] * y + m[0, 2], m[1, 0] * x + m[1, 1] * y + m[1, 2], outside)


#: Ends of lines that may lie outside the content's side, as a share, and pairs of lines that are tried.
OUTSIDE, TRIED = 0.1, 300


def side(ends: np.ndarray, left: bool, tolerance: float, lean: float = 0.25, seed: int = 1) -> tuple[float, float]:
    """(slope, start) of x = slope * y + start along the left or right ends of lines: of the lines through two ends with few ends outside, the one with most ends near it.

    Without two ends that are apart in height the side is upright at the outermost end.
    """
    ends = np.asarray(ends, float)
    outer = float(ends[:, 0].min() if left else ends[:, 0].max())
    best, choice = -1.0, (0.0, outer)
    rng = np.random.default_rng(seed)
    pairs = [(i, j) for i in range(len(ends)) for j in range(i)]
    if len(pairs) > TRIED:
        pairs = [pairs[i] for i in rng.choice(len(pairs), TRIED, replace=False)]
    for i, j in pairs:
        dy = ends[i, 1] - ends[j, 1]
        slope = (ends[i, 0] - ends[j, 0]) / dy if dy else np.inf
        if abs(slope) > lean:
            continue
        start = ends[i, 0] - slope * ends[i, 1]
        off = (ends[:, 0] - slope * ends[:, 1] - start) * (1 if left else -1)
        near = float((np.abs(off) <= tolerance).sum())
        if (off < -tolerance).mean() <= OUTSIDE and near > best:
            best, choice = near, (float(slope), float(start))
    return choice


def drawn_to(line: np.ndarray, left: tuple[float, float], right: tuple[float, float]) -> np.ndarray:
    """A line of text cut or drawn out straight to both sides of the content."""
    line = np.asarray(line, float)
    for bound, end in ((left, 0), (right, -1)):
        inner = line[min(4, len(line) - 1)] if end == 0 else line[max(-5, -len(line))]
        tip = line[end]
        d = tip - inner
        # x + t dx = slope * (y + t dy) + start
        across = d[0] - bound[0] * d[1]
        t = (bound[0] * tip[1] + bound[1] - tip[0]) / across if across else 0.0
        if t > 0:
            line = np.concatenate(([tip + t * d], line) if end == 0 else (line, [tip + t * d]))
        elif t < 0:
            beyond = line[:, 0] - bound[0] * line[:, 1] - bound[1]
            line = line[beyond >= 0 if end == 0 else beyond <= 0]
    return line


def unevenness(sheet: Sheet, lines: list[np.ndarray], most: float) -> float:
    """How far lines are from level on the flat sheet: a line's spread in shares of the sheet, up to `most`, summed over the lines."""
    total = 0.0
    for line in lines:
        _, v = sheet.to_flat(*line.T)
        spread = float(np.sqrt(np.var(v))) if np.isfinite(v).all() else most
        total += min(spread, most)
    return total


def model(lines: list[np.ndarray], depth: float = 2.0, tolerance: float = 10.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray] | None:
    """The two of a page's lines whose sheet makes all lines most level, drawn to the content's sides; None without two that span a sheet.

    Lines that are shorter than half the longest don't make the sheet, but count. Each pair is tried, or of many, pairs
    drawn at random; the one with the widest gap of those as good wins, as it holds most of the page.
    """
    lines = [np.asarray(line, float) for line in lines if valid(line)]
    if len(lines) < 2:
        return None
    left, right = (side(np.array([line[end] for line in lines]), end == 0, tolerance, seed=seed) for end in (0, -1))
    length = np.array([np.hypot(*np.diff(line, axis=0).T).sum() for line in lines])
    long = [drawn_to(line, left, right) for line, n in zip(lines, length, strict=True) if n >= length.max() / 2]
    long = [line for line in long if valid(line)]
    order = sorted(range(len(long)), key=lambda i: long[i][:, 1].mean())
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
    if len(pairs) > TRIED:
        pairs = [pairs[i] for i in np.random.default_rng(seed).choice(len(pairs), TRIED, replace=False)]
    found = []
    middles = [line[:, 1].mean() for line in lines]
    most = 0.05 * (max(middles) - min(middles))  # of a line that fits no sheet
    for a, b in pairs:
        gap = float(long[b][:, 1].mean() - long[a][:, 1].mean())
        try:
            with np.errstate(all="ignore"):
                found.append((unevenness(Sheet(long[a], long[b], depth), lines, most / max(gap, 1e-9)) * gap, -gap, a, b))
        except (ValueError, np.linalg.LinAlgError):
            continue
    if not found:
        return None
    best = min(f[0] for f in found)
    *_, a, b = min((f for f in found if f[0] <= 1.25 * best + 1e-9), key=lambda f: f[1])
    return long[a], long[b]


def modelled(page: np.ndarray, lines: list[np.ndarray], depth: float = 2.0) -> np.ndarray:
    """A page laid flat by all its lines, what is above and below the sheet with it; as it is where they span none."""
    curves = model(lines, depth)
    if curves is None:
        return page
    top, bottom = (float(c[:, 1].mean()) for c in curves)
    if bottom - top < 1:
        return page
    return flattened(page, *curves, *page.shape, depth, above=top / (bottom - top), below=(page.shape[0] - bottom) / (bottom - top))
