"""X-splines: open curves through or near control points, by a tension each, and their fit to a line.

A curve's point is a weighted mean of four control points; the weights are quintic
polynomials of the place within a segment, and depend on two tensions (-1 to 0: the curve goes
through the point, the rounder the lower; 0 to 1: it passes by, the further the higher). All functions take many
places at once; t runs from 0 to 1 over the whole curve, and what is outside or not a number counts as its ends.
"""

from __future__ import annotations

import numpy as np

#: Levels of halving a piece of a curve at most, and a squared chord below which a piece is not halved.
DEPTH, SHORT = 20, 1e-6


def _quintic(q: np.ndarray, p: np.ndarray | None) -> np.ndarray:
    """Coefficients of 1, u, ... u^5 of the blend: rising from 0 to its top (with p), or the dip beyond (without)."""
    z = np.zeros_like(q)
    if p is None:
        return np.stack((z, q, 2 * q, z, -2 * q, -q))
    return np.stack((z, q, 2 * q, 10 - 12 * q - p, 2 * p + 14 * q - 15, 6 - 5 * q - p))


def _evaluated(c: np.ndarray, u: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Value and first and second derivative of polynomials c at u, by what u is a multiple of."""
    out = []
    for order in range(3):
        out.append(sum(row * u**i for i, row in enumerate(c)) * slope**order)
        c = np.stack([row * (i + 1) for i, row in enumerate(c[1:])])
    return np.stack(out)


def weights(t: np.ndarray, tension: np.ndarray, order: int = 0) -> np.ndarray:
    """(order + 1, places, points): the weights of all control points at t, and their derivatives by t."""
    tension, n = np.asarray(tension, float), len(tension)
    t = np.clip(np.nan_to_num(np.atleast_1d(np.asarray(t, float)), nan=0.0), 0, 1)
    if n == 1:
        out = np.zeros((3, len(t), 1))
        out[0] = 1
        return out[: order + 1]
    segment = np.minimum((t * (n - 1)).astype(int), n - 2)
    local = t * (n - 1) - segment
    here, there = tension[segment], tension[segment + 1]
    s1, s2, q1, q2 = np.maximum(here, 0), np.maximum(there, 0), -0.5 * np.minimum(here, 0), -0.5 * np.minimum(there, 0)
    # Where each of the four weights tops out is 0, 1, 0 or 1 less or more the tension; it begins at a neighbouring knot.
    parts = []
    for knot, end, q, both in ((-1, s1, q1, True), (0, 1 + s2, q2, False), (1, -s1, q1, False), (2, 1 - s2, q2, True)):
        slope = 1 / (knot - end)
        u = (local - end) * slope
        made = _evaluated(_quintic(q, 2 * (knot - end) ** 2), u, slope * (n - 1))
        if both:
            beyond = local > end if knot == -1 else local < end
            made = np.where(beyond, _evaluated(_quintic(q, None), u, slope * (n - 1)), made)
        parts.append(made)
    a = np.stack(parts, axis=2)  # derivative, place, point of four
    total = a.sum(axis=2, keepdims=True)
    value = a[0] / total[0]
    first = (a[1] - value * total[1]) / total[0]
    second = (a[2] - 2 * first * total[1] - value * total[2]) / total[0]
    out = np.zeros((3, len(t), n))
    at = np.clip(segment[:, None] + np.array([-1, 0, 1, 2]), 0, n - 1)
    for i, w in enumerate((value, first, second)):
        np.add.at(out[i], (np.arange(len(t))[:, None], at), w)
    return out[: order + 1]


def points_at(t: np.ndarray, points: np.ndarray, tension: np.ndarray) -> np.ndarray:
    return weights(t, tension)[0] @ np.asarray(points, float)


def curvature(t: np.ndarray, points: np.ndarray, tension: np.ndarray) -> np.ndarray:
    """Signed: positive where the curve turns from x to y; 0 where it stands still."""
    _, first, second = weights(t, tension, 2) @ np.asarray(points, float)
    speed = np.hypot(*first.T) ** 3
    return np.where(speed > 0, (first[:, 0] * second[:, 1] - first[:, 1] * second[:, 0]) / np.where(speed > 0, speed, 1), 0.0)


def _apart(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points from the lines through a and b."""
    d = b - a
    length = np.hypot(*d.T)
    return np.abs(d[:, 0] * (p - a)[:, 1] - d[:, 1] * (p - a)[:, 0]) / np.where(length > 0, length, 1)


def sampled(points: np.ndarray, tension: np.ndarray, flat: float = 0.2, step: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(t, points) of a polyline that leaves the curve by `flat` at most, with chords up to `step`; all junctions are in it.

    All pieces that are not flat enough are halved together, level by level. Pieces with ends that coincide or that are not finite are left.
    """
    points, n = np.asarray(points, float), len(points)
    if n < 2:
        return np.zeros(n), points.reshape(-1, 2)
    t = np.linspace(0, 1, n)
    with np.errstate(all="ignore"):
        at = points_at(t, points, tension)
        chord = ((at[1:] - at[:-1]) ** 2).sum(axis=1)
        if n > 2 and not (((at[-1] - at[0]) ** 2).sum() >= SHORT and np.isfinite(at[[0, -1]]).all()):
            return t[[0, -1]], at[[0, -1]]
        open_ = np.ones(n - 1, bool)
        for _ in range(DEPTH):
            chord = ((at[1:] - at[:-1]) ** 2).sum(axis=1)
            split = np.flatnonzero(open_ & (chord >= SHORT) & np.isfinite(chord))
            if not len(split):
                break
            middle = (t[split] + t[split + 1]) / 2
            new = points_at(middle, points, tension)
            keep = ~((_apart(new, at[split], at[split + 1]) <= flat) & (chord[split] <= step * step)) & (middle > t[split]) & (middle < t[split + 1])
            open_[:] = False
            where, middle, new = split[keep] + 1, middle[keep], new[keep]
            t, at = np.insert(t, where, middle), np.insert(at, where, new, axis=0)
            places = where + np.arange(len(where))
            open_ = np.zeros(len(t) - 1, bool)
            open_[places - 1] = open_[places] = True
    return t, at


def closest(to: np.ndarray, points: np.ndarray, tension: np.ndarray, accuracy: float = 0.2) -> tuple[float, np.ndarray]:
    """(t, point) of the curve near a place: in the segment whose chord is nearest, halved towards the place until its ends are as near as `accuracy`."""
    points, n = np.asarray(points, float), len(points)
    if n == 1:
        return 0.0, points[0]
    ends = points_at(np.linspace(0, 1, n), points, tension)
    d = ends[1:] - ends[:-1]
    share = np.clip(((to - ends[:-1]) * d).sum(axis=1) / np.where((size := (d * d).sum(axis=1)) > 0, size, 1), 0, 1)
    best = int(np.argmin(((ends[:-1] + share[:, None] * d - to) ** 2).sum(axis=1)))
    low, high = best / (n - 1), (best + 1) / (n - 1)
    a, b = ends[best], ends[best + 1]
    for _ in range(60):
        if ((a - b) ** 2).sum() <= accuracy * accuracy:
            break
        middle = (low + high) / 2
        m = points_at(middle, points, tension)[0]
        if (to - a) @ (b - a) < (m - a) @ (b - a):
            high, b = middle, m
        else:
            low, a = middle, m
    return (low, a) if ((to - a) ** 2).sum() < ((to - b) ** 2).sum() else (high, b)


def constrained_minimum(a: np.ndarray, b: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """x of the least x'ax + b'x with rows @ x = values, by multipliers; the shortest of several."""
    k = len(rows)
    system = np.block([[2 * a, rows.T], [rows, np.zeros((k, k))]]) if k else 2 * a
    return np.linalg.lstsq(system, np.concatenate((-b, values)), rcond=None)[0][: len(b)]


def feet(p: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the nearest one of a polyline, the direction of the line there, and whether it is an end or a corner that the point is beyond."""
    a, d = line[:-1], line[1:] - line[:-1]
    size = np.maximum((d * d).sum(axis=1), 1e-300)
    share = ((p[:, None] - a) * d).sum(axis=2) / size
    at = a + np.clip(share, 0, 1)[:, :, None] * d
    best = ((p[:, None] - at) ** 2).sum(axis=2).argmin(axis=1)
    own = np.arange(len(p)), best
    return at[own], d[best] / np.sqrt(size[best])[:, None], (share[own] <= 0) | (share[own] >= 1)


def fitted(points: np.ndarray, tension: np.ndarray, line: np.ndarray, fixed: dict[int, tuple[float, float]] | None = None, stiff: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Control points moved so that the curve follows a polyline.

    Each round weighs the squared distance of places along the curve by what it is near the line: across
    it in full, along it not at all, but in full where the line ends. `stiff` draws
    junctions together, less from round to round; fixed control points stay where they are told.
    """
    points, line, n = np.asarray(points, float).copy(), np.asarray(line, float), len(points)
    w = weights(np.linspace(0, 1, 8 * (n - 1) + 1), tension)[0]
    junctions = weights(np.linspace(0, 1, n), tension)[0]
    pull = (junctions[1:] - junctions[:-1]).T @ (junctions[1:] - junctions[:-1])
    fixed = fixed or {}
    rows, values = np.zeros((2 * len(fixed), 2 * n)), np.zeros(2 * len(fixed))
    for i, (k, place) in enumerate(fixed.items()):
        for axis in (0, 1):
            rows[2 * i + axis, axis * n + k], values[2 * i + axis] = 1, place[axis]
    for _ in range(rounds):
        foot, along, end = feet(w @ points, line)
        across = np.stack((-along[:, 1], along[:, 0]), axis=1)
        a, b = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
        for direction, share in ((across, np.ones(len(w))), (along, end.astype(float))):
            r = np.concatenate((w * direction[:, :1], w * direction[:, 1:]), axis=1)
            goal = (foot * direction).sum(axis=1)
            a += (r * share[:, None]).T @ r
            b -= 2 * (r * (share * goal)[:, None]).sum(axis=0)
        for axis in (0, 1):
            a[axis * n : axis * n + n, axis * n : axis * n + n] += stiff * pull
        moved = constrained_minimum(a, b, rows, values).reshape(2, n).T
        rest, points, stiff = np.abs(moved - points).max(), moved, stiff / 2
        if rest < 1e-6:
            break
    return points
