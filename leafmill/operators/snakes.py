"""Text lines as snakes: a middle line with two sides, drawn to the upper and lower edges of the letters.

A snake's nodes stand at even steps along a line; each has a place, and all share half a thickness. On
the blurred page, tones fall across the upper edge of a line of text and rise across the
lower one. Nodes move along their normals, by a step or not at all, so that the sides
lie where that is strongest while the snake stays smooth; which moves are best together is told by dynamic
programming over pairs of neighbours. When no move helps, the step is halved.
"""

from __future__ import annotations

import numpy as np

from leafmill.operators import blurs

#: Weights of bending and of uneven moves, against the mean strength of an edge.
BEND, STRETCH = 4.0, 0.2
STEPS = (1.0, 0.5, 0.25, 0.125)


def slopes(page: np.ndarray, sigma_x: float, sigma_y: float) -> np.ndarray:
    """How fast tones rise down the blurred page."""
    soft = blurs.gauss(page, sigma_x, sigma_y)
    out = np.zeros(soft.shape)
    out[1:-1] = (soft[2:] - soft[:-2]) / 2
    return out


def read(field: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The field between its pixels; the edge's values repeat."""
    h, w = field.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    return (field[y0, x0] * (1 - fx) + field[y0, x1] * fx) * (1 - fy) + (field[y1, x0] * (1 - fx) + field[y1, x1] * fx) * fy


def normals(nodes: np.ndarray) -> np.ndarray:
    """Unit normals of the nodes, pointing down."""
    along = np.gradient(nodes, axis=0)
    out = np.stack((-along[:, 1], along[:, 0]), axis=1)
    out *= np.where(out[:, 1] < 0, -1, 1)[:, None]
    return out / np.maximum(np.hypot(*out.T), 1e-12)[:, None]


def strength(field: np.ndarray, nodes: np.ndarray, down: np.ndarray, half: float) -> np.ndarray:
    """Of both edges at each node; high where tones fall at the upper side and rise at the lower one."""
    upper, lower = nodes - half * down, nodes + half * down
    return read(field, *lower.T) - read(field, *upper.T)


def best_moves(gain: np.ndarray, bends: np.ndarray, step: float, bend: float, stretch: float) -> np.ndarray:
    """-1, 0 or 1 for each node: the moves of most gain (node, move), less bending and unevenness.

    bends is what the nodes bend already (second differences along the normal); the best way to each pair of moves
    of two neighbours is kept, and followed back from the best last pair.
    """
    n, moves = len(gain), np.array([-1, 0, 1])
    uneven = stretch * step * step * (moves[:, None] - moves[None, :]) ** 2
    best = gain[0][:, None] + gain[1][None, :] - uneven
    came = []
    second = moves[:, None, None] - 2 * moves[None, :, None] + moves[None, None, :]
    for i in range(2, n):
        total = best[:, :, None] + gain[i][None, None, :] - uneven[None] - bend * (bends[i - 1] + step * second) ** 2
        came.append(total.argmax(axis=0))
        best = total.max(axis=0)
    out = np.zeros(n, int)
    out[n - 2], out[n - 1] = np.unravel_index(best.argmax(), best.shape)
    for i in range(n - 3, -1, -1):
        out[i] = came[i][out[i + 1], out[i + 2]]
    return moves[out]


def refined(field: np.ndarray, line: np.ndarray, half: float, spacing: float = 8.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """(nodes, half thickness) of the snake that a line of (x, y) points settles to; a line without length stays as it is."""
    line = np.asarray(line, float)
    lengths = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))))
    count = max(3, int(lengths[-1] / spacing) + 1)
    if lengths[-1] <= 0 or min(field.shape) < 2:
        return line, half
    at = np.linspace(0, lengths[-1], count)
    nodes = np.stack([np.interp(at, lengths, line[:, i]) for i in (0, 1)], axis=1)
    scale = max(float(np.abs(field).mean()), 1e-3)
    for step in STEPS:
        for _ in range(rounds):
            down = normals(nodes)
            halves = np.maximum(half + np.array([0.0, -step, step]), 0.5)
            half_before, half = half, float(halves[np.argmax([strength(field, nodes, down, h).sum() for h in halves])])
            gain = np.stack([strength(field, nodes + m * step * down, down, half) for m in (-1, 0, 1)], axis=1) / scale
            gain[:, 1] += 1e-6  # of moves that are worth the same, none
            bends = np.zeros(count)
            bends[1:-1] = ((nodes[2:] - 2 * nodes[1:-1] + nodes[:-2]) * down[1:-1]).sum(axis=1)
            moves = best_moves(gain, bends, step, BEND, STRETCH)
            nodes = nodes + (moves * step)[:, None] * down
            if not moves.any() and half == half_before:
                break
    return nodes, half


def refined_lines(page: np.ndarray, lines: list[np.ndarray], height: float) -> list[np.ndarray]:
    """Middle lines of lines of text about `height` high, each drawn to its letters on a soft page first and then on a sharper one."""
    out, halves = lines, [height / 2] * len(lines)
    for softness in (1.0, 0.5):
        field = slopes(page, 4 * height * softness, max(0.7, height * softness / 4))
        made = [refined(field, line, half) for line, half in zip(out, halves, strict=True)]
        out, halves = [m[0] for m in made], [m[1] for m in made]
    return out
