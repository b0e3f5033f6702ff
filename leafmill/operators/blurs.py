"""Gaussian blur by recursion: two damped waves from each side, so that its cost does not depend on how wide it is."""

from __future__ import annotations

import numpy as np

#: Fixed values of the fourth-order approximation: cosine and sine share, damping and frequency of each wave.
WAVES = ((1.6803, 3.735, 1.783, 0.6318), (-0.6803, -0.2598, 1.723, 1.997))


def _along_rows(a: np.ndarray, sigma: float) -> np.ndarray:
    """a blurred along its first axis. A wave's sum over all before is the last sum times one complex number, plus what is new; beyond the edges the edge's values repeat."""
    out, weight, last = np.zeros(a.shape), 0.0, len(a) - 1
    for cosine, sine, damping, frequency in WAVES:
        step, share = np.exp((-damping + 1j * frequency) / sigma), cosine - 1j * sine
        weight += (share * (1 + step) / (1 - step)).real
        before, after = a[0] / (1 - step), a[last] * step / (1 - step)
        for i in range(len(a)):
            before = step * before + a[i] if i else before
            out[i] += (share * before).real
        for i in range(last, -1, -1):  # the other side leaves out the pixel itself
            after = step * (after + a[i + 1]) if i < last else after
            out[i] += (share * after).real
    return out / weight


def gauss(a: np.ndarray, sigma_x: float, sigma_y: float) -> np.ndarray:
    """A page blurred by sigma along rows and columns; 0 leaves an axis as it is."""
    out = np.asarray(a, float)
    if sigma_y > 0:
        out = _along_rows(out, sigma_y)
    if sigma_x > 0:
        out = _along_rows(np.ascontiguousarray(out.T), sigma_x).T
    return out
