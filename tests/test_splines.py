"""X-splines against formulas one place at a time, differences, dense samples, and drawn lines."""

import numpy as np
import pytest

from leafmill.operators import splines


def blend(u, q, p=None):
    if p is None:
        return q * u + 2 * q * u**2 - 2 * q * u**4 - q * u**5
    return q * u + 2 * q * u**2 + (10 - 12 * q - p) * u**3 + (2 * p + 14 * q - 15) * u**4 + (6 - 5 * q - p) * u**5


def one_place(t, points, tension):
    n = len(points)
    s = min(int(t * (n - 1)), n - 2)
    u = t * (n - 1) - s
    a, b = tension[s], tension[s + 1]
    ends = (0 + max(a, 0), 1 + max(b, 0), 0 - max(a, 0), 1 - max(b, 0))
    q = (max(-a, 0) / 2, max(-b, 0) / 2, max(-a, 0) / 2, max(-b, 0) / 2)
    w = []
    for i, knot in enumerate((-1, 0, 1, 2)):
        v, p = (u - ends[i]) / (knot - ends[i]), 2 * (knot - ends[i]) ** 2
        w.append(blend(v, q[i]) if (i == 0 and u > ends[0]) or (i == 3 and u < ends[3]) else blend(v, q[i], p))
    at = [max(s - 1, 0), s, s + 1, min(s + 2, n - 1)]
    return sum(x * np.array(points[k], float) for x, k in zip(w, at, strict=True)) / sum(w)


def curves():
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 9):
        for low, high in ((-1, 0), (0, 1), (-1, 1), (0, 0), (1, 1)):
            yield rng.random((n, 2)) * 100, rng.uniform(low, high, n)


def test_points_are_those_of_the_formulas():
    for points, tension in curves():
        t = np.linspace(0, 1, 41)
        assert np.allclose(splines.points_at(t, points, tension), [one_place(x, points, tension) for x in t])
        assert np.allclose(splines.weights(t, tension)[0].sum(axis=1), 1)


def test_points_with_no_tension_above_zero_are_met():
    for points, tension in curves():
        at = splines.points_at(np.linspace(0, 1, len(points)), points, np.minimum(tension, 0))
        assert np.allclose(at, points)


def test_derivatives_are_those_of_differences():
    for points, tension in curves():
        t = np.linspace(0.03, 0.97, 29)
        t = t[np.abs(t * (len(points) - 1) - np.round(t * (len(points) - 1))) > 1e-3]
        _, first, second = splines.weights(t, tension, 2) @ points
        h = 1e-5
        before, here, after = (splines.points_at(t + d, points, tension) for d in (-h, 0, h))
        assert np.allclose(first, (after - before) / (2 * h), rtol=1e-4, atol=1e-3 * np.abs(first).max())
        assert np.allclose(second, (after - 2 * here + before) / h**2, rtol=1e-2, atol=1e-3 * max(1, np.abs(second).max()))
    circle = [(np.cos(a) * 50, np.sin(a) * 50) for a in np.linspace(0, 3, 40)]
    assert np.allclose(splines.curvature(np.linspace(0.2, 0.8, 31), circle, [1] * 40), 1 / 50, rtol=0.12)
    assert splines.curvature([0.5], [(3, 3), (3, 3)], [0, 0]).tolist() == [0]


def test_damaged_and_huge_coordinates_end():
    for x in (float("nan"), 1e300, float("inf")):
        _, line = splines.sampled([(0, 0), (x, -x), (-x, x)], [1, 1, 1])
        assert len(line) >= 2
    _, line = splines.sampled([(0, 0), (float("nan"), 0), (100, 0)], [1, 1, 1])
    assert len(line) >= 2


def test_places_just_outside_and_single_points():
    points, tension = [(0, 0), (10, 0), (20, 5)], [0, 0, 0]
    assert np.allclose(splines.points_at([1 + 1e-12, -1e-12, float("nan")], points, tension), [(20, 5), (0, 0), (0, 0)])
    assert splines.points_at([0.5], [(5, 7)], [0]).tolist() == [[5, 7]] and splines.weights([0.5], [0], 2).tolist() == [[[1]], [[0]], [[0]]]
    assert splines.sampled([(5, 7)], [0])[1].tolist() == [[5, 7]] and splines.sampled(np.zeros((0, 2)), [])[1].shape == (0, 2)
    assert splines.closest(np.array([1, 1]), [(5, 7)], [0])[1].tolist() == [5, 7]


@pytest.mark.parametrize("flat", [0.2, 0.01])
def test_samples_stay_by_the_curve(flat):
    for points, tension in curves():
        t, line = splines.sampled(points, tension, flat)
        assert (np.diff(t) > 0).all() and set(np.round(np.linspace(0, 1, len(points)), 12)) <= set(np.round(t, 12))
        dense = splines.points_at(np.linspace(0, 1, 2000), points, tension)
        foot, _, _ = splines.feet(dense, line)
        assert np.hypot(*(dense - foot).T).max() < 4 * flat + 0.2  # a piece that bends both ways can look flat in its middle
        _, close = splines.sampled(points, tension, flat, step=3)
        assert np.hypot(*np.diff(close, axis=0).T).max() <= 3


def test_the_closest_point_is_as_near_as_that_of_many():
    rng = np.random.default_rng(9)
    points = [(0, 0), (30, 12), (60, -5), (100, 3)]
    for tension in ([-1] * 4, [0] * 4, [1] * 4):
        dense = splines.points_at(np.linspace(0, 1, 4000), points, tension)
        for to in rng.random((20, 2)) * (100, 8):
            t, at = splines.closest(to, points, tension, 0.01)
            assert np.allclose(splines.points_at(t, points, tension)[0], at)
            assert np.hypot(*(at - to)) < np.hypot(*(dense - to).T).min() + 1.5


def test_constrained_minimum():
    a, b = np.diag([1.0, 2.0, 3.0]), np.array([-2.0, -4.0, -6.0])
    assert np.allclose(splines.constrained_minimum(a, b, np.zeros((0, 3)), np.zeros(0)), 1)
    x = splines.constrained_minimum(a, b, np.array([[1.0, 1, 1]]), np.array([6.0]))
    rng = np.random.default_rng(0)
    value = lambda x: x @ a @ x + b @ x
    for _ in range(200):
        d = rng.normal(size=3)
        assert np.isclose(x.sum(), 6) and value(x) <= value(x + d - d.mean()) + 1e-9


def test_a_spline_follows_a_bent_line():
    x = np.linspace(0, 300, 120)
    line = np.stack((x, 40 + 18 * np.sin(x / 60)), axis=1)
    start = np.stack((np.linspace(0, 300, 7), np.full(7, 40.0)), axis=1)
    ends = {0: tuple(line[0]), 6: tuple(line[-1])}
    for tension in ([-0.5] * 7, [1] * 7):
        made = splines.fitted(start, tension, line, ends)
        foot, _, _ = splines.feet(splines.points_at(np.linspace(0, 1, 400), made, tension), line)
        off = np.hypot(*(splines.points_at(np.linspace(0, 1, 400), made, tension) - foot).T)
        before = splines.points_at(np.linspace(0, 1, 400), start, tension)
        assert off.max() < 1.5 and np.hypot(*(before - splines.feet(before, line)[0]).T).max() > 10
        assert np.allclose(made[[0, 6]], line[[0, -1]])
    free = splines.fitted(start, [0] * 7, line[:2].repeat(2, axis=0) + 0.0, None)
    assert np.isfinite(free).all()


def test_spline_query(spark, small):
    from leafmill.plans import layout_queries

    rows = {r.user_id: r for r in layout_queries.reg.queries["spline_samples"](spark, small).collect()}
    events = sorted(spark.read.parquet(f"{small}/events.parquet").collect(), key=lambda e: (e.user_id, e.ts, e.event_id))
    users = {}
    for e in events:
        users.setdefault(e.user_id, []).append(e)
    assert rows.keys() == users.keys()
    for user, own in list(users.items())[:20]:
        own = own[:8]
        points, tension = [(10.0 * i, e.value) for i, e in enumerate(own)], [{"click": -0.5, "view": 0.0}.get(e.event_type, 1.0) for e in own]
        dense = np.array([one_place(t, points, tension) for t in np.linspace(0, 1, 3000)]) if len(own) > 1 else np.array(points)
        assert rows[user].length == pytest.approx(np.hypot(*np.diff(dense, axis=0).T).sum(), rel=0.03, abs=1e-6)
