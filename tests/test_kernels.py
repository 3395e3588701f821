import time
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewright.functions import kernels as K
from gaugewright.operators.patterns import STABLE, _islands, regime_confidence, stable_intervals
from gaugewright.operators.regimes import LogTimeWindow, Params, Transient, frame_distances, slope_distances


def slow_valleys(p, prominence):
    out, i, n = [], 1, len(p)
    while i < n - 1:
        j = i
        while j < n - 1 and p[j + 1] == p[i]:
            j += 1
        if j < n - 1 and p[i - 1] > p[i] and p[j + 1] > p[i]:
            left = right = -np.inf
            for k in range(i - 1, -1, -1):
                if p[k] < p[i]:
                    break
                left = max(left, p[k])
            for k in range(j + 1, n):
                if p[k] < p[i]:
                    break
                right = max(right, p[k])
            if min(left, right) - p[i] >= prominence:
                out.append((i + j) // 2)
        i = j + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.integers(0, 4))
def test_valleys_equal_a_plain_scan(values, prominence):
    p = np.array(values, float)
    assert K.prominent_valleys(p, prominence).tolist() == slow_valleys(p, prominence)


def sliced_valleys(p, prominence, size):
    """The same from slices of `size` samples that only know their neighbours' edges."""
    parts = [K.flats_and_walls(p[i : i + size], K.wall_cuts(p[i : i + size], prominence)) for i in range(0, len(p), size)]
    edges = [
        K.Edge(i, s.tail[-1] + 1, s.value[0], s.tail[0], s.value[1] if len(s.value) > 1 else np.nan, s.value[-1], s.head[-1], s.value[-2] if len(s.value) > 1 else np.nan, *[(lo[at], hi[at]) for (lo, hi), at in ((s.left, -1), (s.right, 0), (s.left, -2), (s.right, 1))])
        for i, s in enumerate(parts)
    ]
    out = []
    for s, (i, left, right, places) in zip(parts, K.stitch(edges), strict=True):
        k = K.low_flats(s)
        v = s.value[k]
        k = k[(K.clamp(left, s.left[0][k], s.left[1][k]) >= v) & (K.clamp(right, s.right[0][k + 1], s.right[1][k + 1]) >= v)]
        out += [i * size + at for at in sorted([*((s.head[k] + s.tail[k]) // 2), *places])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(0, 4), st.sampled_from([1, 2, 3, 10]))
def test_valleys_by_slices_equal_a_plain_scan(values, prominence, size):
    p = np.array(values, float)
    assert sliced_valleys(p, prominence, size) == slow_valleys(p, prominence)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=60), st.floats(0, 40), st.sampled_from([1, 4, 10]))
def test_valleys_by_slices_round_as_a_plain_scan(values, prominence, size):
    p = np.array(values, float)
    assert sliced_valleys(p, prominence, size) == slow_valleys(p, prominence) == K.prominent_valleys(p, prominence).tolist()


def test_savgol_keeps_parabolas():
    x = np.arange(60.0)
    assert np.allclose(K.savgol_quadratic(3 - 2 * x + 0.5 * x * x, 25), 3 - 2 * x + 0.5 * x * x)


def test_theil_sen_ignores_one_outlier():
    x = np.linspace(0, 1, 10)[None]
    y = 2 * x + 1
    y[0, 4] = 50
    assert abs(K.theil_sen_slopes(x, y)[0] - 2) < 0.05


def test_bourdet_of_a_log_line_is_flat():
    dt = np.logspace(-2, 2, 200)
    j, d = K.bourdet(np.log10(dt), 5 * np.log10(dt), dt, 0.1)
    assert len(j) and np.allclose(d, 5 / np.log(10))


def test_wilcoxon_known_values():
    assert K.wilcoxon_p(np.arange(1, 9.0), np.zeros(8)) == pytest.approx(2 / 256)
    assert np.isnan(K.wilcoxon_p(np.ones(5), np.ones(5)))
    assert K.wilcoxon_p(np.array([1.0, -1, 2, -2]), np.zeros(4)) == pytest.approx(1.0)


def test_window_frames_on_a_log_grid():
    w = LogTimeWindow(np.linspace(-5, 3, 500), 0.5, 0.02)
    assert w.count() == 377
    assert w.frame(0) == (-1, 500) and w.frame(1) == (0, 32) and w.frame(376) == (467, 500)
    with pytest.raises(ValueError):
        LogTimeWindow(np.array([1.0]), 0.5, 0.02).check()


@pytest.mark.parametrize(("slope", "code"), [(0.0, 0), (0.364, 2), (-0.364, 4)])
def test_slopes_are_told_apart(slope, code):
    x = np.linspace(0, 1, 50)
    assert slope_distances(x, slope * x).argmin() == code


@pytest.mark.parametrize("until", [10, 20, 50])
def test_flat_then_steep_transient(until):
    t = np.logspace(-2, 3, 200)
    d = np.where(t < until, 3.0, 3.0 * (t / until) ** 0.364)
    fit = Transient.fit(Params(), t, t**0.1, d)
    regime, _, p = fit.optimize()
    assert len(regime) == 500 and set(regime.tolist()) == {0, 1, 4}
    assert abs(fit.log_time[np.flatnonzero(regime == 1)[0]] - np.log10(until)) < 0.05
    assert Params().window_length != 0 and -1.5 <= p.filter_value <= 1


def curve(*pieces):
    """Time and derivative of a curve of log-log slopes, each up to a log time."""
    x = np.linspace(-2.5, 2.5, 300)
    slope = np.array([next(s for end, s in pieces if v <= end) for v in x[1:]])
    return 10**x, 10 ** np.concatenate(([0.0], np.cumsum(slope * np.diff(x))))


HUMP = ((-1.2, 1.0), (-0.6, -0.6))  # storage in the well before the reservoir answers


@pytest.mark.parametrize(
    ("pieces", "regimes"),
    [
        ([(9, 0.0)], {4: -2.5, 0: -0.6}),
        ([(1.2, 0.0), (9, -0.364)], {4: -2.5, 0: -0.6, 2: 1.2}),
        ([(1.0, 0.0), (2.1, 0.364), (9, 1.0)], {4: -2.5, 0: -0.6, 1: 1.0, 3: 2.1}),
        ([(9, 0.364)], {4: -2.5, 1: -0.6}),
    ],
)
def test_regimes_of_designed_transients(pieces, regimes):
    """Each regime is found, none besides, and begins where the curve bends."""
    t, d = curve(*HUMP, *pieces)
    fit = Transient.fit(Params(), t, t**0.1, d)
    found, _, _ = fit.optimize()
    assert {int(k): round(float(fit.log_time[np.flatnonzero(found == k)[0]]), 1) for k in np.unique(found)} == pytest.approx(regimes, abs=0.2)


def test_boundary_before_the_filter_is_boundary():
    """A transient that is steep all through has no point twice."""
    t = np.logspace(-2, 2, 100)
    fit = Transient.fit(Params(), t, t**0.1, t**1.5)
    regime, _ = fit.detect(Params(), full=True)
    assert len(regime) == 500 and (regime[~fit.inlier] == 3).all() and not fit.inlier[-1]


@pytest.mark.parametrize("bad", [{"metric": "x"}, {"dsw": 4}, {"rsw": 0.01}, {"bdw": 1}, {"filter_value": 3}, {"fragment_window": 2}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)
    with pytest.raises(TypeError):
        Params(bdw=2.5)


def test_stable_interval_leaves_out_as_few_as_needed():
    t = np.logspace(0, 3, 500)
    flat, other = np.zeros(500), np.full(500, 2.0)
    assert [(r[0], r[4]) for r in stable_intervals([(t, flat)] * 3)] == [(0, 0)]
    assert [(r[0], r[4]) for r in stable_intervals([(t, flat), (t, flat), (t, other)])][0] == (0, 1)
    code, a, b, conf, _ = stable_intervals([(t, flat)] * 2)[0]
    assert a < b and 0 <= conf <= 1 + 1e-9
    assert stable_intervals([(t, flat), (t, other)], max_drop=0) == []


def every_subset(members, minimum, max_drop, points=500):
    """The longest stable intervals by trying every set of transients to leave out."""
    for drop in range(min(max_drop, len(members) - 1) + 1):
        best = {}
        for kept in combinations(range(len(members)), len(members) - drop):
            lo, hi = max(members[i][0][0] for i in kept), min(members[i][0][-1] for i in kept)
            if not 0 < lo < hi:
                continue
            grid = np.logspace(np.log10(lo), np.log10(hi), points)
            log = np.log10(grid)
            codes = np.stack([np.interp(grid, *members[i]) for i in kept])
            for code in STABLE:
                for a, b in _islands((codes == code).all(axis=0)):
                    if log[b] - log[a] >= minimum:
                        best[code] = max(best.get(code, (0.0,)), (log[b] - log[a], -grid[a], grid[b]))
        if best:
            return [(c, float(-a), float(b), float(np.prod(regime_confidence(members, c, -a, b))), drop) for c, (_, a, b) in sorted(best.items())]
    return []


@pytest.mark.parametrize("seed", range(8))
def test_stable_intervals_equal_every_subset(seed):
    """Common and own ranges, ties of ranges, single odd codes, groups of 1 to 8, every bound on what may go."""
    rng, found = np.random.default_rng(seed), 0
    for _ in range(15):
        members = []
        for _ in range(rng.integers(1, 9)):
            lo = 10 ** (rng.choice([-2.3, -2, -1]) if rng.random() < 0.5 else rng.uniform(-2.5, -1))
            t = np.logspace(np.log10(lo), rng.uniform(0.3, 1.5), int(rng.integers(20, 120)))
            codes = np.resize(np.repeat(rng.choice([0, 0, 1, 2, 3], 6), rng.integers(5, 40)), len(t))
            odd = rng.random(len(t)) < rng.choice([0, 0.02])
            members.append((t, np.where(odd, rng.integers(0, 5, len(t)), codes).astype(float)))
        for max_drop in (0, 2, max(len(members) - 2, 0), len(members)):
            got = stable_intervals(members, 0.3, max_drop)
            assert got == every_subset(members, 0.3, max_drop)
            found += bool(got)
    assert found > 20


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_stable_intervals_of_many_transients(spread):
    """60 transients, of which any 58 may go: subsets would be 10^18."""
    rng = np.random.default_rng(1)
    members = [(np.logspace(-2 - spread * rng.random(), 1.5 + spread * rng.random(), 500), np.repeat(rng.integers(0, 5, 20), 25).astype(float)) for _ in range(60)]
    began = time.process_time()
    assert stable_intervals(members, 0.3, 58)
    assert time.process_time() - began < 10  # about a second where each has a range of its own, else milliseconds


@pytest.mark.parametrize("n, length, step", [(2, 0.5, 0.02), (40, 0.5, 0.02), (500, 0.25, 0.02), (500, 9.0, 0.05)])
def test_all_frames_at_once(n, length, step):
    rng = np.random.default_rng(n)
    t, y = np.sort(rng.uniform(0, 0.1 if n == 2 else 4, n)), rng.normal(size=n)
    w = LogTimeWindow(t, length, step)
    i, j = w.frames(w.count())
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [w.frame(k) for k in range(w.count() + 1)]
    got = frame_distances(t, y, i[1:], j[1:])
    assert np.allclose(got, [slope_distances(t[a:z], y[a:z]) for a, z in zip(i[1:], j[1:], strict=True)], rtol=1e-12)
