"""Numeric kernels on arrays, for the few steps that are sequential or iterative."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def wall_cuts(h: np.ndarray, prominence: np.ndarray | float) -> np.ndarray:
    """For each wall the highest valley that it stands at least `prominence` above: the largest v with h - v >= prominence in doubles."""
    lo = h - prominence
    hi = lo + np.spacing(np.abs(lo)) + 2 * np.spacing(np.abs(np.float64(prominence)))
    lo = lo - np.spacing(np.abs(lo))
    while True:  # halves to neighbouring doubles
        mid = lo + (hi - lo) / 2
        inner = (mid > lo) & (mid < hi)
        if not inner.any():
            return np.where(h - hi >= prominence, hi, lo)
        high = h - mid >= prominence
        lo, hi = np.where(inner & high, mid, lo), np.where(inner & ~high, mid, hi)


def clamp(x: np.ndarray | float, lo: np.ndarray | float, hi: np.ndarray | float) -> np.ndarray:
    return np.maximum(np.minimum(x, hi), lo)


def clamps_before(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All clamps before each place as one clamp, and last all of them: clamps compose to clamps, so the places double in log n steps."""
    lo, hi, d = lo.copy(), hi.copy(), 1
    while d < len(lo):
        lo[d:], hi[d:] = clamp(lo[:-d], lo[d:], hi[d:]), clamp(hi[:-d], lo[d:], hi[d:])
        d *= 2
    return np.concatenate(([-np.inf], lo)), np.concatenate(([np.inf], hi))


class Slice(NamedTuple):
    """A stretch of samples: its flats (first and last place, value) and for each flat the clamps between it and the stretch's ends.

    A valley of value v has a wall of the prominence on its left if x >= v, where x
    is the highest valley that the samples before it leave possible. Each sample of
    value h takes x to at most h, as valleys above it end there, and to at least the
    valley that h itself is a wall for: a clamp. So what any stretch does to x is
    two numbers, and stretches can be worked on apart and put together."""

    head: np.ndarray
    tail: np.ndarray
    value: np.ndarray
    left: tuple[np.ndarray, np.ndarray]  # one more than flats: the last is the whole stretch, from left to right
    right: tuple[np.ndarray, np.ndarray]  # one more than flats: the first is the whole stretch, from right to left


def flats_and_walls(p: np.ndarray, cuts: np.ndarray) -> Slice:
    """The slice of samples p, with the highest valley that each is a wall for."""
    head = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    v = p[head]
    cut = np.minimum(cuts[head], v)
    lo, hi = clamps_before(cut[::-1], v[::-1])
    return Slice(head, np.append(head[1:], len(p)) - 1, v, clamps_before(cut, v), (lo[::-1], hi[::-1]))


def low_flats(s: Slice) -> np.ndarray:
    """The inner flats below both neighbours that no wall within the stretch rules out."""
    v = s.value
    k = np.flatnonzero((v[1:-1] < v[:-2]) & (v[1:-1] < v[2:])) + 1
    return k[(s.left[1][k] >= v[k]) & (s.right[1][k + 1] >= v[k])]


def prominent_valleys(p: np.ndarray, prominence: float) -> np.ndarray:
    """Indices of the interior valleys of at least this prominence.

    A valley is strictly below what stands on both sides; a flat one is reported
    at its middle, rounded down. Its prominence is how far the lower of its two
    walls rises above it, where a wall reaches to the next lower sample or the end."""
    if len(p) < 3:
        return np.zeros(0, np.int64)
    s = flats_and_walls(p, wall_cuts(p, prominence))
    k = low_flats(s)
    k = k[(s.left[0][k] >= s.value[k]) & (s.right[0][k + 1] >= s.value[k])]
    return (s.head[k] + s.tail[k]) // 2


class Edge(NamedTuple):
    """What a slice's neighbours need of it: its first and last flat, and its clamps from either side."""

    slice: int
    n: int
    first: float
    first_tail: int
    second: float  # nan if the slice is one flat
    last: float
    last_head: int
    last_but_one: float
    whole_left: tuple[float, float]
    whole_right: tuple[float, float]
    last_left: tuple[float, float]  # before the last flat
    first_right: tuple[float, float]  # behind the first flat


def stitch(edges: list[Edge]) -> list[tuple[int, float, float, list[int]]]:
    """(slice, x from its left, x from its right, places of valleys among flats at its edges) for the slices of a well in order.

    A flat that runs over a boundary is one flat; its middle may be in another slice than its ends."""
    none, start = -np.inf, np.concatenate(([0], np.cumsum([e.n for e in edges])))
    left, right = [none], [none]
    for e in edges[:-1]:
        left.append(float(clamp(left[-1], *e.whole_left)))
    for e in edges[:0:-1]:
        right.append(float(clamp(right[-1], *e.whole_right)))
    right.reverse()
    flats: list[list] = []  # value, first and last place, value before, x from the left, value behind, x from the right
    for i, e in enumerate(edges):
        parts = [(e.first, 0, e.first_tail, np.nan, left[i], e.second, float(clamp(right[i], *e.first_right)))]
        if e.first_tail < e.n - 1:
            parts.append((e.last, e.last_head, e.n - 1, e.last_but_one, float(clamp(left[i], *e.last_left)), np.nan, right[i]))
        for k, (v, a, z, before, xl, behind, xr) in enumerate(parts):
            if k == 0 and flats and flats[-1][0] == v:
                flats[-1][2], flats[-1][5], flats[-1][6] = start[i] + z, behind, xr
                continue
            if k == 0 and flats:
                flats[-1][5], before = v, flats[-1][0]
            flats.append([v, start[i] + a, start[i] + z, before, xl, behind, xr])
    found: list[list[int]] = [[] for _ in edges]
    for v, a, z, before, xl, behind, xr in flats:
        if v < before and v < behind and xl >= v and xr >= v:
            at = (a + z) // 2
            i = int(np.searchsorted(start, at, side="right")) - 1
            found[i].append(int(at - start[i]))
    return [(e.slice, xl, xr, f) for e, xl, xr, f in zip(edges, left, right, found, strict=True)]


@cache
def _parabola(width: int) -> np.ndarray:
    """Least squares for a parabola over a window's places."""
    h = width // 2
    return np.linalg.pinv(np.vander(np.arange(-h, h + 1), 3))


def savgol_quadratic(y: np.ndarray, width: int) -> np.ndarray:
    """Savitzky-Golay smoothing of order 2; the ends follow the parabola of the end windows."""
    h = width // 2
    x = np.arange(-h, h + 1)
    fit = _parabola(width)
    out = np.convolve(y, fit[2][::-1], mode="same")
    for part, at in ((y[:width], slice(0, h)), (y[-width:], slice(len(y) - h, len(y)))):
        curve = np.polyval(fit @ part, x)
        out[at] = curve[:h] if at.start == 0 else curve[-h:]
    return out


def theil_sen_slopes(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """For each row of windows: the slope of the spatial median of all two-point lines (modified Weiszfeld).

    A window is done when a round moves its median by less than 1e-10."""
    i, j = np.triu_indices(x.shape[1], 1)
    slope = (y[:, j] - y[:, i]) / (x[:, j] - x[:, i])
    icpt = y[:, i] - slope * x[:, i]
    a, b = icpt.mean(axis=1), slope.mean(axis=1)
    live = np.arange(len(x))
    for _ in range(rounds):
        da, db = icpt - a[live, None], slope - b[live, None]
        dist = np.sqrt(da * da + db * db)
        on = dist < 1e-12
        weight = np.where(on, 0, 1 / np.where(on, 1, dist))
        total = np.maximum(weight.sum(axis=1), 1e-300)
        move_a, move_b = (da * weight).sum(axis=1), (db * weight).sum(axis=1)
        stay = np.where(on.any(axis=1), np.minimum(1, 1 / np.maximum(np.hypot(move_a, move_b), 1e-300)), 0)
        move_a, move_b = (1 - stay) * move_a / total, (1 - stay) * move_b / total
        a[live] += move_a
        b[live] += move_b
        more = np.maximum(np.abs(move_a), np.abs(move_b)) >= 1e-10
        if not more.any():
            break
        live, icpt, slope = live[more], icpt[more], slope[more]
    return b


def group_bounds(t: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where runs of equal values in the first `keys` columns begin, and the end."""
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for c in t.columns[:keys]:
        new |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)), True).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(new) + 1, [t.num_rows])) if t.num_rows else np.zeros(1, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches again, cut so that no run of equal keys is split between two."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = int(group_bounds(b, keys)[-2])
        if last == 0 and held and all(held[-1].column(k)[-1] == b.column(k)[0] for k in range(keys)):
            held.append(b)  # one group all through
            continue
        if last:
            held.append(b.slice(0, last))
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bourdet_points(dt: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, middle and right point of each left point that finds its two right ones."""
    n = len(dt)
    i = np.arange(max(n - 2, 0))
    j = np.maximum(np.searchsorted(dt, dt[i] * np.exp(smoothing), side="right"), i + 1)
    i, j = i[j < n], j[j < n]
    k = np.maximum(np.searchsorted(dt, dt[j] * np.exp(smoothing), side="right"), j + 1)
    short = np.maximum(np.searchsorted(dt, dt[j] * np.exp(smoothing / 2), side="right"), j + 1)
    k = np.where(k < n, k, short)
    return i[k < n], j[k < n], k[k < n]


def bourdet_slopes(s: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The derivative of each three points, and where there is none, as two superpositions are equal. Infinite superpositions give what doubles give."""
    d1, d2 = np.abs(p[j] - p[i]), np.abs(p[k] - p[j])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        x1, x2 = s[j] - s[i], s[k] - s[j]
        d = (d1 / x1 * x2 + d2 / x2 * x1) / (x1 + x2) / np.log(10)
        return d, (x1 == 0) | (x2 == 0) | (x1 + x2 == 0)


def bourdet(s: np.ndarray, p: np.ndarray, dt: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of the middle point and derivative for each left point that finds its two right ones; nan where it is not finite."""
    i, j, k = bourdet_points(dt, smoothing)
    d, _ = bourdet_slopes(s, p, i, j, k)
    return j, np.where(np.isfinite(d), d, np.nan)


def log_terms(at: pa.Array, upto: pa.Array, scale: pa.Array, steps: pa.Array, sign: float) -> pa.Array:
    """For each row the sum of sign * change / scale * log10(at - begin) over its steps (number, begin, change) up to the number `upto`, added in their order.

    Logarithms are those of the C library, as in DuckDB; at a step's very start that is -inf. Null where scale is null or 0, or a change is null."""
    owner = np.repeat(np.arange(len(at)), steps.value_lengths().to_numpy())
    number, begin, change = (x.to_numpy(zero_copy_only=False) for x in steps.flatten().flatten())
    at, upto, scale = (x.to_numpy(zero_copy_only=False) for x in (at, upto, scale))
    use = number <= upto[owner]
    owner, begin, change = owner[use], begin[use], change[use].astype(float)
    none = np.isnan(scale.astype(float)) | (scale == 0)
    none[owner[np.isnan(change)]] = True
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        term = sign * (change / scale[owner]) * np.log10(at[owner] - begin)
        return pa.array(np.bincount(owner, weights=term, minlength=len(at)), mask=none)


def wilcoxon_p(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided signed-rank p value: exact for up to 50 untied differences, else normal with ties corrected; nan if all are 0."""
    d = np.asarray(a, float) - np.asarray(b, float)
    zeros = (d == 0).any()
    d = d[d != 0]
    n = len(d)
    if not n:
        return float("nan")
    order = np.argsort(np.abs(d), kind="stable")
    size = np.abs(d)[order]
    cut = np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1])))
    ties = np.diff(np.append(cut, n))
    rank = np.empty(n)
    rank[order] = np.repeat(cut + (ties + 1) / 2, ties)
    plus = rank[d > 0].sum()
    least = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not zeros and (ties == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(least) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties.astype(float) ** 3 - ties).sum() / 48
    if var <= 0:
        return float("nan")
    from math import erfc, sqrt

    return float(erfc(abs(least - n * (n + 1) / 4) / sqrt(var) / sqrt(2)))
