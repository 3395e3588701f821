"""Patterns that stay the same over the transients of a time-lapse group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugewright.functions.grids import on_log_grid
from gaugewright.functions.kernels import group_bounds, whole_groups
from gaugewright.operators.regimes import DISTANCES, REGIMES, LogTimeWindow, Params, classify

# The codes that a stable pattern can have, the lowest and the top correlation threshold, slope bounds of regimes.
STABLE = (0, 1, 2)
LEAST, TOP = 0.5, 0.99
FLAT, STEEP = 0.1, 0.8
BLOCK = 64  # members that are correlated with as many others at once
INTERVAL = "regime string, start double, end double, confidence double, dropped int"


def detect_features(frame: DataFrame, group: str = "group_id", member: str = "transient_id", params: Params = Params(), deep: bool = False, **columns: str) -> DataFrame:
    """Optimised regimes of every transient, each on its own."""
    return classify(frame, [group, member], params, optimize=True, deep=deep, **columns)


def distinct_regimes(detected: DataFrame, group: str = "group_id", member: str = "transient_id") -> DataFrame:
    """group, member, n_regimes (distinct), n_radial (points) of each transient; n_radial is 0 where none is radial."""
    return detected.groupBy(group, member).agg(F.countDistinct("regime").alias("n_regimes"), F.count_if(F.col("regime") == 0).alias("n_radial"))


def combine_distances(distances: Column) -> Column:
    """From five slope distances to three regime ones: the two least keep their value; in one family the larger of them."""
    ranked = F.slice(F.array_sort(F.transform(distances, lambda d, i: F.struct(d.alias("d"), i.alias("i")))), 1, 2)
    family = lambda x: F.floor((x["i"] + 1) / 2)  # noqa: E731  0 | 1 2 | 3 4
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.try_element_at(F.transform(F.filter(ranked, lambda x: family(x) == r), lambda x: x["d"]), F.lit(-1)))


def distance_likelihood(combined: Column) -> Column:
    """Each regime's share of the inverse distances."""
    inverse = F.transform(combined, lambda d: F.coalesce(F.try_divide(F.lit(1.0), d), F.lit(0.0)))
    total = F.aggregate(inverse, F.lit(0.0), lambda a, v: a + v)
    return F.transform(inverse, lambda v: F.try_divide(v, total))


def with_likelihoods(regimes: DataFrame) -> DataFrame:
    return regimes.withColumn("combined", combine_distances(F.array(*DISTANCES))).withColumn("likelihood", distance_likelihood(F.col("combined")))


def _islands(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def regime_confidence(members: list[tuple[np.ndarray, np.ndarray]], code: int, start: float, end: float) -> np.ndarray:
    """Share of the interval's log span that each transient spends in the regime, from its first to its last such point."""
    span = np.log10(end) - np.log10(start)
    out = np.zeros(len(members))
    for i, (t, r) in enumerate(members):
        own = t[(r == code) & (t >= start) & (t <= end)]
        out[i] = (np.log10(own[-1]) - np.log10(own[0])) / span if len(own) > 1 else 0
    return out


def _longest(r: np.ndarray, first: np.ndarray, last: np.ndarray, log_grid: np.ndarray, reach: np.ndarray, least: int) -> tuple[int, float, int, int] | None:
    """How many members at most share an interval that is long enough, and the longest one that so many share: (number, length, start, end).

    r: for each member and grid point where its run of the code began, beyond the
    grid if it has another code there. first and last: the members that set the grid's
    ends, of which one each must be among those that share. reach: the latest
    start with which an interval that ends at a point is long enough."""
    edge = np.maximum(r[first].min(axis=0), r[last].min(axis=0))
    if least == 1:  # a single member sets both ends itself
        both = r[first & last]
        alone = both.min(axis=0) if len(both) else np.full(r.shape[1], r.shape[1])
    share = np.where(edge <= reach, (r <= reach).sum(axis=0), 0)
    if least == 1 and share.max() == 1:
        edge = alone
        share = np.where(edge <= reach, share, 0)
    most = int(share.max())
    if most < least:
        return None
    start = np.maximum(np.partition(r, most - 1, axis=0)[most - 1], edge)
    length = np.where(start <= reach, log_grid - log_grid[np.minimum(start, len(log_grid) - 1)], -1)
    end = int(length.argmax())
    return most, float(length[end]), int(start[end]), end


def stable_intervals(members: list[tuple[np.ndarray, np.ndarray]], minimum: float = 0.3, max_drop: int = 2, points: int = 500) -> list[tuple[int, float, float, float, int]]:
    """(regime, start, end, confidence, dropped): the longest interval in which all kept transients have a regime.

    As few transients are left out as will do; of the sets of one size the longest
    interval counts, of equal ones the first. Codes between points are interpolated and must be met exactly.

    Kept transients share a log-spaced grid from their latest start to their earliest
    end, so there are as many grids as pairs of a start and an end, not one for
    each subset. On a grid each member's runs of a code are found once; an interval is
    shared by the members whose run began at or before its start, so the k-th
    smallest of those beginnings is where the longest interval of k members starts."""
    n = len(members)
    least = n - min(max_drop, n - 1)
    starts, ends = np.array([m[0][0] for m in members]), np.array([m[0][-1] for m in members])
    inside = lambda lo, hi: (starts <= lo) & (ends >= hi)
    pairs = [(int(inside(lo, hi).sum()), lo, hi) for lo in np.unique(starts) for hi in np.unique(ends) if 0 < lo < hi and np.log10(hi) - np.log10(lo) >= minimum - 1e-9]
    best: dict[int, tuple[float, float, float]] = {}
    at, kept = np.arange(points), least
    for size, lo, hi in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        own = np.flatnonzero(inside(lo, hi))
        first, last = starts[own] == lo, ends[own] == hi
        if size < kept or not first.any() or not last.any():
            continue
        grid = np.logspace(np.log10(lo), np.log10(hi), points)
        log_grid = np.log10(grid)
        reach = np.searchsorted(log_grid, log_grid - minimum, side="right") - 1
        reach = np.where((reach >= 0) & (log_grid - log_grid[reach] >= minimum), reach, reach - 1)
        codes = np.stack([np.interp(grid, *members[i]) for i in own])
        for code in STABLE:
            other = codes != code
            r = np.where(other, points, np.maximum.accumulate(np.where(other, at, -1), axis=1) + 1)
            found = _longest(r, first, last, log_grid, reach, kept)
            if found is None:
                continue
            most, length, a, b = found
            if most > kept:
                kept, best = most, {}
            if length > best.get(code, (0.0,))[0] or length == best[code][0] and grid[a] < best[code][1]:
                best[code] = (length, grid[a], grid[b])
    return [(code, float(a), float(b), float(np.prod(regime_confidence(members, code, a, b))), n - kept) for code, (_, a, b) in sorted(best.items())]


def _members(g: pd.DataFrame, member: str, *columns: str) -> list[tuple[np.ndarray, ...]]:
    return [tuple(m[c].to_numpy(np.float64) for c in columns) for _, m in g.sort_values([member, columns[0]]).groupby(member, sort=True)]


def get_interval(regimes: DataFrame, group: str = "group_id", member: str = "transient_id", minimum: float = 0.3, max_drop: int | None = 2) -> DataFrame:
    """group, regime, start, end, confidence, dropped: stable intervals of each group; max_drop None: all but two may be left out."""
    kind = dict(regimes.dtypes)[group]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = _members(g, member, "time", "regime")
        rows = stable_intervals(m, minimum, max(len(m) - 2, 0) if max_drop is None else max_drop)
        return pd.DataFrame([(g[group].iloc[0], REGIMES[c], a, b, p, d) for c, a, b, p, d in rows], columns=[group, "regime", "start", "end", "confidence", "dropped"])

    return regimes.select(group, member, "time", "regime").groupBy(group).applyInPandas(run, f"{group} {kind}, {INTERVAL}")


def get_stable_pattern(regimes: DataFrame, group: str = "group_id", member: str = "transient_id", minimum: float = 0.3) -> DataFrame:
    """Stable intervals where all but two transients may be left out."""
    return get_interval(regimes, group, member, minimum, None)


def distance_confidence(regimes: DataFrame, intervals: DataFrame, group: str = "group_id", member: str = "transient_id") -> DataFrame:
    """group, member, regime, confidence: the mean likelihood of an interval's regime within it."""
    names = F.create_map(*[F.lit(x) for k in STABLE for x in (REGIMES[k], k)])
    x = with_likelihoods(regimes.filter(~F.col("regime").isin(3, 4))).select(group, member, "time", "likelihood").join(intervals.select(group, F.col("regime").alias("name"), "start", "end"), group)
    x = x.filter(F.col("time").between(F.col("start"), F.col("end")))
    return x.groupBy(group, member, F.col("name").alias("regime")).agg(F.avg(F.get("likelihood", F.try_element_at(names, "name"))).alias("confidence"))


def correlated_interval(corr: np.ndarray, threshold: float) -> tuple[int, int] | None:
    """The run over the threshold with the highest mean."""
    runs = _islands(corr > threshold)
    return max(runs, key=lambda r: (corr[r[0] : r[1] + 1].mean(), -r[0])) if runs else None


def thresholds(least: float = LEAST) -> list[float]:
    """Five nested correlation thresholds from `least` up."""
    return [float(x) for x in np.round(np.linspace(least, 1, 5), 2)[:-1]] + [TOP]


def shared_curves(frame: DataFrame, group: str = "group_id", member: str = "transient_id", time: str = "time", derivative: str = "derivative", points: int = 500) -> DataFrame:
    """group, member, lo, hi, n, g, x, y: log derivatives over log time, on the grid from the latest start of a group's members to their earliest end.

    lo, hi: log10 of the grid's ends, n: the group's members. A derivative of 0 or less has log 0.
    Groups of one member, or whose members share no stretch of positive times, have no rows."""
    f = frame.select(group, member, F.col(time).cast("double").alias("t"), F.col(derivative).cast("double").alias("d")).na.drop()
    own = f.groupBy(group, member).agg(F.min("t").alias("a"), F.max("t").alias("z"))
    span = own.groupBy(group).agg(F.max("a").alias("a"), F.min("z").alias("z"), F.count(F.lit(1)).alias("n")).filter("n > 1 and a > 0 and a < z")
    span = span.select(group, "n", F.log10("a").alias("lo"), F.log10("z").alias("hi"))
    f = f.select(group, member, F.greatest("t", F.lit(1e-300)).alias("t"), F.coalesce(F.log10(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("y"))
    on = on_log_grid(f.join(span, group), [group, member, "n", "lo", "hi"], "t", ["y"], F.col("lo"), F.col("hi"), points, log_x=True)
    return on.select(group, member, "lo", "hi", "n", "g", (F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"), "y")


def _least_correlations(x: np.ndarray, y: np.ndarray | None, frames: list[tuple[int, int]]) -> np.ndarray:
    """For each frame the least absolute correlation of any row of x with any of y, or with y None of any two rows of x, each with itself included; nan if there are none.

    Rows that are constant in a frame correlate with nothing."""
    out = np.full(len(frames), np.nan)

    def unit(rows: np.ndarray) -> np.ndarray:
        rows = rows[rows.max(axis=1) > rows.min(axis=1)]
        rows = rows - rows.mean(axis=1, keepdims=True)
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))

    for n, (i, j) in enumerate(frames):
        if i >= 0 and j - i > 1:
            a = unit(x[:, i:j])
            b = a if y is None else unit(y[:, i:j])
            if len(a) and len(b):
                out[n] = min(1.0, np.abs(a @ b.T).min())
    return out


def window_correlations(curves: DataFrame, group: str = "group_id", member: str = "transient_id", points: int = 500, length: float = 0.5, step: float = 0.02, block: int = BLOCK) -> DataFrame:
    """group, window, lo, hi, first, last, corr: for each log-time window the least absolute correlation of any two members' curves; first and last: its grid points, the last included.

    curves: as shared_curves gives them. Members that are constant in a window are
    skipped; if no other is left corr is null. Members are dealt to blocks of about
    `block`, and two blocks meet in one piece of work, which gives one row a window:
    neither the members of a large group nor their pairs come together in one task."""
    kind = curves.schema[group]
    whole = curves.groupBy(group, member, "lo", "hi", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "y"))), lambda p: p["y"]).alias("y"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = whole.withColumn("own", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(group, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "lo", "hi", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3):
            bounds, lo, hi = group_bounds(t, 3), t.column("lo").to_numpy(), t.column("hi").to_numpy()
            a, b, own = (t.column(c).to_numpy() for c in ("a", "b", "own"))
            ys, at, cols = t.column("y").flatten().to_numpy().reshape(-1, points), [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                win = LogTimeWindow(np.linspace(lo[s], hi[s], points), length, step)
                frames = [win.frame(n) for n in range(win.count())]
                x, y = ys[s:e][own[s:e] == a[s]], None if a[s] == b[s] else ys[s:e][own[s:e] == b[s]]
                if len(x) and (y is None or len(y)):
                    at += [s] * len(frames)
                    cols.append(np.stack([np.arange(len(frames)), [max(i, 0) for i, _ in frames], [j - 1 for _, j in frames], _least_correlations(x, y, frames)]))
            if cols:
                w, i, j, c = np.concatenate(cols, axis=1)
                own_rows = t.select([group, "lo", "hi"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own_rows.columns, *(pa.array(x.astype(np.int32)) for x in (w, i, j)), pa.array(c, from_pandas=True)], names=[group, "lo", "hi", "window", "first", "last", "corr"])

    schema = StructType([kind]).add("lo", "double").add("hi", "double").add("window", "integer").add("first", "integer").add("last", "integer").add("corr", "double")
    met = dealt.repartition(group, "a", "b").sortWithinPartitions(group, "a", "b").mapInArrow(run, schema)
    return met.groupBy(group, "window").agg(*[F.first(c).alias(c) for c in ("lo", "hi", "first", "last")], F.min("corr").alias("corr"))


def correlation_analysis(frame: DataFrame, group: str = "group_id", member: str = "transient_id", time: str = "time", derivative: str = "derivative", points: int = 500, length: float = 0.5, step: float = 0.02, least: float = LEAST) -> DataFrame:
    """group, threshold, start, end, regime: for nested thresholds, where the log derivatives of all transients correlate, and the regime of their mean slope there.

    Only a group's windows come together to be searched, some dozens for each
    decade of time however many members it has. The slopes are those of the lowest threshold's interval."""
    curves = shared_curves(frame, group, member, time, derivative, points)
    found_type = StructType([curves.schema[group]]).add("level", "integer").add("threshold", "double").add("first", "integer").add("last", "integer").add("start", "double").add("end", "double")
    levels = thresholds(least)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            bounds, out, at = group_bounds(t, 1), [], []
            lo, hi, first, last = (t.column(c).to_numpy() for c in ("lo", "hi", "first", "last"))
            corr = t.column("corr").to_numpy(zero_copy_only=False)
            corr = np.where(np.isnan(corr), -1.0, corr)
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = s, e - 1
                for level, threshold in enumerate(levels):
                    hit = correlated_interval(corr[a : b + 1], threshold)
                    if hit is None:
                        break
                    a, b = a + hit[0], a + hit[1]
                    at.append(s)
                    out.append((level, threshold, first[a], last[b], *(10 ** (lo[s] + (hi[s] - lo[s]) * k / (points - 1)) for k in (first[a], last[b]))))
            if out:
                cols = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([t.column(group).take(pa.array(at)), *cols], names=found_type.names)

    windows = window_correlations(curves, group, member, points, length, step)
    found = windows.select(group, "window", "lo", "hi", "first", "last", "corr").repartition(group).sortWithinPartitions(group, "window").mapInArrow(search, found_type)
    inside = curves.join(found.filter("level = 0").select(group, "first", "last"), group).filter((F.col("g") >= F.col("first")) & (F.col("g") < F.col("last")))  # the last point is left out
    slope = inside.groupBy(group, member).agg(F.regr_slope("y", "x").alias("b")).groupBy(group).agg(F.avg("b").alias("b"))
    b = F.col("b")
    regime = F.when(F.abs(b) <= FLAT, "Radial").when((b > FLAT) & (b < STEEP), "Linear-up").when((b < -FLAT) & (b > -STEEP), "Linear-down").otherwise("Not defined")
    return found.join(slope, group, "left").select(group, "threshold", "start", "end", regime.alias("regime"))


def min_pair_correlation(values: DataFrame, group: list[str], window: str, member: str, at: str, value: str) -> DataFrame:
    """group, window, corr: the least absolute correlation of any two members over a window's points."""
    a = values.select(*group, window, at, F.col(member).alias("a"), F.col(value).alias("va"))
    b = values.select(*group, window, at, F.col(member).alias("b"), F.col(value).alias("vb"))
    pairs = a.join(b, [*group, window, at]).filter("a < b").groupBy(*group, window, "a", "b").agg(F.corr("va", "vb").alias("c"))
    return pairs.groupBy(*group, window).agg(F.min(F.abs("c")).alias("corr"))


def pivot_intervals(intervals: DataFrame, group: str = "group_id") -> DataFrame:
    """Start, end and confidence as rows, regimes as columns."""
    names = [REGIMES[k] for k in STABLE]
    long = intervals.select(group, "regime", F.explode(F.create_map(F.lit("start"), F.col("start"), F.lit("end"), F.col("end"), F.lit("confidence"), F.col("confidence"))).alias("row", "v"))
    return long.groupBy(group, "row").pivot("regime", names).agg(F.first("v"))
