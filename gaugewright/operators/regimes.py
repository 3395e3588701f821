"""Flow regimes of a log-log transient by distances to reference slopes over hopping log-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gaugewright.functions.bayes import minimize
from gaugewright.functions.grids import on_log_grid
from gaugewright.functions.kernels import group_bounds, savgol_quadratic, theil_sen_slopes, whole_groups
from gaugewright.functions.numeric import ratio
from gaugewright.functions.staging import keep, united

# Reference slopes, their names, and the regimes' codes and names.
SLOPES = (0.0, 0.176, 0.364, -0.176, -0.364)
DISTANCES = ("zero_slope", "linear_up_1", "linear_up_2", "linear_down_1", "linear_down_2")
REGIMES = {0: "Radial", 1: "Linear-up", 2: "Linear-down", 3: "Boundary", 4: "WBS"}
METRICS = ("euclidean", "manhattan", "cosine", "chebyshev")
_OF_SLOPE = np.array([0, 1, 1, 2, 2, 3])
POINTS = 500
SEARCHES = ("grid", "bayes")
CALLS = 40
SERIAL = 1 << 17  # products of a matrix that a linear algebra library does in one thread: more than one in every task would wait for one another
OWN = ("_window_length", "_filter_value")


@dataclass
class LogTimeWindow:
    """Hopping windows over sorted log times: window n starts at t0 + step * n and is `length` long."""

    time: np.ndarray
    length: float
    step: float

    def count(self) -> int:
        span = self.time[-1] - self.time[0]
        return 1 if span < self.length else int((span - self.length) / self.step) + 2

    def check(self) -> None:
        if len(self.time) < 2:
            raise ValueError("at least two points are needed for windows")
        if self.length < np.diff(self.time).max():
            raise ValueError("the window is shorter than a gap between points")

    def frame(self, n: int) -> tuple[int, int]:
        """First and end index of the frame numbered n: it starts one step before window n's start (so frame 0 begins before the data)."""
        t, start = self.time, self.time[0] + self.step * (n - 1)
        i = int(np.searchsorted(t, start, side="right")) - 1
        j = i + int(np.searchsorted(t[i:], start + self.length, side="right"))
        # j may be -1 or 0 for frame 0: t[j - 1] then counts from the end, which decides whether it covers all or nothing
        covered = t[j - 1] if j < len(t) else t[-1]
        return i, len(t) if covered > t[-1] - self.step else j

    def frames(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end indices of the frames 0 to `upto`, all at once."""
        t, start = self.time, self.time[0] + self.step * (np.arange(upto + 1) - 1)
        i = np.searchsorted(t, start, side="right") - 1
        j = np.searchsorted(t, start + self.length, side="right")
        j[i < 0] = np.where(t[-1] <= start[i < 0] + self.length, 0, -1)
        covered = np.where(j < len(t), t[j - 1], t[-1])
        return i, np.where(covered > t[-1] - self.step, len(t), j)


@dataclass(frozen=True)
class Params:
    window_length: float = 0.5
    window_step: float = 0.02
    metric: str = "euclidean"  # checked, but distances are Euclidean over n whatever it says
    filter_value: float = 0.0
    fragment_window: float = 0.5
    slope_threshold: float = 0.7
    dsw: int = 25
    rsw: float = 0.15
    bdw: int = 10
    smooth: bool = False

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}")
        if not isinstance(self.dsw, int) or self.dsw % 2 == 0 or not 1 <= self.dsw <= 50:
            raise ValueError("dsw is an odd whole number from 1 to 50")
        if self.rsw < 0.1:
            raise ValueError("rsw is at least 0.1")
        if not isinstance(self.bdw, int) or isinstance(self.bdw, bool):
            raise TypeError("bdw is a whole number")
        if self.bdw < 2:
            raise ValueError("bdw is at least 2")
        if not -1.5 <= self.filter_value <= 1:
            raise ValueError("filter_value is from -1.5 to 1")
        if not 0.3 <= self.fragment_window <= 1:
            raise ValueError("fragment_window is from 0.3 to 1")


def resample(time: np.ndarray, pressure: np.ndarray, derivative: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-spaced points, linear between samples and beyond the ends; what is not finite is filled along the index."""
    with np.errstate(divide="ignore", invalid="ignore"):
        lt = np.nan_to_num(np.log10(time), nan=0.0, neginf=0.0)
    grid = np.logspace(lt.min(), lt.max(), points)
    at = np.clip(np.searchsorted(time, grid) - 1, 0, len(time) - 2)
    out = []
    for y in (pressure, derivative):
        with np.errstate(divide="ignore", invalid="ignore"):
            v = y[at] + (grid - time[at]) * (y[at + 1] - y[at]) / (time[at + 1] - time[at])
        bad = ~np.isfinite(v)
        if bad.any() and not bad.all():
            v[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(~bad), v[~bad])
        out.append(v)
    return grid, out[0], out[1]


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.log10(x), nan=0.0, neginf=0.0)


@dataclass
class Transient:
    """One fitted transient: resampled, in logs, with its boundary marked."""

    params: Params
    time: np.ndarray
    pressure: np.ndarray
    derivative: np.ndarray
    log_time: np.ndarray = field(init=False)
    log_derivative: np.ndarray = field(init=False)
    inlier: np.ndarray = field(init=False)
    _points: dict[float, tuple[np.ndarray, np.ndarray]] = field(init=False, default_factory=dict)

    @classmethod
    def fit(cls, params: Params, time: np.ndarray, pressure: np.ndarray, derivative: np.ndarray) -> Transient:
        return cls(params, *resample(time, pressure, derivative))

    def __post_init__(self) -> None:
        self.log_time, self.log_derivative = _log(self.time), _log(self.derivative)
        self.inlier = np.ones(len(self.time), bool)
        self._mark_boundary()

    def _smoothed(self, y: np.ndarray) -> np.ndarray:
        if len(y) < 30:
            return y
        return savgol_quadratic(y, 5 if len(y) < 100 else self.params.dsw)

    def _mark_boundary(self) -> None:
        """The trailing run of windows whose mean slope is steep."""
        w, n = self.params.bdw, len(self.time)
        y = self._smoothed(self.log_derivative)
        if n <= 2 * w:
            return
        view = np.lib.stride_tricks.sliding_window_view
        slope = np.abs(theil_sen_slopes(view(self.log_time, w)[: n - w], view(y, w)[: n - w]))
        steep = view(slope, w).mean(axis=1)[: n - 2 * w] > self.params.slope_threshold
        if not len(steep) or not steep[-1]:
            return
        flat = np.flatnonzero(~steep)
        run = len(steep) if not len(flat) else len(steep) - 1 - flat[-1] + w - 1
        self.inlier[-run:] = False

    def points(self, p: Params) -> tuple[np.ndarray, np.ndarray]:
        """Log time and smoothed log derivative to detect on: no boundary, nothing before the filter."""
        if p.filter_value not in self._points:  # a search comes back to its filters
            use = self.inlier & (self.log_time >= p.filter_value)
            self._points[p.filter_value] = self.log_time[use], self._smoothed(self.log_derivative[use])
        return self._points[p.filter_value]

    def least_window(self, p: Params) -> float:
        t, _ = self.points(p)
        if len(t) < 2:
            raise ValueError(f"{len(t)} points cannot be interpreted")
        return float(np.diff(t).max() + 3 * p.window_step)

    def detect(self, p: Params, smooth: bool = False, full: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Codes (by slope, or with full the regimes of all points) and mean distances to the slopes.

        The distances of window n + 1 are those of frame n + 1, but are added to
        the points of frame n: this offset is part of the definition."""
        t, y = self.points(p)
        if len(t) < 2:
            regime = np.zeros(len(t), int)
            return (self._all(regime, p) if full else regime), np.ones((1, len(SLOPES)))
        win = LogTimeWindow(t, p.window_length, p.window_step)
        win.check()
        n = win.count()
        i, j = win.frames(n)
        at = np.arange(len(t))
        cover = ((at >= i[:n, None]) & (at < j[:n, None])).astype(float)
        far = frame_distances(t, y, i[1:], j[1:])
        step = max(1, SERIAL // far.size)
        hits, total = cover.sum(axis=0), np.concatenate([cover[:, a : a + step].T @ far for a in range(0, len(t), step)])
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(hits[:, None] > 0, total / hits[:, None], np.inf)
        regime = mean.argmin(axis=1)
        if smooth:
            regime = self._smooth(regime, t, p)
        return (self._all(regime, p) if full else regime), mean

    def _smooth(self, regime: np.ndarray, t: np.ndarray, p: Params) -> np.ndarray:
        """Runs no longer than rsw give way to the nearest regime that stays; a tail without one is boundary where one was found."""
        keep = np.ones(len(regime), bool)
        for a, b in _runs(regime):
            keep[a:b] = abs(t[b - 1] - t[a]) > p.rsw
        known = np.flatnonzero(keep)
        if not len(known):
            return np.full(len(regime), 5 if self.log_time[-1] > t[-1] else regime[-1])
        at = np.arange(len(regime))
        right = np.minimum(np.searchsorted(known, at), len(known) - 1)
        left = np.maximum(right - 1, 0)
        near = np.where(at - known[left] <= known[right] - at, known[left], known[right])  # of two as near: the earlier
        near = np.where(keep, at, near)
        out = regime[near]
        out[: known[0]] = regime[known[0]]
        out[known[-1] + 1 :] = 5 if self.log_time[-1] > t[-1] else regime[known[-1]]
        return out

    def _all(self, regime: np.ndarray, p: Params) -> np.ndarray:
        """Regimes of all points: by slope, with what the filter and the boundary left out."""
        out = np.where(self.inlier, 4, 3)
        out[self.inlier & (self.log_time >= p.filter_value)] = _OF_SLOPE[regime]
        return out

    def fragments(self, regime: np.ndarray, t: np.ndarray, p: Params) -> list[int]:
        """Points of runs no longer than the fragment window; [1] if all of it is shorter."""
        if not len(t) or abs(t[-1] - t[0]) < p.fragment_window:
            return [1]
        return [i for a, b in _runs(regime) if abs(t[b - 1] - t[a]) <= p.fragment_window for i in range(a, b)]

    def objective(self, p: Params, low: float = -0.5, high: float = 0.5) -> float:
        """Weighted mean distance with a small share of the filter value; 0.1 for a fragmented or impossible detection."""
        regime, mean = self.detect(p)
        t, _ = self.points(p)
        if self.fragments(regime, t, p):
            return 0.1
        best = mean.min(axis=1)
        best = best[np.isfinite(best)]
        weight = np.exp(-2 * np.linspace(0, 1, len(best)))
        scaled = 0.1 + 0.9 * (p.filter_value - low) / (high - low)
        return float(0.9992 * (best @ weight / weight.sum()) + 0.0008 * scaled)

    def optimize(
        self, adjust_filter: bool = True, max_window: float = 1.0, low: float = -0.5, high: float = 0.5, deep: bool = False, search: str = "grid", seed: int = 0, calls: int = CALLS
    ) -> tuple[np.ndarray, np.ndarray, Params]:
        """Search window length and filter value, then the shortest window that leaves no fragments by bisection.

        "grid" is a grid over the box, twice refined around the best; "bayes" takes `calls`
        points (half as many again if deep) by expected improvement under a Gaussian process.
        Both are deterministic, the second by its seed, so that any executor finds the same.
        "bayes" comes to lower values, but where those belong to long windows it can miss a short regime."""
        if search not in SEARCHES:
            raise ValueError(f"search is one of {SEARCHES}")
        base = self.params
        p = _with(base, filter_value=float(low), window_length=float(max_window))
        if len(self.points(p)[0]) < 2:  # nothing to search on, as in a transient that ends before the lowest filter
            return *self.detect(p, full=True), p
        least = self.least_window(p)
        value = lambda w, f: self._try(_with(base, window_length=float(w), filter_value=float(f)), low, high)
        if search == "bayes":
            (window, fil), _ = minimize(lambda x: value(*x), (least, low), (max_window, high), calls * 3 // 2 if deep else calls, seed=seed)
            window, fil = float(window), float(fil)
        else:
            window, fil = self._refined(value, least, max_window, low, high, 6 if deep else 4)
        if len(self.points(_with(base, filter_value=fil))[0]) < 2:  # no place was better than another
            window, fil = least, float(low)
        if adjust_filter:
            fil = self._adjust(window, fil)
        p = _with(base, filter_value=fil)
        left, right = self.least_window(p), max_window
        for _ in range(10):
            if right - left <= 0.01:
                break
            mid = (left + right) / 2
            q = _with(p, window_length=mid)
            regime, _ = self.detect(q)
            if self.fragments(regime, self.points(q)[0], q):
                left = mid
            else:
                right = window = mid
        p = _with(p, window_length=window)
        regime, mean = self.detect(p, smooth=True, full=True)
        return regime, mean, p

    @staticmethod
    def _refined(value: Callable[[float, float], float], least: float, most: float, low: float, high: float, side: int) -> tuple[float, float]:
        """Window length and filter value of the least value on a grid, twice refined around the best."""
        ws, fs = np.linspace(least, most, side), np.linspace(low, high, side + 1)
        best = min((value(w, f), w, f) for w in ws for f in fs)
        for _ in range(2):
            dw, df = (ws[1] - ws[0]) / 2, (fs[1] - fs[0]) / 2
            ws, fs = np.clip(best[1] + dw * np.array([-1, 0, 1]), least, most), np.clip(best[2] + df * np.array([-1, 0, 1]), low, high)
            best = min([best, *((value(w, f), w, f) for w in ws for f in fs)])
        return float(best[1]), float(best[2])

    def _try(self, p: Params, low: float, high: float) -> float:
        try:
            return self.objective(p, low, high)
        except ValueError:
            return 0.1

    def _adjust(self, window: float, fil: float) -> float:
        """Move the filter back to where a short window first sees the regime that is established behind it."""
        try:
            first = self.detect(_with(self.params, window_length=window, filter_value=fil), smooth=True)[0][0]
            p = _with(self.params, filter_value=-1.5, window_length=0.15)
            try:
                regime, _ = self.detect(p)
            except ValueError:
                p = _with(p, window_length=self.least_window(p))
                regime, _ = self.detect(p)
            t, _ = self.points(p)
            before, after = regime[t < fil], regime[t >= fil]
            if after[0] != first:
                return fil
            other = np.flatnonzero(before != after[0])
            return float(t[other[-1]]) if len(other) else fil
        except (IndexError, ValueError):
            return fil


def _with(p: Params, **values: float) -> Params:
    """Parameters the search may set beyond the bounds that users are held to."""
    out = replace(p)
    for k, v in values.items():
        object.__setattr__(out, k, v)
    return out


def _runs(codes: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(codes)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(codes)], strict=True)) if len(codes) else []


def slope_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of the points to the line of each slope through their mean, over their number."""
    if not len(x):
        return np.full(len(SLOPES), np.nan)
    dx, dy = x - x.mean(), y.mean() - y
    return np.sqrt(((np.array(SLOPES)[:, None] * dx + dy) ** 2).sum(axis=1)) / len(x)


def frame_distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """slope_distances of the points i to j of each frame, a row a frame; no frame is empty."""
    n = (j - i)[:, None]
    at = i[:, None] + np.arange(n.max())
    inside = at < j[:, None]
    at = np.minimum(at, len(x) - 1)
    u, v = x[at] * inside, y[at] * inside
    u, v = (u - u.sum(axis=1, keepdims=True) / n) * inside, (v - v.sum(axis=1, keepdims=True) / n) * inside
    uu, uv, vv = (np.einsum("ij,ij->i", a, b)[:, None] for a, b in ((u, u), (u, v), (v, v)))
    s = np.array(SLOPES)
    return np.sqrt(np.maximum(s * s * uu - 2 * s * uv + vv, 0)) / n


def _tasks(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def resampled(frame: DataFrame, keys: list[str], time: str = "time", pressure: str = "pressure", derivative: str = "derivative") -> DataFrame:
    """keys, seq, time, pressure, pressure_derivative: POINTS log-spaced points of each transient of two samples or more.

    What has no value, as between equal times, is filled along the index."""
    f = frame.select(*keys, F.col(time).alias("t"), F.col(pressure).alias("p"), F.col(derivative).alias("d")).na.drop()
    f = f.repartition(_tasks(f), *keys)  # few bytes that become POINTS rows a transient: not for one task
    lt = F.coalesce(F.log10("t"), F.lit(0.0))
    f = f.join(f.groupBy(*keys).agg(F.min(lt).alias("lo"), F.max(lt).alias("hi")), keys)
    x = on_log_grid(f, keys, "t", ["p", "d"], F.col("lo"), F.col("hi"), POINTS, extend=True)
    before, behind = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("g"), F.desc("g")))

    def filled(c: str) -> Column:
        here = F.when(F.col(c).isNotNull() & ~F.isnan(c), F.struct("g", F.col(c).alias("v")))
        a, z = F.last(here, True).over(before), F.last(here, True).over(behind)
        between = a["v"] + F.coalesce(ratio((z["v"] - a["v"]) * (F.col("g") - a["g"]), z["g"] - a["g"]), F.lit(0.0))
        return F.coalesce(between, a["v"], z["v"])

    return x.select(*keys, F.col("g").alias("seq"), F.col("grid").alias("time"), filled("p").alias("pressure"), filled("d").alias("pressure_derivative"))


def _each(points: DataFrame, keys: list[str], added: StructType, work: Callable[[Transient], dict[str, np.ndarray]], params: Params) -> DataFrame:
    """points with what `work` finds for each transient, in Arrow batches of whole transients of POINTS rows.

    Where points have the columns OWN, a transient's own values in them stand before those of params."""
    schema = StructType([*points.schema.fields, *added.fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, n):
            t, p, d = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("time", "pressure", "pressure_derivative"))
            cut = group_bounds(b, n)
            own = [b.column(c).to_numpy(zero_copy_only=False) for c in OWN] if OWN[0] in b.schema.names else []
            of = [_with(params, **{c.strip("_"): float(v[x]) for c, v in zip(OWN, own) if v[x] == v[x]}) for x in cut[:-1]] if own else [params] * (len(cut) - 1)
            found = [work(Transient(q, t[x:y], p[x:y], d[x:y])) for q, x, y in zip(of, cut[:-1], cut[1:], strict=True)]
            cols = [pa.array(np.concatenate([f[c] for f in found]), from_pandas=True) for c in added.names]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)

    # By number: few bytes, but much work for each. By a hash of the keys: Spark leaves out a repartition by what rows are dealt by already, here for
    # the windows before, and then may join those partitions, which are small, into one task.
    return points.repartition(_tasks(points), F.xxhash64(*keys)).sortWithinPartitions(*keys, "seq").mapInArrow(run, schema)


def mean_distances(points: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:
    """keys, seq and DISTANCES: of each point (keys, seq, t, y; t rises with seq) the mean distance to each slope over the frames that cover it.

    Sums of 1, x, y, xx, xy and yy up to a point give all five distances of a frame
    in constant time: frames and points are put in one order, so that a frame's edges
    read the sums at the last point before them, and a frame adds its distances
    where its range begins and takes them back where it ends. The distances of frame n + 1
    go to the points of frame n, as in Transient.detect. Null where no frame covers
    a point; 1 in a transient of one point."""
    by, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = points.withColumn("m", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    x = x.withColumn("u", F.col("t") - F.avg("t").over(by)).withColumn("v", F.col("y") - F.avg("y").over(by)).withColumn("gap", F.col("t") - F.lag("t").over(order))
    terms = {"c": F.lit(1.0), "x": F.col("u"), "y": F.col("v"), "xx": F.col("u") * F.col("u"), "xy": F.col("u") * F.col("v"), "yy": F.col("v") * F.col("v")}
    sums = lambda less: F.struct(*((F.sum(e).over(upto) - (e if less else 0.0)).alias(k) for k, e in terms.items()))
    x = x.select(*keys, "seq", "m", "n", "t", "gap", sums(True).alias("before"), sums(False).alias("after"))
    span = x.groupBy(*keys).agg(
        F.first("n").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max(F.when(F.col("m") == F.col("n") - 2, F.col("t"))).alias("t_prev"), F.max("gap").alias("gap"), F.max_by("after", "m").alias("all")
    )
    length, step = F.lit(float(p.window_length)), F.lit(float(p.window_step))
    extent = F.col("t1") - F.col("t0")
    count = F.when(extent < length, 1).otherwise(((extent - length) / step).cast("int") + 2)
    count = F.when(F.col("gap") > length, F.raise_error(F.lit("the window is shorter than a gap between points")).cast("int")).otherwise(count)
    frames = span.filter("n > 1").withColumn("k", F.explode(F.sequence(F.lit(0), count))).withColumn("start", F.col("t0") + step * (F.col("k") - 1))
    edge = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("kind")), F.struct((F.col("start") + length).alias("t"), F.lit(2).alias("kind"))))
    marks = frames.select(*keys, "k", edge.alias("e")).select(*keys, "k", "e.*")
    rows = united(x.select(*keys, "t", F.lit(0).alias("kind"), "m", "before", "after", F.lit(None).cast("int").alias("k")), marks)
    seen = Window.partitionBy(*keys).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("m", "t", "before", "after")), True).over(seen)
    read = rows.withColumn("p", last).filter("kind > 0").groupBy(*keys, "k").agg(F.max(F.when(F.col("kind") == 1, F.col("p"))).alias("a"), F.max(F.when(F.col("kind") == 2, F.col("p"))).alias("z"))
    f = frames.select(*keys, "k", "n", "t1", "t_prev", "all", "start").join(read, [*keys, "k"])
    # frame 0 starts before all points: its end counts from the last point, so that it covers all or nothing
    sees_last = F.col("t1") <= F.col("start") + length
    end = F.when(F.col("k") > 0, F.col("z.m") + 1).otherwise(F.when(sees_last, 0).otherwise(-1))
    covered = F.when(F.col("k") > 0, F.col("z.t")).otherwise(F.when(sees_last, F.col("t1")).otherwise(F.col("t_prev")))
    whole = covered > F.col("t1") - step
    f = f.withColumn("i", F.coalesce(F.col("a.m"), F.lit(-1))).withColumn("j", F.when(whole, F.col("n")).otherwise(end)).withColumn("to", F.when(whole, F.col("all")).otherwise(F.col("z.after")))
    part = lambda k: F.col(f"to.{k}") - F.col(f"a.before.{k}")
    about = lambda k, one, two: part(k) - part(one) * part(two) / part("c")
    square = lambda s: F.greatest(s * s * about("xx", "x", "x") - 2 * s * about("xy", "x", "y") + about("yy", "y", "y"), F.lit(0.0))
    before = Window.partitionBy(*keys).orderBy("k")
    f = f.select(*keys, "k", F.greatest(F.lag("i").over(before), F.lit(0)).alias("i"), F.greatest(F.lag("j").over(before), F.lit(0)).alias("j"), *((F.sqrt(square(s)) / part("c")).alias(d) for s, d in zip(SLOPES, DISTANCES, strict=True)))
    events = f.filter("k > 0").select(*keys, F.explode(F.array(F.struct(F.col("i").alias("m"), F.lit(1).alias("s")), F.struct(F.col("j").alias("m"), F.lit(-1).alias("s")))).alias("e"), *DISTANCES)
    events = events.groupBy(*keys, F.col("e.m").alias("m")).agg(F.sum("e.s").alias("hits"), *(F.sum(F.col("e.s") * F.col(d)).alias(d) for d in DISTANCES))
    run = Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    y = x.select(*keys, "seq", "m", "n").join(events, [*keys, "m"], "left").withColumn("hits", F.sum("hits").over(run))
    return y.select(*keys, "seq", *(F.when(F.col("n") < 2, 1.0).when(F.col("hits") > 0, F.sum(d).over(run) / F.col("hits")).alias(d) for d in DISTANCES))


def _searched(points: DataFrame, keys: list[str], params: Params, optimize: bool, deep: bool, **how: object) -> DataFrame:
    """points with regime and DISTANCES, by the searched or by fixed parameters: a transient, POINTS rows, is worked on as a whole, so its points are shuffled once."""
    names = ["regime", "window_length", "filter_value", *DISTANCES]
    added = StructType([StructField(c, IntegerType() if c == "regime" else DoubleType()) for c in names])

    def search(t: Transient) -> dict[str, np.ndarray]:
        regime, mean, p = t.optimize(deep=deep, **how) if optimize else (*t.detect(t.params, smooth=t.params.smooth, full=True), t.params)
        use = np.flatnonzero(t.inlier & (t.log_time >= p.filter_value))
        dist = np.full((len(t.time), len(SLOPES)), np.nan)
        dist[use[: len(mean)]] = np.where(np.isfinite(mean), mean, np.nan)[: len(use)]
        fixed = {"regime": regime.astype(np.int32), "window_length": np.full(len(t.time), p.window_length), "filter_value": np.full(len(t.time), p.filter_value)}
        return fixed | {c: dist[:, k] for k, c in enumerate(DISTANCES)}

    return _each(points, keys, added, search, params)


def classify(
    frame: DataFrame, keys: list[str], params: Params = Params(), optimize: bool = False, deep: bool = False, time: str = "time", pressure: str = "pressure", derivative: str = "derivative",
    found: DataFrame | None = None, **how: object,
) -> DataFrame:
    """seq, resampled time, pressure and derivative, their logs, regime and distances: POINTS rows for each transient.

    Transients are independent groups; fewer than two samples give no rows. Detection and search
    run on whole transients, which POINTS bounds, in sorted batches. `how` goes to
    Transient.optimize. `found` (keys, window_length, filter_value; a row a transient) gives transients
    their own parameters, with regimes smoothed; the others take those of params."""
    own = [f"_key{i}" for i in range(len(keys))]  # whatever the keys are called, they meet no name of the steps
    src = frame.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(time).alias("time"), F.col(pressure).alias("pressure"), F.col(derivative).alias("derivative"))
    points = resampled(src, own)
    if found is not None:
        mine = found.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), *(F.col(c.strip("_")).alias(c) for c in OWN))
        x = _searched(points.join(mine, own, "left"), own, replace(params, smooth=True), False, False)
    else:
        x = _searched(points, own, params, optimize, deep, **how)
    log = lambda c: F.coalesce(F.log10(c), F.lit(0.0))
    return x.select(
        *(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), "seq", "time", "pressure", "pressure_derivative", log("time").alias("log_time"), log("pressure").alias("log_pressure"), log("pressure_derivative").alias("log_pressure_derivative"),
        "regime", "window_length", "filter_value", *DISTANCES,
    )
