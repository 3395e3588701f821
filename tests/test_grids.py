"""Curves on log grids and the envelope against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.functions.grids import on_log_grid
from gaugewright.operators import loglog, regimes


def curves():
    rng = np.random.default_rng(8)
    out = {}
    for k, n in enumerate((1, 2, 3, 40, 400, 2000)):
        x = np.sort(10 ** rng.uniform(-3, 2, n))
        if n > 3:
            x[1] = x[0]  # equal at the start and inside
            x[n // 2 : n // 2 + 3] = x[n // 2]
        y = rng.normal(size=n) * 5
        at = np.lexsort((y, x))
        out[k] = (x[at], y[at])
    return out


@pytest.mark.parametrize("extend", [False, True])
def test_curves_on_a_grid_equal_numpy(spark, extend):
    rows = [(k, float(a), float(b)) for k, (x, y) in curves().items() for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(3)
    got = on_log_grid(df, ["k"], "x", ["y"], F.lit(-2.5), F.lit(2.5), 300, extend).toPandas().sort_values(["k", "g"])
    grid = np.logspace(-2.5, 2.5, 300)
    for k, (x, y) in curves().items():
        part = got[got["k"] == k]
        if extend and len(x) < 2:
            assert not len(part)
            continue
        np.testing.assert_allclose(part["grid"], grid, rtol=1e-12)
        want = np.interp(grid, x, y)
        if extend:
            with np.errstate(divide="ignore", invalid="ignore"):
                for end, (i, j) in ((grid < x[0], (0, 1)), (grid > x[-1], (-2, -1))):
                    want[end] = y[i] + (grid[end] - x[i]) * (y[j] - y[i]) / (x[j] - x[i])
            want[~np.isfinite(want)] = np.nan
        np.testing.assert_allclose(part["y"].astype(float), want, rtol=1e-7, atol=1e-9)


def plain_envelope(members, points, half_window, k):
    """Pooled windows by a loop."""
    lo, hi = max(min(t.min() for t, _ in members), 1e-12), max(t.max() for t, _ in members)
    grid = np.logspace(np.log10(lo), np.log10(hi), points)
    values = np.vstack([np.interp(grid, t, d) for t, d in members])
    step = np.log10(grid[1] / grid[0])
    half = max(1, round(half_window / step)) if step else 1
    out, last = [], (np.nan, 0.0)
    for j in range(points):
        v = values[:, max(0, j - half) : j + half + 1].ravel()
        v = np.log10(v[v > 0])
        last = (v.mean(), v.std()) if len(v) else last
        out.append((grid[j], 10 ** last[0], 10 ** (last[0] - k * last[1]), 10 ** (last[0] + k * last[1])))
    return np.array(out)


def test_envelope_equals_numpy(spark):
    """Groups of one and several members, values at and below 0, leading windows without a value, one time only, constant curves."""
    rng = np.random.default_rng(9)
    groups = {0: [(np.sort(10 ** rng.uniform(-2, 2, n)), rng.normal(1, 2, n)) for n in (1, 5, 60, 300)]}
    groups[1] = [(np.array([0.1, 1.0, 10.0]), np.array([-1.0, -1.0, 3.0]))]
    groups[2] = [(np.array([2.0]), np.array([7.0])), (np.array([2.0]), np.array([0.7]))]
    groups[3] = [(np.array([0.01, 30.0]), np.array([4.0, 4.0]))]
    rows = [(g, m, float(a), float(b)) for g, ms in groups.items() for m, (t, d) in enumerate(ms) for a, b in zip(t, d, strict=True)]
    rows += [(0, 1, None, 1.0), (0, 1, 5.0, None)]
    df = spark.createDataFrame(rows, "well_id int, transient_id int, delta_time double, derivative double").repartition(3)
    got = loglog.envelope(df, ["well_id"], points=120).toPandas().sort_values(["well_id", "g"])
    assert len(got) == 4 * 120
    for g, members in groups.items():
        part = got[got["well_id"] == g][["grid", "mean", "lower", "upper"]].astype(float).to_numpy()
        np.testing.assert_allclose(part, plain_envelope(members, 120, 0.2, 2.0), rtol=1e-9)
    assert loglog.envelope(df.filter("false"), ["well_id"]).count() == 0


def test_jump_at_the_start_of_a_grid_follows_the_c_library(spark):
    """10 ** log10(a) is a bit below a there, so the first of the equal samples counts; by the JVM's powers it is a."""
    a, z = 24.139921618611112, 25.933507476666666
    assert math.pow(10.0, math.log10(a)) < a
    frame = spark.createDataFrame([(1, 1, a, 1.0), (1, 1, a, 100.0), (1, 1, z, 50.0), (2, 1, 3.0, 7.0), (2, 1, 3.0, 9.0)], "well_id int, transient_id int, x double, y double")
    got = loglog.interpolate_on_grid(frame, ["well_id"], "transient_id", "x", "y", 500)
    assert [round(r["value"], 6) for r in got.filter("well_id = 1 and g in (0, 499)").orderBy("g").collect()] == [1.0, 50.0]
    assert got.filter("well_id = 2").agg(F.count_distinct("grid")).collect()[0][0] == 1
    assert loglog.envelope(frame, ["well_id"], time_col="x", value_col="y").count() == 1000


def test_detection_shuffles_its_points_once(spark):
    """The points of a transient are neither written nor joined back after the boundary is marked."""
    frame = spark.createDataFrame([(1, 1, float(k), 5.0 + k, 3.0 + k % 2) for k in range(1, 9)], "group_id int, transient_id int, time double, pressure double, derivative double")
    found = regimes.classify(frame, ["group_id", "transient_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "boundaries" not in plan and plan.count("MapInArrow") == 1
    assert found.count() == regimes.POINTS
