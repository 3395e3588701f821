import datetime as dt
import math
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewright.functions import bayes
from gaugewright.functions import kernels as K
from gaugewright.functions.intervals import interval_join
from gaugewright.operators import ingest, lmir, loglog, patterns, rare, regimes, scores, tpmr, workflow
from gaugewright.plans import catalogue
from gaugewright.plans import gauges as G
from gaugewright.sources import files, plots
from gaugewright.streaming import rates as live

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def history(wells=2, hours=600, noise=0.0):
    """Steps of injection with two shut-ins of 80 h each: pressure rises with the rate and falls off in log time."""
    rng = np.random.default_rng(1)
    rows = []
    for w in range(wells):
        for h in range(hours):
            shut = 150 <= h < 230 or 400 <= h < 480
            q = 0.0 if shut else (100.0 if h < 300 else 150.0) + w
            since = h - (150 if h < 300 else 400)
            p = 300 - 20 * math.log10(since + 1.5) if shut else 300 + 0.02 * (h % 150) + (10 if h >= 300 else 0)
            rows.append((w, T0 + dt.timedelta(hours=h), float(p + noise * rng.normal()), q))
    return rows


@pytest.fixture(scope="module")
def wells(spark):
    df = spark.createDataFrame(history(), "well_id int, ts timestamp_ntz, pressure double, rate double").cache()
    return ingest.bhp_table(df), ingest.rate_table(df)


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr(r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = oracle.execute(catalogue.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_tpmr_finds_the_shut_ins(wells):
    t = tpmr.tpmr(wells[0], prominence=5.0, interval=5)
    found = t.transients_interval.filter("well_id = 0").orderBy("start_hr").collect()
    assert all(r.status == "shutin" and r.start_hr < r.end_hr and abs(r.duration_hr - (r.end_hr - r.start_hr)) < 1e-9 and r.duration_hr > 5 for r in found)
    assert [round(r.end_hr) for r in found] == [229, 479]
    assert tpmr.tpmr(wells[0].filter("false"), interval=5).transients.count() == 0


def test_workflow_invariants(wells):
    w = workflow.ti_workflow(*wells, prominence=5.0, interval_shutin=5, interval_injection=20, order=10)
    points = w.breakpoints.orderBy("well_id", "time_hr").toPandas()
    rates = w.weighted_rates.orderBy("well_id", "seq").toPandas()
    for well, p in points.groupby("well_id"):
        r = rates[rates["well_id"] == well]
        assert len(r) == len(p) - 1 and p["time_hr"].is_monotonic_increasing and p["ts"].is_unique
    starts = set(zip(rates["well_id"], rates["start_ts"], strict=True))
    both = w.shutin.unionByName(w.flowing).toPandas()
    assert set(zip(both["well_id"], both["start_ts"], strict=True)) <= starts
    assert set(w.shutin.toPandas()["status"]) == {"shutin"} and w.shutin.count() >= 4


def test_without_long_shut_ins_it_is_a_step_rate_test(wells):
    w = workflow.ti_workflow(*wells, prominence=5.0, interval_shutin=500, interval_injection=20, order=10)
    assert w.shutin.count() == 0 and {r.label for r in w.breakpoints.select("label").distinct().collect()} == {"multibp"}


def transients(spark, status):
    return spark.createDataFrame([(1, 0.0, 10.0, 10.0, T0, T0 + dt.timedelta(hours=10), status)], "well_id int, start_hr double, end_hr double, duration_hr double, start_ts timestamp_ntz, end_ts timestamp_ntz, status string")


def test_validation_moves_transients(spark):
    rate = lambda q: spark.createDataFrame([(1, T0, q)], "well_id int, start_ts timestamp_ntz, rate double")
    none = transients(spark, "flowing").filter("false")
    shut, flow = workflow.validate_shutin_rate(transients(spark, "shutin"), rate(250.0), none)
    assert shut.count() == 0 and [r.status for r in flow.collect()] == ["flowing"]
    shut, flow = workflow.validate_flowing_rate(none, rate(0.0), transients(spark, "flowing"))
    assert flow.count() == 0 and [r.status for r in shut.collect()] == ["shutin"]
    with pytest.raises(ValueError):
        workflow.validate_shutin_rate(None, rate(1.0), none)
    with pytest.raises(KeyError):
        workflow.validate_shutin_rate(none.drop("start_ts"), rate(1.0), none)


def test_weighted_rate_on_boundaries(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    rate = spark.createDataFrame([(1, i, at(h), float(i), h) for i, h in enumerate((0.5, 1.0, 2.9, 3.0, 5.0, 9.0), 1)], "well_id int, seq int, ts timestamp_ntz, rate double, time_hr double")
    points = spark.createDataFrame([(1, at(h), float(h)) for h in (0, 3, 7, 10)], "well_id int, ts timestamp_ntz, time_hr double")
    got = [round(r.rate, 6) for r in workflow.weighted_rates(rate, points).orderBy("seq").collect()]
    assert got == [2.1, 4.75, 6.0]
    assert [r.rate for r in workflow.weighted_rates(rate, points, shutin_threshold=5.0).orderBy("seq").collect()] == [0.0, 0.0, 6.0]


def test_loglog_of_all_transients(wells):
    bhp, rate = wells
    w = workflow.ti_workflow(bhp, rate, prominence=5.0, interval_shutin=5, interval_injection=20, order=10)
    shut = loglog.with_ids(w.shutin)
    d = loglog.loglog(bhp, shut, w.breakpoints, w.weighted_rates)
    ends = loglog.last_steps(loglog.rate_steps(w.breakpoints, w.weighted_rates), shut)
    n = loglog.normalize(d, ends, ends.filter("transient_id = 1"))
    assert d.count() > 50 and n.count() == d.count()
    e = loglog.envelope(d, ["well_id"], points=50).toPandas()
    ok = e.dropna()
    assert len(e) == 100 and (ok["lower"] <= ok["mean"] * (1 + 1e-9)).all() and (ok["mean"] <= ok["upper"] * (1 + 1e-9)).all()


def test_rare_is_zero_for_a_perfect_rebuild(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    rate = spark.createDataFrame([(1, i, at(i), 10.0) for i in range(48)], "well_id int, seq int, ts timestamp_ntz, rate double")
    rebuilt = spark.createDataFrame([(1, at(0), 10.0)], "well_id int, start_ts timestamp_ntz, rate double")
    assert rare.rare(rare.rare_inputs(rate, rebuilt)).first().rare == 0
    off = rare.rare(rare.rare_inputs(rate, rebuilt.withColumn("rate", F.lit(15.0)))).first().rare
    assert off == pytest.approx(0.5)
    assert rare.rare(rare.rare_inputs(rate.withColumn("rate", F.lit(0.0)), rebuilt)).first().rare is None


def test_scores_are_from_0_to_1(wells):
    bhp, rate = wells
    t = loglog.with_ids(tpmr.tpmr(bhp, prominence=5.0, interval=5).transients_interval)
    s = scores.scores(t, rate, bhp, merge=False).toPandas()
    assert len(s) == t.count()
    for c in ("pressure_score", "rate_score", "significance_score"):
        assert s[c].dropna().between(0, 1).all()


def test_valleys_do_not_depend_on_slices(spark):
    """Flats over slice boundaries, walls in other slices, gaps in seq, missing and NaN pressures, wells of one and two samples."""
    rng = np.random.default_rng(5)
    rows = [(w, int(k), float(v)) for w in range(4) for k, v in zip(np.sort(rng.choice(400, 150, replace=False)), np.repeat(rng.integers(0, 40, 50), 3) + (w % 2) * rng.random(150), strict=True)]
    rows += [(7, 1, 3.0), (8, 1, 3.0), (8, 2, 1.0), (0, 401, None), (1, 402, float("nan"))]
    bhp = spark.createDataFrame(rows, "well_id int, seq int, pressure double").selectExpr("well_id", "seq", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, seq) AS ts", "pressure", "cast(seq as double) AS time_hr")
    key = lambda df: sorted(map(str, df.collect()))
    want = []
    for w in range(4):
        own = [r for r in rows if r[0] == w and r[2] is not None and r[2] == r[2]]
        want += [(w, own[i][1]) for i in K.prominent_valleys(np.array([r[2] for r in own]), 12.0)]
    got = tpmr.detect_valleys(bhp, 12.0)
    assert len(want) > 20 and sorted((r.well_id, r.seq) for r in got.collect()) == want
    for size in (10, 64):
        assert key(tpmr.detect_valleys(bhp, 12.0, slice_samples=size)) == key(got)
    assert tpmr.detect_valleys(bhp, slice_samples=10).schema == got.schema
    assert tpmr.detect_valleys(bhp.filter("false")).count() == 0


def test_lmir_edges(spark, wells):
    found = lmir.lmir(wells[0].filter("well_id = 0"), 10, 5, 5)
    times = [r.time_hr for r in found.flow_breakpoints.orderBy("time_hr").collect()]
    assert times[0] == 0 and times == sorted(set(times)) and found.flowing.count() == len(times) - 1
    assert found.flow_breakpoints.filter("status = 'shutin'").count() == 1


def test_regimes_and_patterns(spark):
    t = np.logspace(-2, 3, 150)
    rows = [(1, m, float(x), float(x**0.1), float(3.0 * (1 + 0.01 * m) * (1 if x < 30 else (x / 30) ** 0.364))) for m in range(3) for x in t]
    frame = spark.createDataFrame(rows, "group_id int, transient_id int, time double, pressure double, derivative double")
    r = patterns.detect_features(frame).cache()
    assert r.count() == 1500 and {0, 1} <= {x.regime for x in r.select("regime").distinct().collect()}
    p = patterns.get_stable_pattern(r)
    got = {x.regime: x for x in p.collect()}
    assert "Radial" in got and all(x.start < x.end and 0 <= x.confidence <= 1 + 1e-9 for x in got.values())
    assert patterns.distance_confidence(r, p).count() >= 3
    assert {x.row for x in patterns.pivot_intervals(p).collect()} == {"start", "end", "confidence"}
    c = patterns.correlation_analysis(frame).toPandas()
    assert c["threshold"].is_monotonic_increasing
    assert regimes.classify(frame.filter("false"), ["group_id"]).count() == 0
    assert plots.regime_points(r).filter("regime_name is null").count() == 0


def plain_correlations(group):
    """Windows and nested intervals of one group by a table of all pairs' correlations, window by window."""
    lo, hi = max(min(m) for m in group.values()), min(max(m) for m in group.values())
    if len(group) < 2 or not 0 < lo < hi:
        return {}, []
    grid = np.linspace(np.log10(lo), np.log10(hi), 500)
    curves = pd.DataFrame({k: np.interp(grid, np.log10(sorted(m)), [math.log10(m[t]) if m[t] > 0 else 0.0 for t in sorted(m)]) for k, m in group.items()})
    win = regimes.LogTimeWindow(grid, 0.5, 0.02)
    frames = [win.frame(n) for n in range(win.count())]
    corr = np.array([curves.iloc[i:j].corr().abs().min().min() if i >= 0 else np.nan for i, j in frames])
    a, b, found = 0, len(frames) - 1, []
    for threshold in (0.5, 0.62, 0.75, 0.88, 0.99):
        runs = [r for r in patterns._islands(np.nan_to_num(corr[a : b + 1]) > threshold)]
        if not runs:
            break
        s, e = max(runs, key=lambda r: corr[a + r[0] : a + r[1] + 1].mean())
        a, b = a + s, a + e
        found.append((threshold, 10 ** grid[frames[a][0]], 10 ** grid[frames[b][1] - 1], frames[a][0], frames[b][1] - 1))
    slope = np.mean([np.polyfit(grid[found[0][3] : found[0][4]], curves[k][found[0][3] : found[0][4]], 1)[0] for k in curves]) if found else 0
    name = "Radial" if abs(slope) <= 0.1 else "Linear-up" if 0.1 < slope < 0.8 else "Linear-down" if -0.8 < slope < -0.1 else "Not defined"
    return {n: c for n, c in enumerate(corr) if c == c}, [(t, s, e, name) for t, s, e, *_ in found]


def test_correlations_equal_a_plain_search(spark):
    """Groups of 2, 5 and 9 members, one constant in part, one with zeros, one alone, one without a common stretch, one without rows that count."""
    rng = np.random.default_rng(3)
    groups = {}
    for g, n in ((1, 2), (2, 5), (3, 9), (4, 1), (5, 2)):
        groups[g] = {}
        for m in range(n):
            t = np.sort(10 ** rng.uniform(-1, 2.2, 60)) * (1000 ** m if g == 5 else 1)
            d = t ** (0.0 if g == 1 else 0.3) * np.exp(np.where(t < 5, 1.0, 0.05) * rng.normal(size=60) * 0.2 + np.sin(np.log(t) * 3))
            groups[g][m] = dict(zip(t.tolist(), d.tolist(), strict=True))
    groups[3][0] = {t: 2.0 if 1 < t < 30 else v for t, v in groups[3][0].items()}
    groups[2][1] = {t: 0.0 if k == 7 else v for k, (t, v) in enumerate(groups[2][1].items())}
    rows = [(g, m, t, d) for g, ms in groups.items() for m, c in ms.items() for t, d in c.items()]
    frame = spark.createDataFrame([*rows, (6, 0, None, 1.0), (6, 1, 2.0, None), (None, 0, 1.0, 1.0)], "group_id int, transient_id int, time double, derivative double")
    want = {g: plain_correlations(ms) for g, ms in groups.items()}
    curves = patterns.shared_curves(frame).cache()
    for block in (64, 2):
        got = {(r.group_id, r.window): r.corr for r in patterns.window_correlations(curves, block=block).filter("corr is not null").collect()}
        assert got == pytest.approx({(g, n): c for g, (w, _) in want.items() for n, c in w.items()}, abs=1e-9) and len(got) > 200
    found = patterns.correlation_analysis(frame).orderBy("group_id", "threshold").collect()
    flat = [(g, *f) for g, (_, fs) in sorted(want.items()) for f in fs]
    assert len(flat) > 4 and [(r.group_id, r.threshold, r.regime) for r in found] == [(g, t, name) for g, t, _, _, name in flat]
    assert np.allclose([(r.start, r.end) for r in found], [(s, e) for _, _, s, e, _ in flat], rtol=1e-9)
    assert patterns.correlation_analysis(frame.filter("false")).count() == 0


def test_files_round_trip(spark, tmp_path, wells):
    path = files.write_with_header(wells[0].limit(5), str(tmp_path / "p"), well="W", long_label="x")
    assert path.endswith(".csv") and files.read_header(spark, path) == {"well": "W", "label": "time_hr", "long label": "x"}
    assert files.read_vector(spark, path).count() == 5
    files.write_parquet(wells[0], str(tmp_path / "b.parquet"), "well_id")
    part = files.read_vector(spark, str(tmp_path / "b.parquet"), start="2024-01-02", end="2024-01-03")
    assert part.count() == 50
    with pytest.raises(ValueError):
        files.read_vector(spark, "x.pkl")
    assert "Timestamp" in files.export(wells[0]).columns


def test_live_windows_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(history(1, 60), "well_id int, ts timestamp_ntz, pressure double, rate double").selectExpr("well_id", "cast(ts as timestamp) ts", "rate").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("well_id int, ts timestamp, rate double").parquet(src)
    q = live.write_windows(live.windowed_rates(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got) >= 8 and (got["n"] == 6).all() and pd.api.types.is_float_dtype(got["mean"])


@pytest.fixture(scope="module")
def long_history(spark, tmp_path_factory):
    """A folder with the events of one well: a sample an hour over 26 days."""
    folder = str(tmp_path_factory.mktemp("long"))
    rows = [(k, 1, ["view", "click"][k % 2], 50 + 10 * math.sin(k / 9) + 3 * math.sin(k / 2.3) + k % 5, k) for k in range(26 * 24)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, h int")
    e.withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, h)").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    return folder


def test_time_lapse_queries_see_all_flowing_transients(spark, long_history):
    every = {r.transient_id for r in G.grid_transients(G.bhp(spark, long_history)).filter("status = 'flowing'").collect()}
    assert len(every) > 7
    family = catalogue._family(spark, long_history).cache()
    assert {r.transient_id for r in family.select("transient_id").distinct().collect()} == every
    assert {r.transient_id for r in catalogue.regimes_fixed(spark, long_history).select("transient_id").distinct().collect()} == every
    key = lambda df: sorted(map(str, df.collect()))
    assert key(catalogue.stable_pattern(spark, long_history)) == key(patterns.get_stable_pattern(regimes.classify(family, ["group_id", "transient_id"])))
    rounded = patterns.correlation_analysis(family).select("group_id", "threshold", *[F.round(c, 6).alias(c) for c in ("start", "end")], "regime")
    assert key(catalogue.correlation_intervals(spark, long_history)) == key(rounded)
    assert {r.transient_id for r in catalogue.regimes_optimized(spark, long_history).select("transient_id").distinct().collect()} == every
    model = catalogue.regimes_model(spark, long_history).collect()
    assert {r.transient_id for r in model} == every and len(model) == len(every) and all(1 <= r.n_regimes <= 5 and 0 <= r.n_radial <= 500 and 0 < r.window_length <= 1 for r in model)


def test_envelope_query_has_the_default_grid(spark, long_history):
    got = catalogue.uncertainty_envelope(spark, long_history)
    assert got.groupBy("well_id").count().collect()[0]["count"] == 500


def test_normalization_by_hand(spark):
    """Reference rates end 50, 200: its last rate is 200 and changed by 150."""
    cases = {1: ([100.0, 40.0], 60, 40), 2: ([100.0, 100.0], 100, 100), 3: ([80.0, 0.0], 80, 80), 4: ([30.0, 0.0, 0.0], 30, 30), 5: ([25.0], 25, 25), 6: ([0.0], None, None), 7: ([10.0, -10.0, -10.0], 10, 10)}
    cases[8] = ([50.0, 200.0], 150, 200)  # the reference
    frame = spark.createDataFrame([(k, 1, 6.0, 3.0) for k in cases], "well_id int, transient_id int, delta_pressure double, derivative double")
    points = spark.createDataFrame([(k, float(i)) for k, v in cases.items() for i in range(len(v[0]) + 1)], "well_id int, time_hr double")
    rates = spark.createDataFrame([(k, i + 1, q) for k, v in cases.items() for i, q in enumerate(v[0])], "well_id int, seq int, rate double")
    ends = loglog.last_steps(loglog.rate_steps(points, rates), spark.createDataFrame([(k, 1, 100.0) for k in cases], "well_id int, transient_id int, start_hr double"))
    ref = ends.filter("well_id = 8").drop("well_id").crossJoin(frame.select("well_id"))
    got = {r.well_id: r for r in loglog.normalize(frame, ends, ref).collect()}
    assert len(got) == len(cases)
    for k, (_, change, last) in cases.items():
        want = [None if by is None else v * of / by for v, of, by in ((6.0, 200, change), (6.0, 150, change), (3.0, 200, last), (3.0, 150, last))]
        assert [got[k].pn_saphir, got[k].pn_autowell, got[k].derivative_saphir, got[k].derivative_autowell] == pytest.approx(want), k


def test_interval_join_equals_all_pairs(spark):
    """Long, short, empty, overlapping, reversed and null intervals, negative times, points on edges and buckets."""
    rng = np.random.default_rng(4)
    spans = [(w, i, float(a), float(a + b)) for w in (1, 2) for i, (a, b) in enumerate(zip(rng.integers(-50, 900, 60), rng.choice([0, 1, 3, 400], 60), strict=True))]
    spans += [(1, 90, 10.0, 5.0), (1, 91, None, 5.0), (3, 92, 0.0, 1e6), (2, 93, -1e5, -1e5)]
    points = [(w, float(t)) for w in (1, 2, 3) for t in [*rng.integers(-60, 1000, 300), -1e5, 1e6]]
    p, s = spark.createDataFrame(points, "w int, t double"), spark.createDataFrame(spans, "w int, id int, a double, b double")
    for closed in (True, False):
        inside = F.col("t").between(F.col("a"), F.col("b")) if closed else (F.col("t") >= F.col("a")) & (F.col("t") < F.col("b"))
        got = sorted(tuple(r) for r in interval_join(p, s, ["w"], F.col("t"), F.col("a"), F.col("b"), inside).select("w", "t", "id").collect())
        want = sorted((w, t, i) for w, t in points for x, i, a, b in spans if w == x and a is not None and a <= t and (t <= b if closed else t < b))
        assert got == want and got
    assert interval_join(p, s.filter("false"), ["w"], F.col("t"), F.col("a"), F.col("b"), F.col("t").between(F.col("a"), F.col("b"))).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_features_of_either_kind_of_timestamp(wells, kind):
    bhp, rate = (x.withColumn("ts", F.col("ts").cast(kind)) for x in wells)
    t = loglog.with_ids(tpmr.tpmr(wells[0], prominence=5.0, interval=5).transients_interval)
    t = t.withColumn("start_ts", F.col("start_ts").cast(kind)).withColumn("end_ts", F.col("end_ts").cast(kind))
    f = scores.features(t, rate, bhp, merge=False).toPandas()
    assert len(f) == t.count() > 0 and f["monotonicity_ratio"].notna().all() and f["rate_std"].notna().any()


def test_no_join_on_the_well_alone(spark, wells):
    """Samples meet transients by well and time bucket."""
    bhp, rate = wells
    t = loglog.with_ids(tpmr.tpmr(bhp, prominence=5.0, interval=5).transients_interval)
    for df in (loglog.transient_samples(bhp, t), scores.rate_features(t, rate), scores.rate_change(t, rate), scores.pressure_features(t, bhp)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line and ("ts#" in line or "time_hr#" in line)]
        assert joins and all("_bucket" in line for line in joins), joins


def test_signed_rank_tests_equal_plain(spark):
    """Ties, zeros, equal sides, uneven sides, few and many samples."""
    rng = np.random.default_rng(6)
    at = lambda h: T0 + dt.timedelta(hours=float(h))
    rates, transients = [], []
    for w in range(40):
        n, step = int(rng.choice([4, 12, 30, 150])), float(rng.choice([0.5, 1.0]))
        shift = rng.choice([0, 0.5, 3])
        rows = rng.normal(0, 1, 2 * n) + shift * (np.arange(2 * n) >= n)
        rows = rows if w % 3 else np.round(rows)
        rates += [(w, i + 1, at(step * i), float(v)) for i, v in enumerate(rows)]
        transients += [(w, 1, at(step * n), at(step * n * 2), step * n), (w, 2, at(step * n / 2), at(step * n), step * n / 2), (w, 3, at(1e4), at(2e4), 1e4 - 5e3)]
    rate = spark.createDataFrame(rates, "well_id int, seq int, ts timestamp_ntz, rate double").repartition(3)
    t = spark.createDataFrame(transients, "well_id int, transient_id int, start_ts timestamp_ntz, end_ts timestamp_ntz, duration_hr double")
    got = {(r.well_id, r.transient_id): r for r in scores.rate_tests(t, rate).collect()}
    assert len(got) == len(transients)
    ones = 0
    for w, i, start, _, width in transients:
        own = [((ts - start) / dt.timedelta(hours=1), v) for x, _, ts, v in rates if x == w]
        for name, share in scores.SCALES.items():
            reach = width * share
            before, after = np.array([v for h, v in own if -reach <= h < 0]), np.array([v for h, v in own if 0 <= h < reach])
            n = min(len(before), len(after))
            p = K.wilcoxon_p(before[-n:], after[:n]) if len(before) > 2 and len(after) > 2 else float("nan")
            assert got[w, i][f"binary_rate_change_{name}"] == scores.transform_p_value(p), (w, i, name, p)
            ones += scores.transform_p_value(p)
    assert 10 < ones < 2 * len(transients)


def test_critical_sums_are_the_exact_tails():
    sums = scores.critical_sums()
    assert len(sums) == scores.EXACT + 1 and sums[:6] == [-1] * 6
    for n in (6, 9, 20, 50):
        d = np.arange(1.0, n + 1)
        for low, under in ((sums[n], True), (sums[n] + 1, False)):
            sign, rest = np.ones(n), low
            for r in range(n, 0, -1):  # negative ranks that add up to `low`
                if r <= rest:
                    sign[r - 1], rest = -1, rest - r
            assert rest == 0 and (K.wilcoxon_p(d * sign, np.zeros(n)) < 0.05) == under


@pytest.mark.parametrize("p", [regimes.Params(), regimes.Params(window_length=0.3, window_step=0.05), regimes.Params(window_length=3.0, filter_value=-1.0), regimes.Params(filter_value=1.0, bdw=4)])
def test_distances_by_running_sums_equal_windows(spark, p):
    """Smooth, noisy, steep, exactly flat and short transients; the last has one point behind the filter."""
    rng, rows = np.random.default_rng(2), []
    for k in range(6):
        t = np.logspace(-2, [3, 2, 1.5, 2.5, -1, p.filter_value + 1e-9][k], 120)
        d = [3 * np.maximum(1, t / 10) ** 0.364, np.exp(rng.normal(size=120)), t**1.2, np.full(120, 2.0), t**0.5, t**-0.3][k]
        rows += [(k, float(a), float(a**0.1), float(b)) for a, b in zip(t, d, strict=True)]
    rows += [(7, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "k int, time double, pressure double, derivative double").repartition(3)
    got = regimes.classify(frame, ["k"], p).toPandas().sort_values(["k", "seq"]).groupby("k")
    want = regimes._searched(regimes.resampled(frame.withColumnRenamed("k", "well"), ["well"]), ["well"], p, False, False).toPandas().sort_values(["well", "seq"]).groupby("well")
    assert set(got.groups) == set(want.groups) == set(range(6))
    for k, g in got:
        x = want.get_group(k)
        assert len(g) == 500 and g["regime"].tolist() == x["regime"].tolist()
        for c in regimes.DISTANCES:
            np.testing.assert_allclose(g[c].astype(float), x[c].astype(float), atol=2e-8)


def test_superposition_in_blocks_equals_a_sum_over_all_steps(spark):
    """Steps at a transient's start, transients before all steps, last rates of 0, blocks of any size."""
    rng = np.random.default_rng(12)
    steps, transients, samples, want = [], [], [], {}
    for w in range(3):
        bps = np.sort(rng.choice(np.arange(1, 200), 23, replace=False)).astype(float)
        q = np.round(rng.choice([0, 0, 50, 80, -30], 22) + rng.integers(0, 3, 22) * (w > 0), 1)
        steps.append((bps, q))
        for i, (a, z) in enumerate(((-5.0, 3.0), (bps[4], bps[4] + 9), (bps[9] + 0.5, 150.0), (201.0, 260.0))):
            transients.append((w, i, float(a), float(z)))
        seq = 0
        for t in np.arange(-5.0, 260, 2.5):
            seq += 1
            samples.append((w, seq, float(rng.normal(100, 5)), float(t)))
    for w, i, a, z in transients:
        own = [(s, p, t) for x, s, p, t in samples if x == w and a <= t <= z]
        bps, q = steps[w]
        use = np.flatnonzero(bps[:-1] <= a)
        if not len(use):
            continue
        rate = q[use]
        for injection in (False, True):
            last = rate[-1] if injection else next((v for v in rate[::-1] if v), 0)
            for s, p, t in own[1:]:
                v = None if last == 0 else float((1 if injection else -1) * (np.diff(rate, prepend=0) / last * np.log10(t - bps[use])).sum())
                want[injection, w, i, s] = (v, abs(p - own[0][1]), t - own[0][2])
    points = spark.createDataFrame([(w, float(t)) for w, (b, _) in enumerate(steps) for t in b], "well_id int, time_hr double")
    rates = spark.createDataFrame([(w, i + 1, float(v)) for w, (_, q) in enumerate(steps) for i, v in enumerate(q)], "well_id int, seq int, rate double")
    t = spark.createDataFrame(transients, "well_id int, transient_id int, start_hr double, end_hr double")
    bhp = spark.createDataFrame(samples, "well_id int, seq int, pressure double, time_hr double").repartition(3)
    s = loglog.rate_steps(points, rates)
    for injection in (False, True):
        for block in (1, 5, 1024):
            rows = loglog.superposition(loglog.transient_samples(bhp, t), s, loglog.last_steps(s, t), injection, block).collect()
            expected = {k[1:]: v for k, v in want.items() if k[0] == injection}
            assert len(rows) == len(expected) > 100
            for r in rows:
                assert (r.superposition, r.delta_pressure, r.delta_time) == pytest.approx(expected[r.well_id, r.transient_id, r.seq])


def test_superposition_adds_from_the_last_step_back(spark):
    """In the order of the SQL's join: a derivative over a small rise shows the last bits of these sums."""
    rng, want, points, rates, samples = np.random.default_rng(4), {}, [], [], []
    for w in range(20):
        q = np.round(rng.uniform(1, 90, 3), 2).tolist()
        points += [(w, t) for t in (0.0, 900.0, 990.0, 1200.0)]
        rates += [(w, i + 1, v) for i, v in enumerate(q)]
        samples += [(w, 1, 5.0, 995.0), (w, 2, 6.0, 1000.0)]
        terms = [c / q[2] * k for c, k in zip((q[0], q[1] - q[0], q[2] - q[1]), (3.0, 2.0, 1.0), strict=True)]
        want[w] = ((terms[2] + terms[1]) + terms[0], (terms[0] + terms[1]) + terms[2])
    assert any(a != b for a, b in want.values())
    t = spark.createDataFrame([(w, 1, 990.0, 1200.0) for w in want], "well_id int, transient_id int, start_hr double, end_hr double")
    bhp = spark.createDataFrame(samples, "well_id int, seq int, pressure double, time_hr double")
    s = loglog.rate_steps(spark.createDataFrame(points, "well_id int, time_hr double"), spark.createDataFrame(rates, "well_id int, seq int, rate double"))
    got = {r.well_id: r.superposition for r in loglog.superposition(loglog.transient_samples(bhp, t), s, loglog.last_steps(s, t), True).collect()}
    assert got == {w: a for w, (a, _) in want.items()}


def test_breakpoints_near_a_start_need_no_join(spark, wells):
    rng = np.random.default_rng(4)
    points = [(w, float(x) if x < 39 else None, f"p{i}") for i, (w, x) in enumerate(zip(rng.integers(0, 5, 400).tolist(), rng.integers(0, 40, 400).tolist(), strict=True))]
    starts = [(int(w), float(x)) for w, x in zip(rng.integers(0, 4, 30), rng.integers(0, 40, 30), strict=True)] + [(0, None)]
    points, starts = [*points, (None, 9.0, "lost")], [*starts, (None, 10.0)]
    p, t = spark.createDataFrame(points, "well_id int, time_hr double, label string"), spark.createDataFrame(starts, "well_id int, start_hr double")
    near = {n for w, x, n in points if w is not None and x is not None and any(v == w and s is not None and s > 2 and s - 2 <= x < s for v, s in starts)}
    stay, gone = workflow.filter_breakpoints(p, t, 2)
    assert sorted(r.label for r in gone.collect()) == sorted(near) and 50 < len(near) < 350
    assert sorted(r.label for r in stay.collect()) == sorted({n for *_, n in points} - near)
    # a join sorts both sides whole in one task, or sends one side to all; a second scan for the ends of the history does it again
    for plan in (stay, lmir.lmir(wells[0]).minima):
        assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_samples_take_their_interval_without_a_join(spark):
    """A sample at the start of its interval has no time before it; in large tables a join of samples with intervals gave some a time of other rows."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    points = spark.createDataFrame([(w, at(h), float(h)) for w in range(3) for h in (0, 10, 20)], "well_id int, ts timestamp_ntz, time_hr double")
    rate = ingest.rate_table(spark.createDataFrame([(w, at(h), q) for w in range(3) for h, q in ((0, 10.0), (4, 20.0), (10, 30.0), (25, 99.0))], "well_id int, ts timestamp_ntz, rate double"))
    got = workflow.weighted_rates(rate, points)
    assert sorted((r.well_id, r.seq, r.rate) for r in got.collect()) == [(w, s, q) for w in range(3) for s, q in ((1, (10.0 * 2 + 20.0 * 8) / 10), (2, 30.0))]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # means and thresholds only


def test_rows_of_a_union_meet_by_key(spark):
    """Without broadcasts the parts of a union lie differently, and a window behind it saw a part of a well's rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, catalogue.queries()["workflow_breakpoints"](spark, SF.replace("0.001", "0.01")).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF.replace('0.001', '0.01')}/events.parquet'")
    assert got == sorted(c.execute(catalogue.oracle_sql()["workflow_breakpoints"]).fetchall())


@pytest.mark.parametrize("name", ["normalized_loglog", "superposition_injection", "bourdet_derivative"])
def test_samples_at_the_start_of_a_rate_are_as_in_sql(spark, tmp_path, name):
    """Copies of events that share well and time put samples at the very start of a rate, where log10(0) is -inf: NaN and null are told apart here."""
    c = duckdb.connect()
    c.execute(f"copy (select event_id + k * 1000000 as event_id, ts, user_id, event_type, value, props from '{SF}/events.parquet', (select unnest(range(3)) as k)) to '{tmp_path}/events.parquet'")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = c.execute(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, str(tmp_path)).select(*(x[0] for x in want.description)).collect()
    assert any(isinstance(v, float) and not math.isfinite(v) for r in got for v in r)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_log_terms_are_added_in_order_with_logarithms_of_the_c_library():
    at, begin = [3.7, 5.0, 2.0], [[2.9, 1.3], [5.0, 1.0], [1.0, 0.5]]
    steps = pa.array([[(2, b[0], 4.0), (1, b[1], -1.0)] for b in begin], pa.list_(pa.struct([("bp", pa.int32()), ("time_hr", pa.float64()), ("change", pa.float64())])))
    got = K.log_terms(pa.array(at), pa.array([2, 2, 1], pa.int32()), pa.array([3.0, 3.0, None]), steps, 1.0).to_pylist()
    assert got == [4 / 3 * math.log10(3.7 - 2.9) + -1 / 3 * math.log10(3.7 - 1.3), -math.inf, None]


def test_transients_are_searched_in_many_tasks(spark):
    t = [10 ** (k / 10) for k in range(-10, 21)]
    frame = spark.createDataFrame([(g, 1, x, 3 + math.log10(x), 1.0 + 0.01 * g) for g in range(12) for x in t], "group_id int, transient_id int, time double, pressure double, derivative double")
    at = F.spark_partition_id().alias("at")
    points = regimes.resampled(frame, ["group_id", "transient_id"], "time", "pressure", "derivative")
    assert points.select(at).distinct().count() > 1
    assert regimes.classify(frame, ["group_id", "transient_id"]).select(at).distinct().count() > 1


def test_search_stays_in_its_own_thread():
    began, own = time.process_time(), time.thread_time()
    bayes.minimize(lambda x: float((x[0] - 0.3) ** 2 + x[1] ** 2), (0, 0), (1, 1), calls=60)
    own = time.thread_time() - own
    assert time.process_time() - began < 2 * own
