"""Every query of the gauge engine over the driver tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.staging import keep
from gaugewright.operators import ingest, lmir, loglog, patterns, rare, regimes, scores, tpmr, workflow
from gaugewright.operators.classifier import RegimeClassifier
from gaugewright.plans import gauges as G
from gaugewright.sources import plots

Query = Callable[[SparkSession, str], DataFrame]
ORDER, EDGE = 3, 5.0  # neighbours and hours for minima in histories of some dozens of samples
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL if there is any; CTEs come from the gauges module."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _with(sql: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([G.SQL, *parts]) + "\n" + sql


def _r(*names: str, n: int = 6) -> list[F.Column]:
    """Rounded columns, with -0 as 0."""
    return [(F.round(F.col(c), n) + F.lit(0.0)).alias(c) for c in names]


def _rs(*names: str, n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) + 0.0 AS {c.split('.')[-1]}" for c in names)


def _us(*names: str) -> list[F.Column]:
    """Hours as whole microseconds."""
    return [F.round(F.col(c) * 3.6e9).cast("long").alias(f"{c}_us") for c in names]


def _uss(*names: str) -> str:
    return ", ".join(f"CAST(round({c} * 3.6e9) AS BIGINT) AS {c.split('.')[-1]}_us" for c in names)


# --- ingest ---------------------------------------------------------------------------------------------------------


@query(_with(f"SELECT well_id, seq, {_rs('pressure', 'time_hr')} FROM bhp"))
def ingest_time_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bhp(spark, sf_dir).select("well_id", "seq", *_r("pressure", "time_hr"))


@query(_with(f"SELECT well_id, seq, {_rs('rate', 'time_hr')} FROM rate"))
def ingest_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rate(spark, sf_dir).select("well_id", "seq", *_r("rate", "time_hr"))


_COMMON = """
span AS (SELECT b.well_id, greatest(min(b.time_hr), min(r.lo)) AS lo, least(max(b.time_hr), min(r.hi)) AS hi
         FROM bhp b JOIN (SELECT well_id, min(time_hr) AS lo, max(time_hr) AS hi FROM rate GROUP BY well_id) r USING (well_id) GROUP BY b.well_id)"""


@query(_with("""SELECT kind, well_id, seq, round(time_hr - min(time_hr) OVER (PARTITION BY kind, well_id), 6) + 0.0 AS time_hr FROM (
    SELECT 'bhp' AS kind, well_id, seq, time_hr FROM bhp JOIN span USING (well_id) WHERE time_hr BETWEEN lo AND hi
    UNION ALL SELECT 'rate', well_id, seq, time_hr FROM rate JOIN span USING (well_id) WHERE time_hr BETWEEN lo AND hi)""", _COMMON))
def clip_common_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r = ingest.clip_common_range(G.bhp(spark, sf_dir), G.rate(spark, sf_dir))
    return b.select(F.lit("bhp").alias("kind"), "well_id", "seq", *_r("time_hr")).unionByName(r.select(F.lit("rate").alias("kind"), "well_id", "seq", *_r("time_hr")))


@query(_with("SELECT well_id, count(*) AS n, round(sum(pressure), 4) AS total FROM bhp WHERE time_hr BETWEEN 24 AND 240 GROUP BY well_id"))
def select_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.select_period(G.bhp(spark, sf_dir), 24, 240).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pressure"), 4).alias("total"))


@query("SELECT event_id, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) AS second FROM events")
def round_to_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.events(spark, sf_dir).select("event_id", (F.unix_micros(ingest.round_to_second(F.col("ts"))) / 1000000).cast("long").alias("second"))


# --- shut-ins -------------------------------------------------------------------------------------------------------

_PROMINENCE = "prom AS (SELECT well_id, round((quantile_cont(pressure, 0.9) - quantile_cont(pressure, 0.05)) / 2, 9) AS p FROM bhp GROUP BY well_id)"


@query(_with("SELECT well_id, round(p, 6) AS prominence FROM prom", _PROMINENCE))
def default_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpmr.default_prominence(G.bhp(spark, sf_dir)).select("well_id", *_r("prominence"))


_VALLEYS = f"""{_PROMINENCE},
runs AS (SELECT *, sum(new) OVER (PARTITION BY well_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN pressure IS DISTINCT FROM lag(pressure) OVER (PARTITION BY well_id ORDER BY seq) THEN 1 ELSE 0 END AS new FROM bhp)),
flats AS (SELECT *, lag(pressure) OVER w AS before, lead(pressure) OVER w AS after FROM (SELECT well_id, run, min(seq) AS s, max(seq) AS e, min(pressure) AS pressure FROM runs GROUP BY well_id, run) WINDOW w AS (PARTITION BY well_id ORDER BY run)),
low_flats AS (SELECT * FROM flats WHERE pressure < before AND pressure < after),
lower AS (SELECT v.well_id, v.run, max(CASE WHEN f.run < v.run THEN f.run END) AS l, min(CASE WHEN f.run > v.run THEN f.run END) AS r
          FROM low_flats v LEFT JOIN flats f ON f.well_id = v.well_id AND f.pressure < v.pressure GROUP BY v.well_id, v.run),
walls AS (SELECT v.well_id, v.run, v.s, v.e, v.pressure, max(CASE WHEN f.run < v.run THEN f.pressure END) AS lw, max(CASE WHEN f.run > v.run THEN f.pressure END) AS rw
          FROM low_flats v JOIN lower x ON x.well_id = v.well_id AND x.run = v.run JOIN flats f ON f.well_id = v.well_id AND f.run > coalesce(x.l, -1) AND f.run < coalesce(x.r, 1e18) GROUP BY v.well_id, v.run, v.s, v.e, v.pressure),
valleys AS (SELECT b.*, row_number() OVER (PARTITION BY b.well_id ORDER BY b.ts, b.seq) - 1 AS segment FROM walls w JOIN prom USING (well_id) JOIN bhp b ON b.well_id = w.well_id AND b.seq = (w.s + w.e) // 2 WHERE least(lw, rw) - w.pressure >= p)"""


@query(_with(f"SELECT well_id, seq, {_rs('pressure', 'time_hr')} FROM valleys", _VALLEYS))
def tpmr_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpmr.detect_valleys(G.bhp(spark, sf_dir)).select("well_id", "seq", *_r("pressure", "time_hr"))


_SHUTINS = f"""{_VALLEYS},
segs AS (SELECT b.well_id, b.seq, b.ts, b.pressure, b.time_hr, count(v.seq) AS segment FROM bhp b LEFT JOIN valleys v ON v.well_id = b.well_id AND v.ts <= b.ts GROUP BY ALL),
tops AS (SELECT s.* FROM (SELECT *, max(pressure) OVER (PARTITION BY well_id, segment) AS hi FROM segs) s WHERE segment < (SELECT count(*) FROM valleys v WHERE v.well_id = s.well_id)),
top_at AS (SELECT well_id, segment, max(seq) AS top_seq FROM tops WHERE pressure = hi GROUP BY well_id, segment),
parts AS (SELECT t.*, top_seq, last(pressure) OVER w AS pz, max(time_hr) OVER w AS tz, min(time_hr) OVER w AS t0, min(pressure) OVER w AS lo, max(t.seq) OVER w AS seq_z
          FROM tops t JOIN top_at a USING (well_id, segment) WHERE t.seq >= top_seq WINDOW w AS (PARTITION BY well_id, segment ORDER BY t.seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
bends AS (SELECT *, -((pressure - lo) / nullif(hi - lo, 0) - (pz - lo) / nullif(hi - lo, 0)) - (1 - (pz - lo) / nullif(hi - lo, 0)) * ((time_hr - t0) / nullif(tz - t0, 0) - 1) AS bend FROM parts),
elbows AS (SELECT *, row_number() OVER (PARTITION BY well_id, segment ORDER BY round(bend, 9), seq DESC) AS k FROM bends),
shoulders AS (SELECT e.well_id, e.segment, CASE WHEN e.bend IS NOT NULL AND e.seq <> e.seq_z AND e.pressure > (e.hi + e.pz) / 2 THEN e.seq ELSE e.top_seq END AS seq FROM elbows e WHERE k = 1),
shutins AS (SELECT s.well_id, s.segment, b.time_hr AS start_hr, b.ts AS start_ts, v.time_hr AS end_hr, v.ts AS end_ts, v.time_hr - b.time_hr AS duration_hr
            FROM shoulders s JOIN bhp b ON b.well_id = s.well_id AND b.seq = s.seq JOIN valleys v ON v.well_id = s.well_id AND v.segment = s.segment)"""


@query(_with(f"SELECT well_id, {_rs('start_hr', 'end_hr', 'duration_hr')}, 'shutin' AS status FROM shutins WHERE duration_hr > 5", _SHUTINS))
def tpmr_shutins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpmr.tpmr(G.bhp(spark, sf_dir), interval=5).transients_interval.select("well_id", *_r("start_hr", "end_hr", "duration_hr"), "status")


@query(_with("""SELECT well_id, round(time_hr, 6) + 0.0 AS time_hr, label FROM (SELECT *, row_number() OVER (PARTITION BY well_id, ts ORDER BY rank, seq) AS n FROM (
    SELECT well_id, seq, ts, time_hr, 'flowing' AS label, 0 AS rank FROM valleys
    UNION ALL SELECT s.well_id, b.seq, b.ts, b.time_hr, 'shutin', 1 FROM shoulders s JOIN bhp b ON b.well_id = s.well_id AND b.seq = s.seq
    UNION ALL SELECT well_id, seq, ts, time_hr, 'start', 2 FROM bhp WHERE seq = 1
    UNION ALL SELECT b.well_id, seq, ts, time_hr, 'end', 3 FROM bhp b WHERE seq = (SELECT max(seq) FROM bhp c WHERE c.well_id = b.well_id))) WHERE n = 1""", _SHUTINS))
def tpmr_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpmr.tpmr(G.bhp(spark, sf_dir), interval=5).breakpoints.select("well_id", *_r("time_hr"), "label")


# --- flowing transients ---------------------------------------------------------------------------------------------

_MINIMA = f"""
turned AS (SELECT *, round(-sin(angle) * time_hr + cos(angle) * pressure, 9) AS rotated FROM (
    SELECT *, atan((last(pressure) OVER f - first(pressure) OVER f) / nullif(last(time_hr) OVER f - first(time_hr) OVER f, 0)) AS angle
    FROM bhp WINDOW f AS (PARTITION BY well_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))),
marked AS (SELECT *, coalesce(rotated < min(rotated) OVER (PARTITION BY well_id ORDER BY seq ROWS BETWEEN {ORDER} PRECEDING AND 1 PRECEDING)
                          AND rotated < min(rotated) OVER (PARTITION BY well_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND {ORDER} FOLLOWING), false) AS low,
                  seq = first(seq) OVER (PARTITION BY well_id ORDER BY pressure DESC, seq) AS top,
                  min(time_hr) OVER (PARTITION BY well_id) AS lo, max(time_hr) OVER (PARTITION BY well_id) AS hi FROM turned),
minima AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id, time_hr ORDER BY low DESC, seq) AS n FROM marked WHERE low OR top) WHERE n = 1 AND time_hr > lo + {EDGE} AND time_hr < hi - {EDGE})"""


@query(_with(f"SELECT well_id, seq, {_rs('pressure', 'time_hr')} FROM minima", _MINIMA))
def lmir_local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmir.lmir(G.bhp(spark, sf_dir), ORDER, EDGE, EDGE).minima.select("well_id", "seq", *_r("pressure", "time_hr"))


_FLOW = """
flow_points AS (SELECT well_id, seq, ts, time_hr FROM minima UNION ALL SELECT well_id, seq, ts, time_hr FROM bhp WHERE seq = 1
    UNION ALL SELECT well_id, seq, ts, time_hr FROM bhp b WHERE seq = (SELECT max(seq) FROM bhp c WHERE c.well_id = b.well_id)),
flow AS (SELECT * FROM (SELECT well_id, time_hr AS start_hr, lead(time_hr) OVER w AS end_hr, lead(time_hr) OVER w - time_hr AS duration_hr FROM flow_points WINDOW w AS (PARTITION BY well_id ORDER BY time_hr, seq)) WHERE end_hr IS NOT NULL)"""


@query(_with(f"SELECT well_id, {_rs('start_hr', 'end_hr', 'duration_hr')}, 'flowing' AS status FROM flow WHERE duration_hr >= 24", _MINIMA, _FLOW))
def lmir_flowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmir.lmir(G.bhp(spark, sf_dir), ORDER, EDGE, EDGE)
    _, flowing = workflow.filter_flow(found.flow_breakpoints, found.flowing, 24)
    return flowing.select("well_id", *_r("start_hr", "end_hr", "duration_hr"), "status")


@query(_with(f"SELECT DISTINCT well_id, {_rs('time_hr')} FROM (SELECT *, lag(time_hr) OVER w AS b, lead(time_hr) OVER w AS a FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id, ts ORDER BY time_hr, seq) AS n FROM flow_points) WHERE n = 1) WINDOW w AS (PARTITION BY well_id ORDER BY time_hr)) WHERE coalesce(abs(time_hr - b) > 24, false) OR coalesce(abs(a - time_hr) > 24, false)", _MINIMA, _FLOW))
def flow_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmir.lmir(G.bhp(spark, sf_dir), ORDER, EDGE, EDGE)
    points, _ = workflow.filter_flow(found.flow_breakpoints, found.flowing, 24)
    return points.select("well_id", *_r("time_hr")).distinct()


_PERIODS = """
shut AS (SELECT * FROM transients WHERE status = 'shutin'),
periods AS (SELECT *, end_hr - start_hr AS duration_hr FROM (
    SELECT s.well_id, coalesce(lag(s.end_hr) OVER w, 0.0) AS start_hr, s.start_hr AS end_hr FROM shut s WINDOW w AS (PARTITION BY s.well_id ORDER BY s.start_hr)
    UNION ALL SELECT well_id, max(end_hr), (SELECT max(time_hr) FROM bhp b WHERE b.well_id = shut.well_id) FROM shut GROUP BY well_id) WHERE end_hr - start_hr <> 0)"""


@query(_with(f"SELECT well_id, {_rs('start_hr', 'end_hr', 'duration_hr')} FROM periods", _PERIODS))
def injection_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.bhp(spark, sf_dir)
    return workflow.injection_periods(G.grid_transients(b).filter("status = 'shutin'").drop("transient_id"), b).select("well_id", *_r("start_hr", "end_hr", "duration_hr"))


_ALL = """
every AS (SELECT well_id, ts, time_hr, 'start' AS label, 0 AS rank FROM bhp WHERE seq = 1
    UNION ALL SELECT well_id, ts, time_hr, 'end', 0 FROM bhp b WHERE seq = (SELECT max(seq) FROM bhp c WHERE c.well_id = b.well_id)
    UNION ALL SELECT well_id, start_ts, start_hr, 'shutin', 1 FROM transients WHERE status = 'shutin' UNION ALL SELECT well_id, end_ts, end_hr, 'shutin', 1 FROM transients WHERE status = 'shutin'
    UNION ALL SELECT well_id, ts, time_hr, 'multibp', 2 FROM minima),
points AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id, ts ORDER BY rank, label DESC) AS n FROM every) WHERE n = 1)"""


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = G.bhp(spark, sf_dir)
    t = G.grid_transients(b)
    return b, t, workflow.all_breakpoints(t.filter("status = 'shutin'"), lmir.lmir(b, ORDER, EDGE, EDGE).minima, b)


@query(_with(f"SELECT well_id, {_rs('time_hr')}, label FROM points", _MINIMA, _ALL))
def all_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir)[2].select("well_id", *_r("time_hr"), "label")


_NEAR = "EXISTS (SELECT 1 FROM transients t WHERE t.well_id = p.well_id AND t.start_hr > 10 AND p.time_hr >= t.start_hr - 10 AND p.time_hr < t.start_hr)"


@query(_with(f"SELECT well_id, {_rs('time_hr')}, label, {_NEAR} AS removed FROM points p", _MINIMA, _ALL))
def filter_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, p = _points(spark, sf_dir)
    return workflow.flag_breakpoints(p, t, 10).select("well_id", *_r("time_hr"), "label", "removed")


# --- rates ----------------------------------------------------------------------------------------------------------


def _rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = G.bhp(spark, sf_dir)
    p = G.grid(b)
    return b, p, workflow.weighted_rates(G.rate(spark, sf_dir), p)


@query(_with(f"SELECT well_id, seq, {_rs('start_hr', 'end_hr', 'rate')} FROM rates", G.RATES_SQL))
def weighted_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir)[2].select("well_id", "seq", *_r("start_hr", "end_hr", "rate"))


@query(_with(f"""SELECT t.well_id, {_rs('t.start_hr', 't.end_hr')}, CASE WHEN status = 'shutin' AND rate <> 0 THEN 'flowing' WHEN status = 'flowing' AND rate = 0 THEN 'shutin' ELSE status END AS status
    FROM transients t LEFT JOIN rates r ON r.well_id = t.well_id AND r.start_ts = t.start_ts""", G.RATES_SQL))
def validate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, _, r = _rates(spark, sf_dir)
    t = G.grid_transients(b)
    shut, flow = workflow.validate_shutin_rate(t.filter("status = 'shutin'"), r, t.filter("status = 'flowing'"))
    shut, flow = workflow.validate_flowing_rate(shut, r, flow)
    return shut.unionByName(flow).select("well_id", *_r("start_hr", "end_hr"), "status")


_INPUTS = """
q AS (SELECT well_id, ts, arg_min(rate, seq) AS q FROM rate GROUP BY well_id, ts),
qr AS (SELECT well_id, ts, arg_min(q_rebuilt, k) AS q_rebuilt FROM (SELECT well_id, start_ts AS ts, rate AS q_rebuilt, 0 AS k FROM rates
    UNION ALL SELECT r.well_id, z, arg_max(rate, start_ts), 1 FROM rates r JOIN (SELECT well_id, max(ts) AS z FROM rate GROUP BY well_id) USING (well_id) GROUP BY r.well_id, z) GROUP BY well_id, ts),
filled AS (SELECT well_id, ts, last_value(q_rebuilt IGNORE NULLS) OVER w AS q_rebuilt, last_value(q IGNORE NULLS) OVER w AS q FROM q FULL JOIN qr USING (well_id, ts) WINDOW w AS (PARTITION BY well_id ORDER BY ts)),
steps AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY well_id ORDER BY ts))) / 8.64e10::DOUBLE AS dt FROM filled WHERE q_rebuilt IS NOT NULL AND q IS NOT NULL),
inputs AS (SELECT *, coalesce(sum(q * dt) OVER w, 0) AS Q_run, coalesce(sum(abs(q_rebuilt - q) * dt) OVER w, 0) AS E_run FROM steps WINDOW w AS (PARTITION BY well_id ORDER BY ts))"""


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare.rare_inputs(G.rate(spark, sf_dir), _rates(spark, sf_dir)[2])


@query(_with(f"SELECT well_id, row_number() OVER (PARTITION BY well_id ORDER BY ts) AS k, {_rs('q_rebuilt', 'q', 'dt')}, round(Q_run, 5) AS volume, round(E_run, 5) AS error FROM inputs", G.RATES_SQL, _INPUTS))
def rare_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return _inputs(spark, sf_dir).select("well_id", F.row_number().over(Window.partitionBy("well_id").orderBy("ts")).alias("k"), *_r("q_rebuilt", "q", "dt"), F.round("volume", 5).alias("volume"), F.round("error", 5).alias("error"))


@query(_with("SELECT well_id, round(least((arg_max(E_run, ts) - arg_min(E_run, ts)) / nullif(abs(arg_max(Q_run, ts) - arg_min(Q_run, ts)), 0), 1.0), 6) AS rare FROM inputs GROUP BY well_id", G.RATES_SQL, _INPUTS))
def rare_by_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare.rare(_inputs(spark, sf_dir)).select("well_id", *_r("rare"))


# --- log-log --------------------------------------------------------------------------------------------------------

_SUPER = """
prefix AS (SELECT t.well_id, t.transient_id, t.status, r.seq, r.start_hr AS bp, r.rate, r.rate - coalesce(lag(r.rate) OVER w, 0) AS dq
           FROM transients t JOIN rates r ON r.well_id = t.well_id AND r.start_hr <= t.start_hr WINDOW w AS (PARTITION BY t.well_id, t.transient_id ORDER BY r.seq)),
norms AS (SELECT well_id, transient_id, arg_max(rate, seq) AS last_q, arg_max(rate, seq) FILTER (rate <> 0) AS last_nz, count(*) AS n FROM prefix GROUP BY well_id, transient_id),
within AS (SELECT b.well_id, t.transient_id, t.status, b.seq, b.pressure, b.time_hr, first(b.seq) OVER w AS s0, first(b.pressure) OVER w AS p0, first(b.time_hr) OVER w AS t0
           FROM bhp b JOIN transients t ON t.well_id = b.well_id AND b.time_hr BETWEEN t.start_hr AND t.end_hr WINDOW w AS (PARTITION BY b.well_id, t.transient_id ORDER BY b.seq)),
superposed AS (SELECT w.well_id, w.transient_id, w.status, w.seq, abs(w.pressure - p0) AS delta_pressure, w.time_hr - t0 AS delta_time,
                  sum(CASE WHEN w.status = 'shutin' THEN -p.dq / nullif(last_nz, 0) ELSE p.dq / nullif(last_q, 0) END * log10(w.time_hr - p.bp)) AS superposition,
                  count(*) AS terms
           FROM within w JOIN prefix p USING (well_id, transient_id) JOIN norms USING (well_id, transient_id) WHERE w.seq > s0 GROUP BY w.well_id, w.transient_id, w.status, w.seq, w.pressure, w.time_hr, p0, t0)"""


def _loglog(spark: SparkSession, sf_dir: str, injection: bool) -> tuple[DataFrame, DataFrame]:
    b, p, r = _rates(spark, sf_dir)
    t = G.grid_transients(b).filter(F.col("status") == ("flowing" if injection else "shutin"))
    steps = loglog.rate_steps(p, r)
    ends = loglog.last_steps(steps, t)
    return loglog.superposition(loglog.transient_samples(b, t), steps, ends, injection), ends


def _superposition_sql(status: str) -> str:
    return _with(f"SELECT well_id, transient_id, seq, {_rs('superposition')}, {_uss('delta_time')}, {_rs('delta_pressure', n=4)} FROM superposed WHERE status = '{status}'", G.RATES_SQL, _SUPER)


@query(_superposition_sql("shutin"))
def superposition_shutin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loglog(spark, sf_dir, False)[0].select("well_id", "transient_id", "seq", *_r("superposition"), *_us("delta_time"), *_r("delta_pressure", n=4))


@query(_superposition_sql("flowing"))
def superposition_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loglog(spark, sf_dir, True)[0].select("well_id", "transient_id", "seq", *_r("superposition"), *_us("delta_time"), *_r("delta_pressure", n=4))


_DER = """
pts AS (SELECT *, row_number() OVER (PARTITION BY well_id, transient_id ORDER BY seq) AS i FROM superposed WHERE status = 'flowing'),
js AS (SELECT a.*, min(b.i) AS j FROM pts a JOIN pts b ON b.well_id = a.well_id AND b.transient_id = a.transient_id AND b.i > a.i AND b.delta_time > a.delta_time * exp(0.2) GROUP BY ALL),
ks AS (SELECT a.well_id, a.transient_id, a.i, a.j, coalesce(min(c.i) FILTER (c.delta_time > m.delta_time * exp(0.2)), min(c.i)) AS k
       FROM js a JOIN pts m ON m.well_id = a.well_id AND m.transient_id = a.transient_id AND m.i = a.j
       JOIN pts c ON c.well_id = a.well_id AND c.transient_id = a.transient_id AND c.i > a.j AND c.delta_time > m.delta_time * exp(0.1) GROUP BY ALL),
ders AS (SELECT x.well_id, x.transient_id, ks.i, m.superposition, m.delta_pressure, m.delta_time, m.superposition - x.superposition AS x1, z.superposition - m.superposition AS x2, abs(m.delta_pressure - x.delta_pressure) AS d1, abs(z.delta_pressure - m.delta_pressure) AS d2
       FROM ks JOIN pts x ON x.well_id = ks.well_id AND x.transient_id = ks.transient_id AND x.i = ks.i JOIN pts m ON m.well_id = ks.well_id AND m.transient_id = ks.transient_id AND m.i = ks.j JOIN pts z ON z.well_id = ks.well_id AND z.transient_id = ks.transient_id AND z.i = ks.k),
der AS (SELECT *, (d1 / nullif(x1, 0) * x2 + d2 / nullif(x2, 0) * x1) / nullif(x1 + x2, 0) / ln(10) AS derivative FROM ders)"""


@query(_with(f"SELECT well_id, transient_id, {_uss('delta_time')}, {_rs('delta_pressure', n=4)}, round(derivative, 4) + 0.0 AS derivative FROM der", G.RATES_SQL, _SUPER, _DER))
def bourdet_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = loglog.derivative(_loglog(spark, sf_dir, True)[0], 0.2)
    return d.select("well_id", "transient_id", *_us("delta_time"), *_r("delta_pressure", n=4), (F.round("derivative", 4) + F.lit(0.0)).alias("derivative"))


_NORM = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY well_id, transient_id ORDER BY seq) AS o FROM prefix),
own AS (SELECT well_id, transient_id, any_value(n) AS n, any_value(last_nz) AS q, max(CASE WHEN o = n THEN rate END) AS z, max(CASE WHEN o = n - 1 THEN rate END) AS y FROM ordered JOIN norms USING (well_id, transient_id) GROUP BY well_id, transient_id),
ref_id AS (SELECT well_id, max(transient_id) AS transient_id FROM transients WHERE status = 'flowing' GROUP BY well_id),
ref_at AS (SELECT o.well_id, o.transient_id, max(o) AS pos FROM ordered o JOIN ref_id USING (well_id, transient_id) WHERE rate <> 0 GROUP BY o.well_id, o.transient_id),
ref AS (SELECT a.well_id, max(CASE WHEN o = pos THEN rate END) AS qr, coalesce(max(CASE WHEN o = pos - 1 THEN rate END), 0) AS qp FROM ref_at a JOIN ordered o USING (well_id, transient_id) GROUP BY a.well_id),
normed AS (SELECT d.*, qr, qp, CASE WHEN z = 0 THEN q WHEN n > 1 AND z <> y THEN z - y ELSE z END AS dq, q FROM der d JOIN own USING (well_id, transient_id) JOIN ref USING (well_id))"""


@query(_with(f"""SELECT well_id, transient_id, {_uss('delta_time')}, round(delta_pressure * abs(qr / nullif(dq, 0)), 3) + 0.0 AS pn_saphir, round(delta_pressure * abs((qr - qp) / nullif(dq, 0)), 3) + 0.0 AS pn_autowell,
    round(derivative * abs(qr / nullif(q, 0)), 3) + 0.0 AS derivative_saphir, round(derivative * abs((qr - qp) / nullif(q, 0)), 3) + 0.0 AS derivative_autowell FROM normed""", G.RATES_SQL, _SUPER, _DER, _NORM))
def normalized_loglog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, ends = _loglog(spark, sf_dir, True)
    ref = ends.groupBy("well_id").agg(F.max_by(F.struct("nonzero", "nonzero_before"), "transient_id").alias("r")).select("well_id", "r.*")
    n = loglog.normalize(loglog.derivative(s, 0.2), ends, ref)
    return n.select("well_id", "transient_id", *_us("delta_time"), *_r("pn_saphir", "pn_autowell", "derivative_saphir", "derivative_autowell", n=3))


#: Each grid point's mean and deviation straight from all values within its window.
_ENVELOPE = """
curve AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w IS NULL AS first FROM (SELECT well_id, transient_id, delta_time AS x, derivative AS y FROM der WHERE derivative IS NOT NULL)
          WINDOW w AS (PARTITION BY well_id, transient_id ORDER BY x, y)),
extent AS (SELECT well_id, log10(greatest(min(x), 1e-12)) AS l0, log10(max(x)) AS l1 FROM curve GROUP BY well_id),
env_grid AS (SELECT well_id, CAST(g AS INT) AS g, pow(10.0, l0 + g * (l1 - l0) / 499) AS grid FROM extent CROSS JOIN (SELECT unnest(range(500)) AS g)),
pooled AS (SELECT c.well_id, g, CASE WHEN x1 IS NULL OR grid < x THEN y ELSE y + (y1 - y) / (x1 - x) * (grid - x) END AS v
           FROM curve c JOIN env_grid q ON q.well_id = c.well_id AND (first OR grid >= x) AND (x1 IS NULL OR grid < x1)),
half AS (SELECT well_id, greatest(1, CAST(round_even(0.2 / nullif(log10(max(grid) FILTER (g = 1) / max(grid) FILTER (g = 0)), 0), 0) AS INT)) AS h FROM env_grid GROUP BY well_id),
logs AS (SELECT well_id, g, log10(v) AS lv FROM pooled WHERE v > 0),
windows AS (SELECT q.well_id, q.g, q.grid, avg(lv) AS m, stddev_pop(lv) AS d FROM env_grid q JOIN half USING (well_id) LEFT JOIN logs l ON l.well_id = q.well_id AND l.g BETWEEN q.g - h AND q.g + h GROUP BY q.well_id, q.g, q.grid),
filled_windows AS (SELECT well_id, g, grid, last_value(m IGNORE NULLS) OVER w AS m, coalesce(last_value(d IGNORE NULLS) OVER w, 0) AS d FROM windows WINDOW w AS (PARTITION BY well_id ORDER BY g))"""


@query(_with(f"SELECT well_id, g, {_rs('grid')}, round(pow(10, m), 3) + 0.0 AS mean, round(pow(10, m - 2 * d), 3) + 0.0 AS lower, round(pow(10, m + 2 * d), 3) + 0.0 AS upper FROM filled_windows", G.RATES_SQL, _SUPER, _DER, _ENVELOPE))
def uncertainty_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = loglog.derivative(_loglog(spark, sf_dir, True)[0], 0.2).filter(F.abs("derivative") < float("inf"))
    return loglog.envelope(d, ["well_id"]).select("well_id", "g", *_r("grid"), *_r("mean", "lower", "upper", n=3))


# --- quality --------------------------------------------------------------------------------------------------------


def _quality(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = G.bhp(spark, sf_dir)
    return G.grid_transients(b), G.rate(spark, sf_dir), b


_RESIDUALS = """
x0 AS (SELECT t.well_id, t.transient_id, b.seq, b.pressure, b.pressure - lag(b.pressure) OVER w AS d, abs(b.pressure - avg(b.pressure) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) AS res
       FROM transients t JOIN bhp b ON b.well_id = t.well_id AND b.ts >= t.start_ts AND b.ts < t.end_ts WINDOW w AS (PARTITION BY t.well_id, t.transient_id ORDER BY b.ts, b.seq)),
x1 AS (SELECT *, CAST(sign(d) <> sign(lag(d) OVER (PARTITION BY well_id, transient_id ORDER BY seq)) AS INT) AS turn FROM x0),
agg AS (SELECT well_id, transient_id, count(*) AS n, sum(turn) AS turns, sum(abs(d)) AS path, arg_max(pressure, seq) AS z, arg_min(pressure, seq) AS a, median(res) AS mid, avg(res) AS mean_res FROM x1 GROUP BY well_id, transient_id),
mads AS (SELECT well_id, transient_id, median(abs(res - mid)) AS mad FROM x1 JOIN agg USING (well_id, transient_id) GROUP BY well_id, transient_id),
of_pressure AS (SELECT transients.well_id, transients.transient_id, CASE WHEN n >= 2 THEN 1 - coalesce(turns, 0) / greatest(n - 2, 1) END AS monotonicity_ratio,
    CASE WHEN n >= 2 THEN 1 / (1 + exp(0.2 * (mean_res / greatest(mad * 1.4826, 1e-6) - 50))) END AS local_deviation, CASE WHEN n >= 2 THEN coalesce(abs(z - a) / nullif(path, 0), 1.0) END AS trend_efficiency
    FROM transients LEFT JOIN agg USING (well_id, transient_id) LEFT JOIN mads USING (well_id, transient_id))"""


@query(_with(f"SELECT well_id, transient_id, {_rs(*scores.PRESSURE)} FROM of_pressure", _RESIDUALS))
def pressure_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _, b = _quality(spark, sf_dir)
    return scores.pressure_features(t, b).select("well_id", "transient_id", *_r(*scores.PRESSURE))


_OF_RATE = """
of_rate AS (SELECT t.well_id, t.transient_id, stddev_samp(rate) FILTER (r.ts >= t.start_ts) AS rate_std, stddev_samp(rate) FILTER (r.ts < t.start_ts) AS rate_td_std,
    quantile_cont(rate, 0.9) FILTER (r.ts >= t.start_ts) - quantile_cont(rate, 0.1) FILTER (r.ts >= t.start_ts) AS rate_iqr
    FROM transients t LEFT JOIN rate r ON r.well_id = t.well_id AND r.ts < t.end_ts AND epoch_us(r.ts) >= epoch_us(t.start_ts) - CAST(round(t.duration_hr * 3.6e9) AS BIGINT) GROUP BY t.well_id, t.transient_id)"""


@query(_with(f"SELECT well_id, transient_id, {_rs(*scores.RATE)} FROM of_rate", _OF_RATE))
def rate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r, _ = _quality(spark, sf_dir)
    return scores.rate_features(t, r).select("well_id", "transient_id", *_r(*scores.RATE))


def _of_change() -> str:
    cols = []
    for k, s in scores.SCALES.items():
        b = f"r.us < 0 AND r.us >= -round({s} * dur * 3.6e9)"
        a = f"r.us >= 0 AND r.us < round({s} * dur * 3.6e9)"
        cols.append(f"CASE WHEN count(*) FILTER ({b}) > 2 AND count(*) FILTER ({a}) > 2 THEN abs(avg(rate) FILTER ({a}) - avg(rate) FILTER ({b})) / greatest(stddev_samp(rate) FILTER ({b}), stddev_samp(rate) FILTER ({a}), 1e-6) END AS rate_change_snr_{k}")
    return f"of_change AS (SELECT well_id, transient_id, {', '.join(cols)} FROM (SELECT t.well_id, t.transient_id, t.duration_hr AS dur, r.rate, epoch_us(r.ts) - epoch_us(t.start_ts) AS us FROM transients t LEFT JOIN rate r ON r.well_id = t.well_id) r GROUP BY well_id, transient_id)"


@query(_with(f"SELECT well_id, transient_id, {_rs(*[f'rate_change_snr_{k}' for k in scores.SCALES])} FROM of_change", _of_change()))
def rate_change_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r, _ = _quality(spark, sf_dir)
    return scores.rate_change(t, r).select("well_id", "transient_id", *_r(*[f"rate_change_snr_{k}" for k in scores.SCALES]))


#: Two-sided signed-rank tests: exact for up to 50 differences without ties and zeros, else normal; p < 0.05 is a standard score over 1.959963984540054.
_TESTS = f"""
scales(k, s) AS (VALUES {", ".join(f"('{k}', {s})" for k, s in scores.SCALES.items())}),
around AS (SELECT t.well_id, t.transient_id, k, r.rate, us, us < 0 AS early, row_number() OVER (PARTITION BY t.well_id, t.transient_id, k, us < 0 ORDER BY us, r.seq) AS o, count(*) OVER (PARTITION BY t.well_id, t.transient_id, k, us < 0) AS n
           FROM transients t CROSS JOIN scales JOIN (SELECT *, epoch_us(ts) AS at FROM rate) r ON r.well_id = t.well_id, LATERAL (SELECT r.at - epoch_us(t.start_ts) AS us) u
           WHERE us >= -round(t.duration_hr * s * 3.6e9) AND us < round(t.duration_hr * s * 3.6e9)),
both_sides AS (SELECT b.well_id, b.transient_id, b.k, b.rate - a.rate AS d FROM around b JOIN around a ON a.well_id = b.well_id AND a.transient_id = b.transient_id AND a.k = b.k AND b.early AND NOT a.early
               AND b.o - greatest(b.n - a.n, 0) = a.o WHERE b.n > 2 AND a.n > 2),
ranked AS (SELECT *, rank() OVER (PARTITION BY well_id, transient_id, k ORDER BY abs(d)) + (tied - 1) / 2.0::DOUBLE AS r FROM (
           SELECT *, count(*) OVER (PARTITION BY well_id, transient_id, k, abs(d)) AS tied FROM both_sides WHERE d <> 0)),
zeros AS (SELECT well_id, transient_id, k, count(*) FILTER (d = 0) AS n_zero FROM both_sides GROUP BY ALL),
stats AS (SELECT well_id, transient_id, k, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, max(tied) AS most, sum(tied::DOUBLE * tied - 1) AS tie FROM ranked GROUP BY ALL),
ways(n, w, c) AS (SELECT 0, 0, 1.0::DOUBLE UNION ALL SELECT n + 1, w + step * (n + 1), sum(c) FROM ways CROSS JOIN (VALUES (0), (1)) v(step) WHERE n < 50 GROUP BY n + 1, w + step * (n + 1)),
tails AS (SELECT n, w, least(1.0, 2 * sum(c) OVER (PARTITION BY n ORDER BY w) / pow(2.0, n)) AS p FROM ways),
tested AS (SELECT s.well_id, s.transient_id, s.k, CASE WHEN s.n <= 50 AND most = 1 AND n_zero = 0 THEN p < 0.05
               ELSE abs(least(plus, s.n * (s.n + 1) / 2 - plus) - s.n * (s.n + 1) / 4.0::DOUBLE) > 1.959963984540054 * sqrt(s.n * (s.n + 1) * (2 * s.n + 1) / 24.0::DOUBLE - tie / 48) END AS differ
           FROM stats s JOIN zeros USING (well_id, transient_id, k) LEFT JOIN tails t ON t.n = s.n AND t.w = CAST(floor(least(plus, s.n * (s.n + 1) / 2 - plus)) AS INT))"""


_OF_TESTS = "of_tests AS (SELECT t.well_id, t.transient_id, " + ", ".join(f"CAST(coalesce(bool_or(differ) FILTER (k = '{k}'), false) AS INT) AS binary_rate_change_{k}" for k in scores.SCALES) + " FROM transients t LEFT JOIN tested x ON x.well_id = t.well_id AND x.transient_id = t.transient_id GROUP BY t.well_id, t.transient_id)"


@query(_with("SELECT * FROM of_tests", _TESTS, _OF_TESTS))
def rate_change_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r, _ = _quality(spark, sf_dir)
    return scores.rate_tests(t, r)


def _scores_sql() -> str:
    mean = lambda parts: f"list_avg(list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL))"
    bounds = ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in scores.RATE)
    scaled = [f"CASE WHEN {c} < lo_{c} THEN 1.0 WHEN {c} > hi_{c} THEN 0.0 ELSE 1 - ({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0) END" for c in scores.RATE]
    change = " + ".join(f"coalesce(1 / (1 + exp(-2 * (rate_change_snr_{k} - 1))), 0.5) + binary_rate_change_{k}" for k in scores.SCALES)
    return _with(f"""SELECT well_id, transient_id, round({mean(scores.PRESSURE)}, 6) + 0.0 AS pressure_score, round({mean(scaled)}, 6) + 0.0 AS rate_score, round(({change}) / 6, 6) + 0.0 AS significance_score
    FROM of_pressure JOIN of_rate USING (well_id, transient_id) JOIN of_change USING (well_id, transient_id) JOIN of_tests USING (well_id, transient_id) CROSS JOIN (SELECT {bounds} FROM of_rate)""", _RESIDUALS, _OF_RATE, _of_change(), _TESTS, _OF_TESTS)


@query(_scores_sql())
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r, b = _quality(spark, sf_dir)
    return scores.scores(t, r, b, merge=False).select("well_id", "transient_id", *_r("pressure_score", "rate_score", "significance_score"))


# --- workflow -------------------------------------------------------------------------------------------------------


def _workflow(spark: SparkSession, sf_dir: str) -> workflow.Workflow:
    return workflow.ti_workflow(G.bhp(spark, sf_dir), G.rate(spark, sf_dir), interval_shutin=24, interval_injection=24, order=ORDER, start_filter_hours=EDGE, end_filter_hours=EDGE)


#: The whole workflow: wells with a shut-in of over 24 hours by their periods between shut-ins (period 1 and on), the others as one period 0.
_WORKFLOW = f"""
long AS (SELECT * FROM shutins WHERE duration_hr > 24),
long_wells AS (SELECT DISTINCT well_id FROM long),
every_shutin AS (SELECT s.* FROM shutins s SEMI JOIN long_wells USING (well_id)),
last_at AS (SELECT well_id, arg_max(time_hr, seq) AS z FROM bhp GROUP BY well_id),
between_shutins AS (SELECT well_id, coalesce(lag(end_hr) OVER w, 0.0) AS start_hr, start_hr AS end_hr FROM every_shutin WINDOW w AS (PARTITION BY well_id ORDER BY start_hr, end_hr)
    UNION ALL SELECT well_id, end_hr, z FROM (SELECT *, lead(start_hr) OVER (PARTITION BY well_id ORDER BY start_hr, end_hr) AS next FROM every_shutin) JOIN last_at USING (well_id) WHERE next IS NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY start_hr, end_hr) AS period FROM between_shutins WHERE end_hr - start_hr <> 0),
samples AS (SELECT b.*, period FROM bhp b JOIN numbered n ON n.well_id = b.well_id AND b.time_hr BETWEEN n.start_hr AND n.end_hr UNION ALL SELECT b.*, 0 FROM bhp b ANTI JOIN long_wells USING (well_id)),
bent AS (SELECT *, round(-sin(angle) * time_hr + cos(angle) * pressure, 9) AS rotated FROM (
    SELECT *, atan((last(pressure) OVER f - first(pressure) OVER f) / nullif(last(time_hr) OVER f - first(time_hr) OVER f, 0)) AS angle
    FROM samples WINDOW f AS (PARTITION BY well_id, period ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))),
lows AS (SELECT *, coalesce(rotated < min(rotated) OVER (PARTITION BY well_id, period ORDER BY seq ROWS BETWEEN {ORDER} PRECEDING AND 1 PRECEDING)
                        AND rotated < min(rotated) OVER (PARTITION BY well_id, period ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND {ORDER} FOLLOWING), false) AS low,
                seq = first(seq) OVER (PARTITION BY well_id, period ORDER BY pressure DESC, seq) AS top,
                min(time_hr) OVER (PARTITION BY well_id, period) AS lo, max(time_hr) OVER (PARTITION BY well_id, period) AS hi,
                min(seq) OVER (PARTITION BY well_id, period) AS s0, max(seq) OVER (PARTITION BY well_id, period) AS s1 FROM bent),
low_points AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id, period, time_hr ORDER BY low DESC, seq) AS n FROM lows WHERE low OR top) WHERE n = 1 AND time_hr > lo + {EDGE} AND time_hr < hi - {EDGE}),
splits AS (SELECT well_id, period, seq, ts, time_hr FROM low_points UNION ALL SELECT well_id, period, seq, ts, time_hr FROM lows WHERE seq = s0 UNION ALL SELECT well_id, period, seq, ts, time_hr FROM lows WHERE seq = s1),
flows AS (SELECT well_id, period, start_ts, start_hr, end_hr, end_hr - start_hr AS duration_hr FROM (
    SELECT well_id, period, ts AS start_ts, time_hr AS start_hr, lead(time_hr) OVER (PARTITION BY well_id, period ORDER BY time_hr, seq) AS end_hr FROM splits) WHERE end_hr - start_hr >= 24),
raised AS (SELECT well_id, ts, time_hr, 'start' AS label, 0 AS rank FROM bhp SEMI JOIN long_wells USING (well_id) WHERE seq = 1
    UNION ALL SELECT b.well_id, ts, time_hr, 'end', 0 FROM bhp b SEMI JOIN long_wells USING (well_id) WHERE seq = (SELECT max(seq) FROM bhp c WHERE c.well_id = b.well_id)
    UNION ALL SELECT well_id, start_ts, start_hr, 'shutin', 1 FROM every_shutin UNION ALL SELECT well_id, end_ts, end_hr, 'shutin', 1 FROM every_shutin
    UNION ALL SELECT well_id, ts, time_hr, 'multibp', 2 FROM low_points WHERE period > 0),
starts AS (SELECT well_id, start_hr FROM long UNION SELECT well_id, start_hr FROM flows WHERE period > 0),
marks AS (SELECT well_id, ts, time_hr, label FROM (SELECT *, row_number() OVER (PARTITION BY well_id, ts ORDER BY rank, label DESC) AS n FROM raised) r
          WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM starts t WHERE t.well_id = r.well_id AND t.start_hr > 2 AND r.time_hr >= t.start_hr - 2 AND r.time_hr < t.start_hr)
    UNION ALL SELECT well_id, ts, time_hr, 'multibp' FROM (SELECT *, row_number() OVER (PARTITION BY well_id, ts ORDER BY time_hr, seq) AS n FROM splits WHERE period = 0) WHERE n = 1),
spans AS (SELECT * FROM (SELECT well_id, ts AS start_ts, time_hr AS start_hr, lead(ts) OVER w AS end_ts, lead(time_hr) OVER w AS end_hr, row_number() OVER w AS seq
          FROM marks WINDOW w AS (PARTITION BY well_id ORDER BY ts)) WHERE end_ts IS NOT NULL),
{G.RATES_SQL.replace(" tiles ", " spans ").lstrip()},
found AS (SELECT f.*, r.rate FROM (SELECT well_id, start_ts, start_hr, end_hr, duration_hr, 'shutin' AS status, false AS single FROM long
          UNION ALL SELECT well_id, start_ts, start_hr, end_hr, duration_hr, 'flowing', period = 0 FROM flows) f LEFT JOIN rates r ON r.well_id = f.well_id AND r.start_ts = f.start_ts)"""


def _workflow_sql(select: str) -> str:
    return _with(select, _SHUTINS, _WORKFLOW)


@query(_workflow_sql(f"""SELECT well_id, {_uss('start_hr', 'end_hr', 'duration_hr')}, CASE WHEN single THEN status WHEN status = 'shutin' AND rate <> 0 THEN 'flowing' WHEN status = 'flowing' AND rate = 0 THEN 'shutin' ELSE status END AS status FROM found"""))
def workflow_transients(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workflow(spark, sf_dir)
    return w.shutin.unionByName(w.flowing).select("well_id", *_us("start_hr", "end_hr", "duration_hr"), "status")


@query(_workflow_sql(f"SELECT well_id, {_uss('time_hr')}, label FROM marks"))
def workflow_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workflow(spark, sf_dir).breakpoints.select("well_id", *_us("time_hr"), "label")


@query(_workflow_sql(f"SELECT well_id, seq, {_uss('start_hr', 'end_hr')}, {_rs('rate')} FROM rates"))
def workflow_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workflow(spark, sf_dir).weighted_rates.select("well_id", "seq", *_us("start_hr", "end_hr"), *_r("rate"))


@query(_with(f"SELECT well_id, {_uss('x0', 'x1')}, status AS label, CASE status {' '.join(f"WHEN '{k}' THEN '{plots.COLOURS[k]}'" for k in ('shutin', 'flowing'))} END AS colour FROM (SELECT *, start_hr AS x0, end_hr AS x1 FROM transients)"))
def plot_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.bands(G.grid_transients(G.bhp(spark, sf_dir))).select("well_id", *_us("x0", "x1"), "label", "colour")


# --- regimes and patterns -------------------------------------------------------------------------------------------


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flowing transients of each well as a time-lapse group."""
    d = loglog.derivative(_loglog(spark, sf_dir, True)[0], 0.2).filter(F.abs("derivative") < float("inf"))
    x = d.groupBy("well_id", "transient_id", F.col("delta_time").alias("time")).agg(F.min("delta_pressure").alias("pressure"), F.avg("derivative").alias("derivative"))
    return x.filter("time > 0 and derivative > 0").withColumnRenamed("well_id", "group_id")


def _smoothed_sql(name: str, source: str, width: str) -> str:
    """Each point's value on the parabola through the window around it, or at the ends through the first or last window; source: tid, m, n, t, y."""
    h = f"({width} // 2)"
    at = f"greatest(0, least(a.m - {h}, a.n - {width}))"
    r, q = f"(a.m - {at} - {h})", f"(b.m - {at} - {h})"
    mu = f"({h} * ({h} + 1) / 3.0::DOUBLE)"  # mean square of the places -h to h
    s2 = f"({width} * {mu})"
    s4 = f"({width} * ({h} * ({h} + 1) * (3 * {h} * {h} + 3 * {h} - 1) / 15.0::DOUBLE - {mu} * {mu}))"
    weight = f"(1.0::DOUBLE / {width} + {r} * {q} / {s2} + ({r} * {r} - {mu}) * ({q} * {q} - {mu}) / {s4})"
    return f"""{name} AS (SELECT a.tid, a.m, a.n, a.t, CASE WHEN a.n < 30 THEN any_value(a.y) ELSE sum({weight} * b.y) END AS y
    FROM {source} a JOIN {source} b ON b.tid = a.tid AND b.m >= {at} AND b.m < {at} + {width} GROUP BY a.tid, a.m, a.n, a.t)"""


def _regimes_sql() -> tuple[str, ...]:
    slopes = ", ".join(f"({k}, {s}::DOUBLE)" for k, s in enumerate(regimes.SLOPES))
    p = regimes.Params()
    w = p.bdw
    return (
        f"""family AS (SELECT *, dense_rank() OVER (ORDER BY well_id, transient_id) AS tid FROM (SELECT well_id, transient_id, delta_time AS x, min(delta_pressure) AS p, avg(derivative) AS d FROM der
    WHERE derivative IS NOT NULL GROUP BY well_id, transient_id, delta_time) WHERE x > 0 AND d > 0),
stretches AS (SELECT *, lead(x) OVER w AS x1, lead(p) OVER w AS p1, lead(d) OVER w AS d1, lag(x) OVER w IS NULL AS first, min(x) OVER (PARTITION BY tid) AS lo, max(x) OVER (PARTITION BY tid) AS hi
    FROM family WINDOW w AS (PARTITION BY tid ORDER BY x)),
resampled AS (SELECT well_id, transient_id, tid, m, grid AS t, p + (p1 - p) / (x1 - x) * (grid - x) AS p, d + (d1 - d) / (x1 - x) * (grid - x) AS d FROM (
    SELECT *, unnest(range(500)) AS m, pow(10.0, log10(lo) + unnest(range(500)) * (log10(hi) - log10(lo)) / 499) AS grid FROM stretches WHERE x1 IS NOT NULL) WHERE (first OR grid >= x) AND (x1 = hi OR grid < x1)),
curves AS (SELECT tid, m, 500 AS n, log10(t) AS t, CASE WHEN d > 0 THEN log10(d) ELSE 0 END AS y FROM resampled)""",
        _smoothed_sql("smooth_all", "curves", str(p.dsw)),
        f"""lines AS MATERIALIZED (SELECT p.tid * 500 + k AS id, (q.y - p.y) / (q.t - p.t) AS b, p.y - (q.y - p.y) / (q.t - p.t) * p.t AS a
    FROM (SELECT DISTINCT tid, m AS k FROM curves WHERE m < 500 - {w}) a JOIN smooth_all p ON p.tid = a.tid AND p.m >= k AND p.m < k + {w} JOIN smooth_all q ON q.tid = a.tid AND q.m > p.m AND q.m < k + {w}),
medians AS (SELECT id, 0 AS round, avg(a) AS a, avg(b) AS b, 1.0::DOUBLE AS moved FROM lines GROUP BY id
    UNION ALL SELECT id, round + 1, a + da, b + db, greatest(abs(da), abs(db)) FROM (SELECT id, round, a, b, (1 - share) * ma / total AS da, (1 - share) * mb / total AS db FROM (
        SELECT id, any_value(round) AS round, any_value(a) AS a, any_value(b) AS b, sum(da * w) AS ma, sum(db * w) AS mb, sum(w) AS total,
            CASE WHEN min(w) = 0 THEN least(1.0, 1 / greatest(sqrt(pow(sum(da * w), 2) + pow(sum(db * w), 2)), 1e-300)) ELSE 0 END AS share
        FROM (SELECT *, CASE WHEN far < 1e-12 THEN 0 ELSE 1 / far END AS w FROM (SELECT *, sqrt(da * da + db * db) AS far FROM (
            SELECT i.id, i.round, i.a, i.b, l.a - i.a AS da, l.b - i.b AS db FROM medians i JOIN lines l ON l.id = i.id WHERE i.moved >= 1e-10 AND i.round < 60))) GROUP BY id))),
slopes AS (SELECT id // 500 AS tid, id % 500 AS k, abs(arg_max(b, round)) AS b FROM medians GROUP BY id),
steep AS (SELECT tid, k, avg(b) OVER (PARTITION BY tid ORDER BY k ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) > {p.slope_threshold} AS steep FROM slopes),
tails AS (SELECT tid, max(k) FILTER (NOT steep) AS flat, bool_or(steep) FILTER (k = {499 - 2 * w}) AS ends_steep FROM steep WHERE k < {500 - 2 * w} GROUP BY tid),
marked AS (SELECT c.*, CASE WHEN NOT ends_steep THEN 0 WHEN flat IS NULL THEN {500 - 2 * w} ELSE {499 - 2 * w} - flat + {w - 1} END AS run FROM curves c JOIN tails USING (tid)),
inner_points AS (SELECT tid, m AS seq, row_number() OVER (PARTITION BY tid ORDER BY m) - 1 AS m, count(*) OVER (PARTITION BY tid) AS n, t, y FROM marked WHERE m < 500 - run AND t >= {p.filter_value}),
sized AS (SELECT *, CASE WHEN n < 30 THEN 1 WHEN n < 100 THEN 5 ELSE {p.dsw} END AS width FROM inner_points)""",
        *(_smoothed_sql(f"smooth_{k}", f"(SELECT * FROM sized WHERE width = {k})", str(k)) for k in (5, p.dsw)),
        f"""used AS (SELECT tid, m, n, t, y FROM sized WHERE width = 1 UNION ALL SELECT * FROM smooth_5 UNION ALL SELECT * FROM smooth_{p.dsw}),
spans_of AS (SELECT tid, any_value(n) AS n, min(t) AS t0, max(t) AS t1, max(t) FILTER (m = n - 2) AS t_prev FROM used GROUP BY tid HAVING any_value(n) > 1),
starts_of AS (SELECT *, t0 + {p.window_step} * (k - 1) AS s FROM (SELECT *, unnest(range(0, 1 + CASE WHEN t1 - t0 < {p.window_length} THEN 1 ELSE CAST(floor((t1 - t0 - {p.window_length}) / {p.window_step}) AS BIGINT) + 2 END)) AS k FROM spans_of)),
edges AS (SELECT f.tid, f.k, f.n, f.t1, f.t_prev, f.s, count(*) FILTER (u.t <= s) - 1 AS i, count(*) FILTER (u.t <= s + {p.window_length}) AS j, max(u.t) FILTER (u.t <= s + {p.window_length}) AS z FROM starts_of f JOIN used u ON u.tid = f.tid GROUP BY ALL),
ranges AS (SELECT tid, k, n, i, CASE WHEN CASE WHEN k > 0 THEN z WHEN t1 <= s + {p.window_length} THEN t1 ELSE t_prev END > t1 - {p.window_step} THEN n WHEN k > 0 THEN j ELSE 0 END AS j FROM edges),
centres AS (SELECT r.tid, r.k, count(*) AS c, avg(u.t) AS mt, avg(u.y) AS my FROM ranges r JOIN used u ON u.tid = r.tid AND u.m >= r.i AND u.m < r.j WHERE k > 0 GROUP BY r.tid, r.k),
reference(slope, value) AS (VALUES {slopes}),
far AS (SELECT r.tid, r.k, slope, sqrt(sum(pow(value * (u.t - mt) + my - u.y, 2))) / any_value(c) AS d FROM ranges r JOIN centres USING (tid, k) JOIN used u ON u.tid = r.tid AND u.m >= r.i AND u.m < r.j CROSS JOIN reference GROUP BY r.tid, r.k, slope),
point_distances AS (SELECT u.tid, u.m, f.slope, avg(f.d) AS d FROM used u JOIN ranges r ON r.tid = u.tid AND u.m >= r.i AND u.m < r.j JOIN far f ON f.tid = r.tid AND f.k = r.k + 1 GROUP BY u.tid, u.m, f.slope
    UNION ALL SELECT tid, m, slope, 1.0 FROM used CROSS JOIN reference WHERE n < 2),
detected AS (SELECT m.tid, m.m, {", ".join(f"max(d.d) FILTER (d.slope = {k}) AS {c}" for k, c in enumerate(regimes.DISTANCES))},
    CASE WHEN m.m >= 500 - m.run THEN 3 WHEN m.t < {p.filter_value} THEN 4 ELSE [0, 1, 1, 2, 2][1 + coalesce(arg_min(d.slope, (d.d, d.slope)), 0)] END AS regime
    FROM marked m LEFT JOIN inner_points i ON i.tid = m.tid AND i.seq = m.m LEFT JOIN point_distances d ON d.tid = i.tid AND d.m = i.m GROUP BY m.tid, m.m, m.run, m.t),
regimes AS (SELECT r.well_id AS group_id, r.transient_id, CAST(r.m AS INT) AS seq, r.t AS time, r.p AS pressure, r.d AS pressure_derivative, d.* EXCLUDE (tid, m) FROM detected d JOIN resampled r ON r.tid = d.tid AND r.m = d.m)""",
    )


@query(_with(f"""SELECT group_id, transient_id, seq, {_rs('time', 'pressure', 'pressure_derivative', n=4)}, regime, {_rs(*regimes.DISTANCES)} FROM regimes""", G.RATES_SQL, _SUPER, _DER, *_regimes_sql()))
def regimes_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regimes.classify(_family(spark, sf_dir), ["group_id", "transient_id"])
    return r.select("group_id", "transient_id", "seq", *_r("time", "pressure", "pressure_derivative", n=4), "regime", *_r(*regimes.DISTANCES))


@query()
def regimes_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.detect_features(_family(spark, sf_dir)).groupBy("group_id", "transient_id", "regime").agg(F.count(F.lit(1)).alias("n"), F.first("window_length").alias("window_length"), F.first("filter_value").alias("filter_value"))


@query(_with("""SELECT group_id, transient_id, count(DISTINCT regime) AS n_regimes, count(*) FILTER (regime = 0) AS n_radial FROM regimes GROUP BY group_id, transient_id""", G.RATES_SQL, _SUPER, _DER, *_regimes_sql()))
def regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.distinct_regimes(regimes.classify(_family(spark, sf_dir), ["group_id", "transient_id"]))


@query()
def regimes_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters found by the seeded search, and the distinct regimes that the model detects with them."""
    family = keep(_family(spark, sf_dir), "family")
    model = RegimeClassifier(search="bayes").fit(family)
    return patterns.distinct_regimes(model.transform(family)).join(model.found, ["group_id", "transient_id"])


@query()
def stable_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.get_stable_pattern(regimes.classify(_family(spark, sf_dir), ["group_id", "transient_id"]))


def _correlation_sql(family: str, group: str) -> str:
    """Windows and nested intervals of a family's members (tid, x, d: all positive), grouped by an expression."""
    levels = patterns.thresholds()
    nested = []
    for n, level in enumerate(levels):
        inside = f"JOIN level_{n - 1} p ON p.grp = c.grp AND c.k BETWEEN p.ka AND p.kb" if n else ""
        nested.append(f"""level_{n} AS (SELECT grp, arg_max(ka, (mean, -ka)) AS ka, arg_max(kb, (mean, -ka)) AS kb FROM (SELECT grp, min(k) AS ka, max(k) AS kb, avg(corr) AS mean FROM (
    SELECT c.*, c.k - row_number() OVER (PARTITION BY c.grp ORDER BY c.k) AS island FROM correlations c {inside} WHERE c.corr > {level}::DOUBLE) GROUP BY grp, island) GROUP BY grp)""")
    every = " UNION ALL ".join(f"SELECT *, {level}::DOUBLE AS threshold FROM level_{n}" for n, level in enumerate(levels))
    return f"""{family},
owned AS (SELECT {group} AS grp, tid, x, log10(x) AS lx, log10(d) AS y FROM family),
limits AS (SELECT grp, log10(max(a)) AS lo, log10(min(z)) AS hi FROM (SELECT grp, tid, min(x) AS a, max(x) AS z FROM owned GROUP BY grp, tid) GROUP BY grp HAVING count(*) > 1 AND max(a) < min(z)),
legs AS (SELECT *, lead(lx) OVER w AS lx1, lead(y) OVER w AS y1, lag(lx) OVER w IS NULL AS first FROM owned WINDOW w AS (PARTITION BY grp, tid ORDER BY lx)),
ticks AS (SELECT *, lo + g * (hi - lo) / 499 AS t FROM (SELECT *, unnest(range(500)) AS g FROM limits)),
shared AS MATERIALIZED (SELECT k.grp, tid, g, t, CASE WHEN lx1 IS NULL OR t < lx THEN y ELSE y + (y1 - y) / (lx1 - lx) * (t - lx) END AS y FROM ticks k JOIN legs l ON l.grp = k.grp AND (first OR t >= lx) AND (lx1 IS NULL OR t < lx1)),
opened AS (SELECT *, lo + 0.02::DOUBLE * (k - 1) AS s FROM (SELECT *, unnest(range(1, CAST(floor((hi - lo - 0.5) / 0.02) AS BIGINT) + 2)) AS k FROM limits WHERE hi - lo >= 0.5)),
counted AS (SELECT o.grp, o.k, o.hi, count(*) FILTER (t <= s) - 1 AS i, count(*) FILTER (t <= s + 0.5) AS j, max(t) FILTER (t <= s + 0.5) AS z FROM opened o JOIN ticks USING (grp) GROUP BY ALL),
frames AS (SELECT grp, k, i, CASE WHEN z > hi - 0.02 THEN 500 ELSE j END AS j FROM counted),
both_curves AS (SELECT a.grp, a.g, a.tid AS a, b.tid AS b, a.y AS ya, b.y AS yb FROM shared a JOIN shared b ON b.grp = a.grp AND b.g = a.g AND b.tid >= a.tid),
in_windows AS (SELECT w.grp, k, i, j, a, b, CASE WHEN min(ya) < max(ya) AND min(yb) < max(yb) THEN CASE WHEN a = b THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, abs(corr(ya, yb))) END END AS c
    FROM frames w JOIN both_curves p ON p.grp = w.grp AND p.g >= w.i AND p.g < w.j WHERE w.j - w.i > 1 GROUP BY w.grp, k, i, j, a, b),
correlations AS MATERIALIZED (SELECT grp, k, i, j, min(c) AS corr FROM in_windows GROUP BY ALL),
{", ".join(nested)},
slope_of AS (SELECT grp, avg(b) AS b FROM (SELECT s.grp, tid, regr_slope(s.y, s.t) AS b FROM level_0 l JOIN correlations f ON f.grp = l.grp AND f.k = l.ka JOIN correlations e ON e.grp = l.grp AND e.k = l.kb
    JOIN shared s ON s.grp = l.grp AND s.g >= f.i AND s.g < e.j - 1 GROUP BY s.grp, tid) GROUP BY grp),
intervals AS (SELECT l.grp AS group_id, threshold, pow(10.0, p.t) AS start, pow(10.0, q.t) AS "end",
    CASE WHEN abs(b) <= {patterns.FLAT} THEN 'Radial' WHEN b > 0 AND b < {patterns.STEEP} THEN 'Linear-up' WHEN b < 0 AND b > -{patterns.STEEP} THEN 'Linear-down' ELSE 'Not defined' END AS regime
    FROM ({every}) l JOIN correlations f ON f.grp = l.grp AND f.k = l.ka JOIN correlations e ON e.grp = l.grp AND e.k = l.kb
    JOIN ticks p ON p.grp = l.grp AND p.g = f.i JOIN ticks q ON q.grp = l.grp AND q.g = e.j - 1 LEFT JOIN slope_of s ON s.grp = l.grp)"""


_INTERVALS = f"""SELECT group_id, threshold, round(start, 6) AS start, round("end", 6) AS "end", regime FROM intervals"""
_FLOWING = (G.RATES_SQL, _SUPER, _DER, _correlation_sql(_regimes_sql()[0].split("stretches AS")[0].rstrip().rstrip(","), "well_id"))
_NEIGHBOURS = _correlation_sql("family AS (SELECT well_id, well_id AS tid, time_hr AS x, avg(pressure) AS d FROM bhp WHERE time_hr > 0 AND pressure > 0 GROUP BY well_id, time_hr)", "well_id // 2")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two wells each as a group: their pressures over the hours since their first sample."""
    x = G.bhp(spark, sf_dir).filter("time_hr > 0 and pressure > 0").groupBy(F.col("well_id").alias("transient_id"), F.col("time_hr").alias("time")).agg(F.avg("pressure").alias("derivative"))
    return x.withColumn("group_id", F.floor(F.col("transient_id") / 2))


@query(_with(_INTERVALS, *_FLOWING))
def correlation_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.correlation_analysis(_family(spark, sf_dir)).select("group_id", "threshold", *_r("start", "end"), "regime")


@query(_with(_INTERVALS, _NEIGHBOURS))
def correlation_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.correlation_analysis(_neighbours(spark, sf_dir)).select("group_id", "threshold", *_r("start", "end"), "regime")


@query(_with(f"SELECT grp AS group_id, CAST(k AS INT) AS \"window\", CAST(i AS INT) AS first, CAST(j - 1 AS INT) AS last, {_rs('corr')} FROM correlations WHERE corr IS NOT NULL", _NEIGHBOURS))
def window_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = patterns.window_correlations(patterns.shared_curves(_neighbours(spark, sf_dir))).filter("corr is not null")
    return x.select("group_id", "window", "first", "last", *_r("corr"))


_PAIRS = "daily AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events GROUP BY ALL)"


@query(f"""WITH {_PAIRS}, pairs AS (SELECT user_id % 10 AS grp, a.event_type AS a, b.event_type AS b, corr(a.v, b.v) AS c FROM (SELECT *, user_id * 1000 + date_diff('day', DATE '2020-01-01', day) AS at FROM daily) a
    JOIN (SELECT user_id * 1000 + date_diff('day', DATE '2020-01-01', day) AS at, event_type, v FROM daily) b ON a.at = b.at AND a.event_type < b.event_type GROUP BY ALL)
    SELECT grp, round(min(abs(c)), 6) AS corr FROM pairs WHERE NOT isnan(c) GROUP BY grp""")
def min_pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = G.events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.avg("value").alias("v"))
    x = daily.select((F.col("user_id") % 10).alias("grp"), F.lit(0).alias("w"), "event_type", (F.col("user_id") * 1000 + F.datediff("day", F.lit("2020-01-01").cast("date"))).alias("at"), "v")
    return patterns.min_pair_correlation(x, ["grp"], "w", "event_type", "at", "v").select("grp", *_r("corr"))
