"""The driver tables as gauge data: a user is a well, event values are pressures, values of views are rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.numeric import hours_between
from gaugewright.operators import ingest
from gaugewright.operators.loglog import with_ids

HOURS = 48  # of the fixed grid that stands for breakpoints where a query is about one operator


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bhp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.bhp_table(events(spark, sf_dir), "value", well="user_id", tie="event_id")


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rate_table(events(spark, sf_dir).filter("event_type = 'view'"), "value", well="user_id", tie="event_id")


def grid(samples: DataFrame) -> DataFrame:
    """well_id, ts, time_hr, label: a breakpoint every HOURS from the first sample on, and the last sample."""
    ends = samples.groupBy("well_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    steps = F.sequence(F.lit(0), F.floor(hours_between(F.col("a"), F.col("z")) / HOURS).cast("int"))
    at = F.transform(steps, lambda k: F.timestamp_add("HOUR", k * HOURS, F.col("a")))
    x = ends.select("well_id", "a", F.explode(F.array_distinct(F.concat(at, F.array("z")))).alias("ts"))
    return x.select("well_id", "ts", hours_between(F.col("a"), F.col("ts")).alias("time_hr"), F.lit("multibp").alias("label"))


def grid_transients(samples: DataFrame) -> DataFrame:
    """The grid's intervals, every third one (the second, the fifth ...) a shut-in."""
    from pyspark.sql import Window

    w = Window.partitionBy("well_id").orderBy("ts")
    x = grid(samples).withColumn("end_hr", F.lead("time_hr").over(w)).withColumn("end_ts", F.lead("ts").over(w)).withColumn("k", F.row_number().over(w)).filter("end_ts is not null")
    x = x.select("well_id", F.col("time_hr").alias("start_hr"), "end_hr", (F.col("end_hr") - F.col("time_hr")).alias("duration_hr"), F.col("ts").alias("start_ts"), "end_ts", F.when(F.col("k") % 3 == 2, "shutin").otherwise("flowing").alias("status"))
    return with_ids(x)


#: The same tables in DuckDB's SQL.
SQL = f"""
bhp AS (SELECT user_id AS well_id, row_number() OVER w AS seq, ts, value AS pressure, (epoch_us(ts) - epoch_us(first(ts) OVER w)) / 3.6e9::DOUBLE AS time_hr
        FROM events WHERE ts IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
rate AS (SELECT user_id AS well_id, row_number() OVER w AS seq, ts, value AS rate, (epoch_us(ts) - epoch_us(first(ts) OVER w)) / 3.6e9::DOUBLE AS time_hr
        FROM events WHERE event_type = 'view' AND ts IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ends AS (SELECT well_id, min(ts) AS a, max(ts) AS z FROM bhp GROUP BY well_id),
grid AS (SELECT DISTINCT well_id, ts, (epoch_us(ts) - epoch_us(a)) / 3.6e9::DOUBLE AS time_hr FROM (
    SELECT well_id, a, a + to_hours(CAST({HOURS} * k AS BIGINT)) AS ts FROM (SELECT *, unnest(range(0, 1 + CAST(floor((epoch_us(z) - epoch_us(a)) / 3.6e9 / {HOURS}) AS BIGINT))) AS k FROM ends)
    UNION ALL SELECT well_id, a, z FROM ends)),
tiles AS (SELECT * FROM (SELECT well_id, ts AS start_ts, time_hr AS start_hr, lead(ts) OVER w AS end_ts, lead(time_hr) OVER w AS end_hr, row_number() OVER w AS seq
          FROM grid WINDOW w AS (PARTITION BY well_id ORDER BY ts)) WHERE end_ts IS NOT NULL),
transients AS (SELECT well_id, seq AS transient_id, start_hr, end_hr, end_hr - start_hr AS duration_hr, start_ts, end_ts, CASE WHEN seq % 3 = 2 THEN 'shutin' ELSE 'flowing' END AS status FROM tiles)"""

#: Weighted rates on the grid.
RATES_SQL = """
inside AS (SELECT t.well_id, t.seq, t.start_ts, t.end_ts, r.ts, r.rate, r.seq AS k FROM tiles t JOIN rate r ON r.well_id = t.well_id AND r.ts >= t.start_ts AND r.ts < t.end_ts),
gaps AS (SELECT *, coalesce((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER o))) / 2, (epoch_us(ts) - epoch_us(start_ts)) / 1e6)
              + coalesce((epoch(date_trunc('second', lead(ts) OVER o)) - epoch(date_trunc('second', ts))) / 2, (epoch_us(end_ts) - epoch_us(ts)) / 1e6) AS dt
         FROM inside WINDOW o AS (PARTITION BY well_id, seq ORDER BY ts, k)),
means AS (SELECT well_id, seq, sum(rate * dt) / nullif(sum(dt), 0) AS mean FROM gaps GROUP BY well_id, seq),
low AS (SELECT well_id, 0.1 * quantile_cont(abs(rate), 0.9) AS low FROM rate GROUP BY well_id),
rates AS (SELECT t.well_id, t.seq, t.start_ts, t.end_ts, t.start_hr, t.end_hr, CASE WHEN abs(coalesce(mean, 0)) < low THEN 0 ELSE coalesce(mean, 0) END AS rate
          FROM tiles t LEFT JOIN means m ON m.well_id = t.well_id AND m.seq = t.seq LEFT JOIN low l ON l.well_id = t.well_id)"""
