"""Gauge tables: ordered samples of each well, with elapsed hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.numeric import hours_between


def gauge_table(df: DataFrame, value: str, name: str, well: str = "well_id", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """well_id, seq, ts, <name>, time_hr: samples without nulls, in time order, hours since the well's first one.

    The sign of rates is kept. One shuffle by well serves the numbering and the
    first timestamp, and whatever follows by well."""
    x = df.select(F.col(well).alias("well_id"), F.col(ts).alias("ts"), F.col(value).cast("double").alias(name), F.col(tie or ts).alias("__tie")).na.drop(subset=["ts", name])
    w = Window.partitionBy("well_id").orderBy("ts", "__tie")
    return x.select("well_id", F.row_number().over(w).alias("seq"), "ts", name, hours_between(F.first("ts").over(w), F.col("ts")).alias("time_hr"))


def bhp_table(df: DataFrame, value: str = "pressure", **names: str) -> DataFrame:
    return gauge_table(df, value, "pressure", **names)


def rate_table(df: DataFrame, value: str = "rate", **names: str) -> DataFrame:
    return gauge_table(df, value, "rate", **names)


def round_to_second(ts: F.Column) -> F.Column:
    """The nearest second, halves to the even one."""
    return F.timestamp_micros((F.bround(F.unix_micros(ts.cast("timestamp")) / 1e6) * 1e6).cast("long"))


def clip_common_range(bhp: DataFrame, rate: DataFrame, start_hr: float | None = None, end_hr: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables within the hours that both cover (closed), each starting again at hour 0."""
    span = lambda df, a: df.groupBy("well_id").agg(F.min("time_hr").alias(f"lo{a}"), F.max("time_hr").alias(f"hi{a}"))
    both = span(bhp, "1").join(span(rate, "2"), "well_id")
    lo, hi = F.greatest("lo1", "lo2"), F.least("hi1", "hi2")
    lo = F.greatest(lo, F.lit(float(start_hr))) if start_hr is not None else lo
    hi = F.least(hi, F.lit(float(end_hr))) if end_hr is not None else hi
    both = both.select("well_id", lo.alias("lo"), hi.alias("hi"))

    def clip(df: DataFrame) -> DataFrame:
        x = df.join(both, "well_id").filter(F.col("time_hr").between(F.col("lo"), F.col("hi")))
        w = Window.partitionBy("well_id")
        return x.withColumn("time_hr", F.col("time_hr") - F.min("time_hr").over(w)).select(df.columns)

    return clip(bhp), clip(rate)


def select_period(df: DataFrame, start_hr: float, end_hr: float) -> DataFrame:
    """Samples of a closed range of hours."""
    return df.filter(F.col("time_hr").between(start_hr, end_hr))
