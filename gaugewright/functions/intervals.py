"""Samples in intervals without comparing every sample of a well with every interval of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "_bucket"


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp as whole microseconds, whether it has a time zone or not."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(F.col(name))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))


def interval_join(samples: DataFrame, intervals: DataFrame, on: list[str], at: Column, start: Column, end: Column, condition: Column) -> DataFrame:
    """Pairs of a sample and an interval of the same `on` that meet the condition, which must imply start <= at <= end.

    Time is cut into buckets as wide as the mean interval, and the bucket joins the
    equality keys: a sample lies in one, an interval in each that it touches, which
    is two rows an interval on average at most. So samples meet only the intervals near
    them, and one long history spreads over as many tasks as it has buckets. The
    width is a scalar of the intervals; intervals with a null or reversed end match nothing."""
    length = F.greatest(end - start, F.lit(0)).cast("double")
    mean = intervals.agg(F.avg(length).alias("w")).select(F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).alias("w"))
    spans = intervals.filter(start <= end).withColumn("_width", mean.scalar())
    spans = spans.withColumn(BUCKET, F.explode(F.sequence(F.floor(start / F.col("_width")), F.floor(end / F.col("_width"))))).drop("_width")
    placed = samples.withColumn("_width", mean.scalar()).withColumn(BUCKET, F.floor(at / F.col("_width"))).drop("_width")
    return placed.join(spans, [*on, BUCKET]).filter(condition).drop(BUCKET)
