"""Flowing transients from pressure: local minima of the history turned to its own trend."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.numeric import ratio
from gaugewright.functions.staging import united


class Lmir(NamedTuple):
    flowing: DataFrame
    flow_breakpoints: DataFrame  # with status
    minima: DataFrame
    params: dict[str, float]


def rotate(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with rotated: pressure turned by the angle of the line from the first to the last sample (raw units)."""
    w = Window.partitionBy(*keys)
    first, last = F.min(F.struct("seq", "time_hr", "pressure")).over(w), F.max(F.struct("seq", "time_hr", "pressure")).over(w)
    x = df.withColumn("a", first).withColumn("z", last)
    angle = F.atan(ratio(F.col("z.pressure") - F.col("a.pressure"), F.col("z.time_hr") - F.col("a.time_hr")))
    return x.withColumn("angle", angle).withColumn("rotated", F.round(-F.sin("angle") * F.col("time_hr") + F.cos("angle") * F.col("pressure"), 9)).drop("a", "z", "angle")


def local_minima(df: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Samples strictly below their `order` neighbours on each side after the rotation, and the highest sample; one for each time."""
    w = Window.partitionBy(*keys).orderBy("seq")
    x = rotate(df, keys)
    low = (F.col("rotated") < F.min("rotated").over(w.rowsBetween(-order, -1))) & (F.col("rotated") < F.min("rotated").over(w.rowsBetween(1, order)))
    top = F.max(F.struct(F.col("pressure"), F.negate("seq").alias("s"))).over(Window.partitionBy(*keys))
    x = x.withColumn("low", F.coalesce(low, F.lit(False))).withColumn("top", F.negate(top["s"]) == F.col("seq")).filter("low or top")
    once = Window.partitionBy(*keys, "time_hr").orderBy(F.desc("low"), "seq")
    return x.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n", "low", "top", "rotated")


def filter_minima(minima: DataFrame, start_hours: float, end_hours: float) -> DataFrame:
    """Minima strictly later than their group's first time (lo) by start_hours and earlier than its last (hi) by end_hours."""
    return minima.filter((F.col("time_hr") > F.col("lo") + start_hours) & (F.col("time_hr") < F.col("hi") - end_hours)).drop("lo", "hi")


def split_flow(points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Successive breakpoints as flowing transients, and the breakpoints with status (the last of each group: shutin)."""
    w = Window.partitionBy(*keys).orderBy("time_hr", "seq")
    x = points.withColumn("end_hr", F.lead("time_hr").over(w)).withColumn("end_ts", F.lead("ts").over(w))
    flowing = x.filter("end_hr is not null").select(*keys, F.col("time_hr").alias("start_hr"), "end_hr", (F.col("end_hr") - F.col("time_hr")).alias("duration_hr"), F.col("ts").alias("start_ts"), "end_ts", F.lit("flowing").alias("status"))
    once = Window.partitionBy(*keys, "ts").orderBy("time_hr", "seq")
    marked = x.withColumn("status", F.when(F.col("end_hr").isNull(), "shutin").otherwise("flowing")).drop("end_hr", "end_ts").withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")
    return flowing, marked


def lmir(df: DataFrame, order: int = 100, start_filter_hours: float = 5, end_filter_hours: float = 5, keys: list[str] | None = None) -> Lmir:
    """Flowing transients of each group of keys (a well, or a well's period)."""
    keys = keys or ["well_id"]
    w = Window.partitionBy(*keys)
    spanned = df.withColumn("lo", F.min("time_hr").over(w)).withColumn("hi", F.max("time_hr").over(w))  # in the order of the windows that follow: no join
    minima = filter_minima(local_minima(spanned, keys, order), start_filter_hours, end_filter_hours)
    row = F.struct(*[c for c in df.columns if c not in keys])
    ends = df.groupBy(*keys).agg(F.min_by(row, "seq").alias("a"), F.max_by(row, "seq").alias("z"))
    points = united(minima, ends.select(*keys, "a.*"), ends.select(*keys, "z.*"))
    flowing, marked = split_flow(points, keys)
    return Lmir(flowing, marked, minima, {"order": order, "start_filter_hours": start_filter_hours, "end_filter_hours": end_filter_hours})
