"""The error of a rebuilt rate against the measured one, as a share of the volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.numeric import ratio
from gaugewright.functions.staging import united


def rare_inputs(rate: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """well_id, ts, q_rebuilt, q, dt (days), volume, error: both rates on all timestamps, filled forward, with running volume and running error.

    rate: well_id, seq, ts, rate (the first of equal timestamps counts). rebuilt:
    weighted rates, held to the last sample."""
    q = rate.groupBy("well_id", "ts").agg(F.min_by("rate", "seq").alias("q"))
    end = q.groupBy("well_id").agg(F.max("ts").alias("ts"))
    last = rebuilt.groupBy("well_id").agg(F.max_by("rate", "start_ts").alias("q_rebuilt"))
    r = rebuilt.select("well_id", F.col("start_ts").alias("ts"), F.col("rate").alias("q_rebuilt"), F.lit(0).alias("k"))
    r = united(r, end.join(last, "well_id").select("well_id", "ts", "q_rebuilt", F.lit(1).alias("k"))).groupBy("well_id", "ts").agg(F.min_by("q_rebuilt", "k").alias("q_rebuilt"))
    w = Window.partitionBy("well_id").orderBy("ts")
    fill = w.rowsBetween(Window.unboundedPreceding, 0)
    x = r.join(q, ["well_id", "ts"], "full_outer")
    x = x.select("well_id", "ts", F.last("q_rebuilt", True).over(fill).alias("q_rebuilt"), F.last("q", True).over(fill).alias("q")).na.drop()
    x = x.withColumn("dt", F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 8.64e10)
    area = lambda c: F.coalesce(F.sum(c * F.col("dt")).over(fill), F.lit(0.0))
    return x.withColumn("volume", area(F.col("q"))).withColumn("error", area(F.abs(F.col("q_rebuilt") - F.col("q"))))


def rare(inputs: DataFrame, t1: F.Column | None = None, t2: F.Column | None = None, hist_periods: float = 2, max_rare: float | None = 1) -> DataFrame:
    """well_id, rare: error over volume from hist_periods spans before t1 to t2 (closed; by default the whole history); null without volume."""
    ends = inputs.groupBy("well_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    a, z = (F.col("a") if t1 is None else t1), (F.col("z") if t2 is None else t2)
    ends = ends.select("well_id", a.alias("t1"), z.alias("t2"))
    span = F.timestamp_diff("MICROSECOND", F.col("t1"), F.col("t2"))
    ends = ends.withColumn("t0", F.timestamp_add("MICROSECOND", F.round(-hist_periods * span).cast("long"), F.col("t1")))
    x = inputs.join(ends, "well_id").filter(F.col("ts").between(F.col("t0"), F.col("t2"))).groupBy("well_id").agg(*[f(c, "ts").alias(f"{c}{n}") for c in ("volume", "error") for n, f in ((0, F.min_by), (1, F.max_by))])
    value = ratio(F.col("error1") - F.col("error0"), F.abs(F.col("volume1") - F.col("volume0")))
    if max_rare is not None:
        value = F.when(value.isNotNull(), F.least(value, F.lit(float(max_rare))))
    return x.select("well_id", value.alias("rare"))
