"""From pressure and rate histories to transients, breakpoints and a rebuilt rate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.intervals import interval_join
from gaugewright.functions.numeric import ratio
from gaugewright.functions.staging import keep, united
from gaugewright.operators.lmir import Lmir, lmir
from gaugewright.operators.tpmr import TRANSIENT, tpmr

NEAR_HOURS = 2.0
ZERO_RATE_SHARE = 0.1


class Workflow(NamedTuple):
    shutin: DataFrame
    flowing: DataFrame
    shutin_breakpoints: DataFrame
    flow_breakpoints: DataFrame
    breakpoints: DataFrame
    weighted_rates: DataFrame
    params: dict[str, float]


def injection_periods(shutins: DataFrame, bhp: DataFrame) -> DataFrame:
    """What lies between a well's shut-ins, its first and its last sample, without empty periods."""
    w = Window.partitionBy("well_id").orderBy("start_hr", "end_hr")
    row = F.struct("time_hr", "ts")
    ends = bhp.groupBy("well_id").agg(F.min_by(row, "seq").alias("a"), F.max_by(row, "seq").alias("z"))
    x = shutins.join(ends, "well_id")
    before = x.select("well_id", F.coalesce(F.lag("end_hr").over(w), F.col("a.time_hr")).alias("start_hr"), F.col("start_hr").alias("end_hr"), F.coalesce(F.lag("end_ts").over(w), F.col("a.ts")).alias("start_ts"), F.col("start_ts").alias("end_ts"))
    after = x.withColumn("next", F.lead("start_hr").over(w)).filter("next is null").select("well_id", F.col("end_hr").alias("start_hr"), F.col("z.time_hr").alias("end_hr"), F.col("end_ts").alias("start_ts"), F.col("z.ts").alias("end_ts"))
    both = united(before, after).withColumn("duration_hr", F.col("end_hr") - F.col("start_hr")).filter("duration_hr <> 0").withColumn("status", F.lit("flowing"))
    return both.select(*TRANSIENT)


def all_flowing(periods: DataFrame, bhp: DataFrame, order: int = 100, start_filter_hours: float = 5, end_filter_hours: float = 5) -> Lmir:
    """Flowing transients within each period (closed on both sides)."""
    p = periods.withColumn("period", F.row_number().over(Window.partitionBy("well_id").orderBy("start_hr", "end_hr"))).select("well_id", "period", "start_hr", "end_hr")
    inside = F.col("time_hr").between(F.col("start_hr"), F.col("end_hr"))
    within = interval_join(bhp, p, ["well_id"], F.col("time_hr"), F.col("start_hr"), F.col("end_hr"), inside).drop("start_hr", "end_hr")
    return lmir(within, order, start_filter_hours, end_filter_hours, ["well_id", "period"])


def filter_flow(points: DataFrame, flowing: DataFrame, interval: float) -> tuple[DataFrame, DataFrame]:
    """Flowing transients of at least `interval` hours; breakpoints strictly farther than that from a neighbour in the well's whole sequence."""
    order = ["period", "time_hr"] if "period" in points.columns else ["time_hr"]
    w = Window.partitionBy("well_id").orderBy(*order)
    gap = lambda f: F.abs(f("time_hr").over(w) - F.col("time_hr")) > interval
    kept = points.withColumn("near", F.coalesce(gap(F.lag), F.lit(False)) | F.coalesce(gap(F.lead), F.lit(False))).filter("near").drop("near", "period").dropDuplicates()
    return kept, flowing.filter(F.col("duration_hr") >= interval)


def all_breakpoints(shutins: DataFrame, minima: DataFrame, bhp: DataFrame) -> DataFrame:
    """well_id, time_hr, ts, label: ends of the history, ends of every shut-in, and the minima, one for each timestamp in that order."""
    row = F.struct("time_hr", "ts")
    ends = bhp.groupBy("well_id").agg(F.min_by(row, "seq").alias("a"), F.max_by(row, "seq").alias("z"))
    edge = ends.select("well_id", F.explode(F.array(F.struct("a.time_hr", "a.ts", F.lit("start").alias("label"), F.lit(0).alias("rank")), F.struct("z.time_hr", "z.ts", F.lit("end").alias("label"), F.lit(0).alias("rank")))).alias("e")).select("well_id", "e.*")
    shut = shutins.select("well_id", F.explode(F.array(F.struct(F.col("start_hr").alias("time_hr"), F.col("start_ts").alias("ts")), F.struct(F.col("end_hr").alias("time_hr"), F.col("end_ts").alias("ts")))).alias("e")).select("well_id", "e.*", F.lit("shutin").alias("label"), F.lit(1).alias("rank"))
    multi = minima.select("well_id", "time_hr", "ts", F.lit("multibp").alias("label"), F.lit(2).alias("rank"))
    every = united(edge, shut, multi)
    once = Window.partitionBy("well_id", "ts").orderBy("rank", F.desc("label"))
    return every.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n", "rank")


def flag_breakpoints(points: DataFrame, transients: DataFrame, hours: float = NEAR_HOURS) -> DataFrame:
    """points with removed: whether within `hours` before the start of a transient that starts after `hours`.

    The next start decides, which one pass by well over points and starts finds, from the last time back: no join."""
    starts = transients.filter(F.col("start_hr") > hours).select("well_id", F.col("start_hr").alias("time_hr"), F.col("start_hr").alias("next"))
    both = united(points.withColumn("next", F.lit(None).cast("double")), starts).withColumn("mark", F.col("next").isNotNull())
    later = Window.partitionBy("well_id").orderBy(F.desc("time_hr"), "mark").rowsBetween(Window.unboundedPreceding, 0)
    near = F.col("well_id").isNotNull() & (F.col("time_hr") >= F.min("next").over(later) - hours)
    return both.withColumn("removed", F.coalesce(near, F.lit(False))).filter(~F.col("mark")).select(*points.columns, "removed")


def filter_breakpoints(points: DataFrame, transients: DataFrame, hours: float = NEAR_HOURS) -> tuple[DataFrame, DataFrame]:
    """Breakpoints not within `hours` before the start of a transient that starts after `hours`; and those removed."""
    flagged = flag_breakpoints(points, transients, hours)
    return flagged.filter(~F.col("removed")).drop("removed"), flagged.filter("removed").drop("removed")


def weighted_rates(rate: DataFrame, points: DataFrame, shutin_threshold: float | None = None, zero_share: float = ZERO_RATE_SHARE) -> DataFrame:
    """well_id, seq, start_ts, end_ts, start_hr, end_hr, rate: the time-weighted mean rate between successive breakpoints.

    A sample stands for the time halfway to its neighbours in the interval (gaps
    between samples in whole seconds), the first and last reach to the ends.
    Empty intervals, and means below the threshold (by default a share of the
    90th percentile of absolute rates; 0 stands for the default), are 0. Samples
    and breakpoints are united and numbered in one pass by well: no range join."""
    b = points.select("well_id", "ts", "time_hr")
    w = Window.partitionBy("well_id").orderBy("ts")
    tiles = b.withColumn("seg", F.row_number().over(w)).withColumn("end_ts", F.lead("ts").over(w)).withColumn("end_hr", F.lead("time_hr").over(w))
    # a breakpoint brings its whole interval along, so that samples take number and ends from one row, without a join
    marks = tiles.select("well_id", "ts", F.lit(None).cast("double").alias("rate"), F.lit(1).alias("mark"), F.lit(0).alias("k"), F.struct("seg", F.col("ts").alias("start_ts"), "end_ts").alias("tile"))
    both = united(rate.select("well_id", "ts", "rate", F.lit(0).alias("mark"), F.col("seq").alias("k")), marks)
    tiles = tiles.filter("end_ts is not null")
    run = Window.partitionBy("well_id").orderBy("ts", F.desc("mark"), "k").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("tile", F.last("tile", ignorenulls=True).over(run)).filter("mark = 0 and tile.end_ts is not null").select("well_id", "ts", "rate", "k", "tile.*")
    o = Window.partitionBy("well_id", "seg").orderBy("ts", "k")
    whole = lambda c: F.date_trunc("second", c)
    seconds = lambda x, y: F.timestamp_diff("MICROSECOND", x, y) / 1e6
    before, after = F.lag("ts").over(o), F.lead("ts").over(o)
    dt = F.coalesce(seconds(whole(before), whole(F.col("ts"))) / 2, seconds(F.col("start_ts"), F.col("ts"))) + F.coalesce(seconds(whole(F.col("ts")), whole(after)) / 2, seconds(F.col("ts"), F.col("end_ts")))
    mean = inside.withColumn("dt", dt).groupBy("well_id", "seg").agg(ratio(F.sum(F.col("rate") * F.col("dt")), F.sum("dt")).alias("mean"))
    if shutin_threshold:
        low = rate.select("well_id").distinct().withColumn("low", F.lit(float(shutin_threshold)))
    else:
        low = rate.groupBy("well_id").agg((zero_share * F.percentile(F.abs("rate"), F.lit(0.9))).alias("low"))
    x = tiles.join(mean, ["well_id", "seg"], "left").join(low, "well_id", "left")
    value = F.coalesce("mean", F.lit(0.0))
    return x.select("well_id", F.col("seg").alias("seq"), F.col("ts").alias("start_ts"), "end_ts", F.col("time_hr").alias("start_hr"), "end_hr", F.when(F.abs(value) < F.col("low"), F.lit(0.0)).otherwise(value).alias("rate"))


def _checked(shutin: DataFrame | None, rates: DataFrame | None, flowing: DataFrame | None) -> None:
    if shutin is None or rates is None or flowing is None:
        raise ValueError("shut-in transients, weighted rates and flowing transients are all needed")
    for df, names in ((shutin, ("start_ts", "status")), (flowing, ("start_ts", "status")), (rates, ("start_ts", "rate"))):
        for name in names:
            if name not in df.columns:
                raise KeyError(name)


def _moved(source: DataFrame, rates: DataFrame, target: DataFrame, wrong: F.Column, status: str) -> tuple[DataFrame, DataFrame]:
    """source without the transients whose rate row is wrong, and target with them under another status."""
    bad = rates.filter(wrong).select("well_id", "start_ts").distinct()
    on = ["well_id", "start_ts"]
    stay, go = source.join(bad, on, "left_anti"), source.join(bad, on, "left_semi").withColumn("status", F.lit(status))
    return stay.select(source.columns), united(target, go.select(source.columns))


def validate_shutin_rate(shutin: DataFrame, rates: DataFrame, flowing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shut-ins at whose start the rebuilt rate is not 0 are flowing."""
    _checked(shutin, rates, flowing)
    return _moved(shutin, rates, flowing, F.col("rate") != 0, "flowing")


def validate_flowing_rate(shutin: DataFrame, rates: DataFrame, flowing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flowing transients at whose start the rebuilt rate is 0 are shut-ins."""
    _checked(shutin, rates, flowing)
    stay, moved = _moved(flowing, rates, shutin, F.col("rate") == 0, "shutin")
    return moved, stay


def step_rate(bhp: DataFrame, rate: DataFrame, interval_injection: float, order: int = 100, start_filter_hours: float = 5, end_filter_hours: float = 5, shutin_threshold: float | None = None) -> Workflow:
    """A history without shut-ins: its flowing transients are found over its whole length."""
    found = lmir(bhp, order, start_filter_hours, end_filter_hours)
    points, flowing = filter_flow(found.flow_breakpoints, found.flowing, interval_injection)
    marks = found.flow_breakpoints.select("well_id", "time_hr", "ts", F.lit("multibp").alias("label"))
    none = flowing.filter(F.lit(False))
    return Workflow(none.select(*TRANSIENT), flowing.select(*TRANSIENT), marks.filter(F.lit(False)), points, marks, weighted_rates(rate, marks, shutin_threshold), found.params)


def ti_workflow(bhp: DataFrame, rate: DataFrame, prominence: float | None = None, interval_shutin: float = 50, interval_injection: float = 50, shutin_threshold: float | None = None, order: int = 100, start_filter_hours: float = 5, end_filter_hours: float = 5, validate_shutin_by_rate: bool = True, validate_flowing_by_rate: bool = True) -> Workflow:
    """Transients of all wells: wells with a long shut-in by shut-ins, the others as step-rate tests, as two plans over one table.

    The lengths of shut-ins decide by well, so a flag is joined back, not collected.
    Tables that several steps read are written once, so that no step repeats another's work."""
    bhp, rate = keep(bhp, "bhp"), keep(rate, "rate")
    t = tpmr(bhp, prominence, interval_shutin)
    t = t._replace(transients=keep(t.transients, "shutins"))
    t = t._replace(transients_interval=t.transients.filter(F.col("duration_hr") > interval_shutin))
    wells = t.transients_interval.select("well_id").distinct()
    with_shutins, without = bhp.join(wells, "well_id", "left_semi"), bhp.join(wells, "well_id", "left_anti")
    shutin = t.transients_interval
    every = t.transients.join(wells, "well_id", "left_semi")
    found = all_flowing(injection_periods(every, with_shutins), with_shutins, order, start_filter_hours, end_filter_hours)
    flow_points, flowing = filter_flow(found.flow_breakpoints, found.flowing, interval_injection)
    flowing = keep(flowing.select(*TRANSIENT), "flowing")
    points = all_breakpoints(every, found.minima, with_shutins)
    points = keep(filter_breakpoints(points, united(shutin, flowing))[0], "breakpoints")
    rates = keep(weighted_rates(rate.join(wells, "well_id", "left_semi"), points, shutin_threshold), "rates")
    if validate_shutin_by_rate:
        shutin, flowing = validate_shutin_rate(shutin, rates, flowing)
    if validate_flowing_by_rate:
        shutin, flowing = validate_flowing_rate(shutin, rates, flowing)
    s = step_rate(without, rate.join(wells, "well_id", "left_anti"), interval_injection, order, start_filter_hours, end_filter_hours, shutin_threshold)
    cols = ["well_id", "seq", "ts", "pressure", "time_hr", "status"]
    return Workflow(shutin, united(flowing, s.flowing), t.breakpoints_interval, united(flow_points.select(*cols), s.flow_breakpoints.select(*cols)), united(points, s.breakpoints), united(rates, s.weighted_rates), found.params)
