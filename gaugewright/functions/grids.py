"""Curves on log-spaced grids, in the JVM: each sample hands its stretch of the curve to the grid points in it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.numeric import ratio


def log_ends(least: Column, most: Column, points: int) -> Column:
    """lo, hi (log10 of a grid's ends), first, last (the ends again), by the C library.

    A curve that jumps at an end has one value or another there by the last bit of the grid's end, and the JVM's
    powers and logarithms differ from those of other engines in that bit. One row a grid, so little Python."""

    @F.pandas_udf("lo double, hi double, first double, last double")
    def ends(a: pd.Series, z: pd.Series) -> pd.DataFrame:
        logs = [(math.log10(x), math.log10(y)) if x > 0 and y > 0 else (math.nan, math.nan) for x, y in zip(a, z, strict=True)]
        rows = [(lo, hi, math.pow(10.0, lo), math.pow(10.0, lo + (points - 1) * (hi - lo) / (points - 1))) for lo, hi in logs]
        return pd.DataFrame(rows, columns=["lo", "hi", "first", "last"])

    return ends(least, most)


def on_log_grid(frame: DataFrame, keys: list[str], x: str, ys: list[str], lo: Column, hi: Column, points: int, extend: bool = False, log_x: bool = False, ends: tuple[Column, Column] | None = None) -> DataFrame:
    """keys, g, grid and each of ys at `points` log-spaced x from lo to hi (both in log10, one value for each curve).

    Linear between samples, with log_x in log10 of x; beyond the ends the end value, or with extend the line
    of the end's two samples. Of equal x the last (by ys) begins the stretch
    behind and the first ends the one before. No sample meets a grid point
    that is not in its stretch, so the rows made are the grid's and two for each sample at most.
    A curve of one sample has its value everywhere, or with extend nothing. `ends`: the grid's ends, where they are known to the last bit."""
    w = Window.partitionBy(*keys).orderBy(x, *ys)
    nxt = {c: F.lead(c).over(w).alias(f"{c}_next") for c in [x, *ys]}
    s = frame.select(*keys, x, *ys, lo.alias("_lo"), hi.alias("_hi"), *(e.alias(f"_end{k}") for k, e in enumerate(ends or ())), *nxt.values(), (F.row_number().over(w) == 1).alias("_first"))
    s = s.withColumn("_last", F.col(f"{x}_next").isNull())
    if extend:  # the last sample begins no stretch; the one before reaches on
        s = s.withColumn("_last", F.coalesce(F.lead("_last").over(w), F.lit(False))).filter(F.col(f"{x}_next").isNotNull())
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    place = lambda c: ratio(F.log10(F.when(c > 0, c)) - F.col("_lo"), step)
    bound = lambda c, other: F.greatest(F.lit(0), F.least(F.lit(points - 1), F.coalesce(c, F.lit(other)))).cast("int")
    a = bound(F.when(~F.col("_first"), F.floor(place(F.col(x)))), 0)
    z = bound(F.when(~F.col("_last"), F.ceil(place(F.col(f"{x}_next")))), points - 1)
    s = s.filter(a <= z).withColumn("g", F.explode(F.sequence(a, z))).withColumn("grid", F.pow(F.lit(10.0), F.col("_lo") + F.col("g") * (F.col("_hi") - F.col("_lo")) / (points - 1)))
    if ends:
        s = s.withColumn("grid", F.when((F.col("g") == 0) | (F.col("_lo") == F.col("_hi")), F.col("_end0")).when(F.col("g") == points - 1, F.col("_end1")).otherwise(F.col("grid")))
    s = s.filter((F.col("_first") | (F.col("grid") >= F.col(x))) & (F.col("_last") | (F.col("grid") < F.col(f"{x}_next"))))

    def value(c: str) -> Column:
        at, end, here = F.col(x), F.col(f"{x}_next"), F.col("grid")
        if log_x:
            at, end, here = F.log10(at), F.log10(end), F.col("_lo") + F.col("g") * step
        line = F.col(c) + ratio(F.col(f"{c}_next") - F.col(c), end - at) * (here - at)
        return (line if extend else F.when(F.col("_last") | (F.col("grid") < F.col(x)), F.col(c)).otherwise(line)).alias(c)

    return s.select(*keys, "g", "grid", *map(value, ys))
