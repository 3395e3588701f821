"""How far a transient can be trusted: features of its pressure and rate, and scores from 0 to 1."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.intervals import interval_join, micros
from gaugewright.functions.numeric import add_hours, ratio

KEYS = ["well_id", "transient_id"]
SCALES = {"full": 1.0, "half": 0.5, "quarter": 0.25}
PRESSURE = ("monotonicity_ratio", "local_deviation", "trend_efficiency")
RATE = ("rate_std", "rate_td_std", "rate_iqr")
EXACT = 50  # differences up to which the signed-rank distribution is exact
LEVEL = 0.05
NORMAL = 1.959963984540054  # two-sided standard score of that level


def _within(samples: DataFrame, spans: DataFrame, start: str, end: str) -> DataFrame:
    """Samples of each span, half-open."""
    inside = (F.col("ts") >= F.col(start)) & (F.col("ts") < F.col(end))
    return interval_join(samples, spans, ["well_id"], micros(samples, "ts"), micros(spans, start), micros(spans, end), inside)


def _around(transients: DataFrame, rate: DataFrame) -> DataFrame:
    """Rates as long before and after each transient's start as it lasts, half-open."""
    start, width = F.col("start_ts"), F.col("duration_hr")
    t = transients.select(*KEYS, "start_ts", "duration_hr", add_hours(start, -width).alias("from_ts"), add_hours(start, width).alias("to_ts"))
    return _within(rate, t, "from_ts", "to_ts")


def pressure_features(transients: DataFrame, pressure: DataFrame, window: int = 12) -> DataFrame:
    """Monotonicity, local deviation and trend efficiency of each transient (half-open); null below two samples.

    transients: well_id, transient_id, start_ts, end_ts, duration_hr. pressure: well_id, seq, ts, pressure."""
    t = transients.select(*KEYS, "start_ts", "end_ts")
    x = _within(pressure, t, "start_ts", "end_ts")
    w = Window.partitionBy(*KEYS).orderBy("ts", "seq")
    p = F.col("pressure")
    x = x.withColumn("d", p - F.lag(p).over(w)).withColumn("res", F.abs(p - F.avg(p).over(w.rowsBetween(1 - window, 0))))
    x = x.withColumn("turn", (F.signum("d") != F.signum(F.lag("d").over(w))).cast("int"))
    at = F.struct("ts", "seq")
    a = x.groupBy(*KEYS).agg(F.count(p).alias("n"), F.sum("turn").alias("turns"), F.sum(F.abs("d")).alias("path"), F.max_by(p, at).alias("z"), F.min_by(p, at).alias("a"), F.median("res").alias("mid"), F.avg("res").alias("mean_res"))
    mad = x.select(*KEYS, "res").join(a.select(*KEYS, "mid"), KEYS).groupBy(*KEYS).agg(F.median(F.abs(F.col("res") - F.col("mid"))).alias("mad"))
    a = a.join(mad, KEYS)
    enough = F.col("n") >= 2
    mean_z = F.col("mean_res") / F.greatest(F.col("mad") * 1.4826, F.lit(1e-6))
    out = a.select(*KEYS, F.when(enough, 1 - F.coalesce("turns", F.lit(0)) / F.greatest(F.col("n") - 2, F.lit(1))).alias("monotonicity_ratio"),
                   F.when(enough, 1 / (1 + F.exp(0.2 * (mean_z - 50)))).alias("local_deviation"),
                   F.when(enough, F.coalesce(ratio(F.abs(F.col("z") - F.col("a")), F.col("path")), F.lit(1.0))).alias("trend_efficiency"))
    return transients.select(*KEYS).join(out, KEYS, "left")


def rate_features(transients: DataFrame, rate: DataFrame) -> DataFrame:
    """Sample deviation in the transient and in as long a window before it, and the spread from the 10th to the 90th percentile."""
    t = transients.select(*KEYS, "start_ts", "end_ts", add_hours(F.col("start_ts"), -F.col("duration_hr")).alias("from_ts"))
    x = _within(rate, t, "from_ts", "end_ts")
    during, before = F.col("ts") >= F.col("start_ts"), F.col("ts") < F.col("start_ts")
    q = F.percentile(F.when(during, F.col("rate")), F.array(F.lit(0.9), F.lit(0.1)))
    a = x.groupBy(*KEYS).agg(F.stddev_samp(F.when(during, F.col("rate"))).alias("rate_std"), F.stddev_samp(F.when(before, F.col("rate"))).alias("rate_td_std"), q.alias("q"))
    return transients.select(*KEYS).join(a.select(*KEYS, "rate_std", "rate_td_std", (F.col("q")[0] - F.col("q")[1]).alias("rate_iqr")), KEYS, "left")


def rate_change(transients: DataFrame, rate: DataFrame) -> DataFrame:
    """Signal to noise of the rate change at the start, over windows of three lengths; null with two samples or fewer on a side."""
    x = _around(transients, rate)
    aggs: list[Column] = []
    for name, s in SCALES.items():
        sides = {"b": (F.col("ts") < F.col("start_ts")) & (F.col("ts") >= add_hours(F.col("start_ts"), -s * F.col("duration_hr"))), "a": (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < add_hours(F.col("start_ts"), s * F.col("duration_hr")))}
        for side, cond in sides.items():
            v = F.when(cond, F.col("rate"))
            aggs += [F.count(v).alias(f"n_{side}_{name}"), F.avg(v).alias(f"m_{side}_{name}"), F.stddev_samp(v).alias(f"s_{side}_{name}")]
    a = x.groupBy(*KEYS).agg(*aggs)
    c = F.col
    snr = [F.when((c(f"n_b_{k}") > 2) & (c(f"n_a_{k}") > 2), F.abs(c(f"m_a_{k}") - c(f"m_b_{k}")) / F.greatest(c(f"s_b_{k}"), c(f"s_a_{k}"), F.lit(1e-6))).alias(f"rate_change_snr_{k}") for k in SCALES]
    return transients.select(*KEYS).join(a.select(*KEYS, *snr), KEYS, "left")


@lru_cache(maxsize=1)
def critical_sums() -> list[int]:
    """For 0 to EXACT untied differences: the largest signed-rank sum whose two-sided p value is under LEVEL; -1 if there is none."""
    out, ways = [], [1]
    for n in range(EXACT + 1):
        if n:
            ways = [(ways[w] if w < len(ways) else 0) + (ways[w - n] if w >= n else 0) for w in range(len(ways) + n)]
        below, last = 0, -1
        for w, count in enumerate(ways):
            below += count
            if 2 * below >= LEVEL * 2**n:
                break
            last = w
        out.append(last)
    return out


def rate_tests(transients: DataFrame, rate: DataFrame) -> DataFrame:
    """1 where a signed-rank test finds the rates on the two sides of the start to differ (p < 0.05), else 0, for three windows.

    As many of the last rates before as of the first after are paired, more than two a
    side are needed, and differences of 0 do not count. Ranks are windows over all
    transients; a sum of ranks is held against the exact distribution's critical
    value for up to EXACT differences without ties and zeros, else against the normal
    one's with ties corrected."""
    test = ["well_id", "transient_id", "scale"]
    x = _around(transients, rate).withColumn("us", F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("ts")))
    scales = F.explode(F.array(*(F.struct(F.lit(k).alias("scale"), F.lit(s).alias("share")) for k, s in SCALES.items()))).alias("s")
    x = x.select(*KEYS, "seq", "rate", "us", "duration_hr", scales).select("*", "s.*")
    reach = F.bround(F.col("duration_hr") * F.col("share") * 3.6e9)
    x = x.filter((F.col("us") >= -reach) & (F.col("us") < reach)).withColumn("early", F.col("us") < 0)
    side, both = Window.partitionBy(*test, "early"), Window.partitionBy(*test)
    x = x.withColumn("at", F.row_number().over(side.orderBy("us", "seq")))
    x = x.withColumn("n_early", F.sum(F.col("early").cast("int")).over(both)).withColumn("n_late", F.sum((~F.col("early")).cast("int")).over(both)).filter("n_early > 2 and n_late > 2")
    x = x.withColumn("at", F.when(F.col("early"), F.col("at") - F.greatest(F.col("n_early") - F.col("n_late"), F.lit(0))).otherwise(F.col("at"))).filter("at > 0 and at <= n_early")
    d = x.groupBy(*test, "at").agg((F.max(F.when(F.col("early"), F.col("rate"))) - F.max(F.when(~F.col("early"), F.col("rate")))).alias("d"))
    size = F.abs("d")
    d = d.withColumn("counts", F.col("d") != 0)
    d = d.withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*test, "counts", size))).withColumn("rank", F.rank().over(Window.partitionBy(*test, "counts").orderBy(size)) + (F.col("ties") - 1) / 2)
    of = lambda v: F.sum(F.when(F.col("counts"), v).otherwise(0))
    t = d.groupBy(*test).agg(
        of(F.lit(1)).alias("n"), of(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("plus"), of(F.col("ties") * F.col("ties") - 1).cast("double").alias("tie"), F.bool_and("counts").alias("no_zero")
    )
    n = F.col("n").cast("double")
    least = F.least(F.col("plus"), n * (n + 1) / 2 - F.col("plus"))
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    exact = (F.col("n") <= EXACT) & (F.col("tie") == 0) & F.col("no_zero")
    critical = F.get(F.array(*map(F.lit, critical_sums())), F.least(F.col("n"), F.lit(EXACT)).cast("int"))
    differ = F.when(exact, least <= critical).otherwise((spread > 0) & (F.abs(least - n * (n + 1) / 4) > NORMAL * F.sqrt(F.greatest(spread, F.lit(0.0)))))
    names = {k: f"binary_rate_change_{k}" for k in SCALES}
    found = t.withColumn("differ", differ.cast("int")).groupBy(*KEYS).agg(*(F.max(F.when(F.col("scale") == k, F.col("differ"))).alias(c) for k, c in names.items()))
    return transients.select(*KEYS).join(found, KEYS, "left").na.fill(0, [*names.values()])


def transform_p_value(p: float) -> int:
    return int(p < LEVEL)


def transform_snr(snr: Column) -> Column:
    return F.coalesce(1 / (1 + F.exp(-2 * (snr - 1))), F.lit(0.5))


def change_score(weights: list[float] | None = None) -> Column:
    """The weighted mean of the three tests and three transformed ratios of a row."""
    parts = [v for k in SCALES for v in (transform_snr(F.col(f"rate_change_snr_{k}")), F.col(f"binary_rate_change_{k}").cast("double"))]
    weights = weights or [1.0] * len(parts)
    return sum((p * w for p, w in zip(parts[1:], weights[1:], strict=True)), parts[0] * weights[0]) / sum(weights)


def normalize_feature(v: Column, low: Column, high: Column) -> Column:
    """1 at or below low, 0 at or above high, linear between."""
    return F.when(v < low, 1.0).when(v > high, 0.0).otherwise(1 - ratio(v - low, high - low))


def features(transients: DataFrame, rate: DataFrame, pressure: DataFrame, merge: bool = True) -> DataFrame:
    """All features of each transient, behind its own columns if merged."""
    f = pressure_features(transients, pressure).join(rate_features(transients, rate), KEYS).join(rate_change(transients, rate), KEYS).join(rate_tests(transients, rate), KEYS)
    return transients.join(f, KEYS) if merge else f


def mean_of(cols: list[Column]) -> Column:
    """The mean of those that are not null."""
    have = F.filter(F.array(*cols), lambda v: v.isNotNull())
    return ratio(F.aggregate(have, F.lit(0.0), lambda a, v: a + v), F.size(have))


def scores(transients: DataFrame, rate: DataFrame, pressure: DataFrame, merge: bool = True) -> DataFrame:
    """pressure_score, rate_score and significance_score of each transient; rate features against the 5th and 95th percentile of all transients."""
    f = features(transients, rate, pressure, merge=False)
    bounds = f.agg(*[F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).alias(f"b_{c}") for c in RATE])
    x = f.crossJoin(F.broadcast(bounds))  # one row
    out = x.select(*KEYS, mean_of([F.col(c) for c in PRESSURE]).alias("pressure_score"), mean_of([normalize_feature(F.col(c), F.col(f"b_{c}")[0], F.col(f"b_{c}")[1]) for c in RATE]).alias("rate_score"), change_score().alias("significance_score"))
    return transients.join(out, KEYS) if merge else out
