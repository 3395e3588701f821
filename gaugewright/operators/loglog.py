"""The log-log family: superposition time, Bourdet derivative, normalisation and the envelope, for all transients at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.grids import log_ends, on_log_grid
from gaugewright.functions.intervals import interval_join
from gaugewright.functions.kernels import bourdet_points, bourdet_slopes, group_bounds, log_terms, whole_groups
from gaugewright.functions.numeric import ratio
from gaugewright.functions.staging import united

KEYS = ("well_id", "transient_id")
STEP_BLOCK = 1024  # rate steps of a well that a row holds at most


def with_ids(transients: DataFrame) -> DataFrame:
    """transients numbered by start in their well."""
    return transients.withColumn("transient_id", F.row_number().over(Window.partitionBy("well_id").orderBy("start_hr", "end_hr")))


def transient_samples(bhp: DataFrame, transients: DataFrame) -> DataFrame:
    """Samples of each transient (closed range of hours)."""
    t = transients.select("well_id", "transient_id", "start_hr", "end_hr")
    inside = F.col("time_hr").between(F.col("start_hr"), F.col("end_hr"))
    return interval_join(bhp, t, ["well_id"], F.col("time_hr"), F.col("start_hr"), F.col("end_hr"), inside)


def rate_steps(points: DataFrame, rates: DataFrame) -> DataFrame:
    """well_id, bp, time_hr, rate, before, change: each breakpoint that begins a rate, the rate before it (none: null) and the change."""
    w = Window.partitionBy("well_id").orderBy("bp")
    b = points.withColumn("bp", F.row_number().over(Window.partitionBy("well_id").orderBy("time_hr")))
    s = b.join(rates.select("well_id", F.col("seq").alias("bp"), "rate"), ["well_id", "bp"]).select("well_id", "bp", "time_hr", "rate", F.lag("rate").over(w).alias("before"))
    return s.withColumn("change", F.col("rate") - F.coalesce("before", F.lit(0.0)))


def last_steps(steps: DataFrame, transients: DataFrame) -> DataFrame:
    """well_id, transient_id, n_steps, rate, rate_before, nonzero, nonzero_before: how many steps begin up to a transient's start,
    the last rate and the last that is not 0, each with the rate before it. Transients before all steps are left out.

    Steps and starts are put in one order by well: no step meets a transient by a join."""
    row = F.struct("rate", "before")
    s = steps.select("well_id", "time_hr", F.lit(0).alias("kind"), "bp", row.alias("last"), F.when(F.col("rate") != 0, row).alias("nonzero"))
    both = united(s, transients.select("well_id", F.col("start_hr").alias("time_hr"), F.lit(1).alias("kind"), "transient_id"))
    upto = Window.partitionBy("well_id").orderBy("time_hr", "kind", "bp").rowsBetween(Window.unboundedPreceding, 0)
    x = both.select("well_id", "transient_id", "kind", F.count("bp").over(upto).cast("int").alias("n_steps"), *(F.last(c, True).over(upto).alias(c) for c in ("last", "nonzero")))
    return x.filter("kind = 1 and n_steps > 0").select(
        *KEYS, "n_steps", F.col("last.rate").alias("rate"), F.col("last.before").alias("rate_before"), F.col("nonzero.rate").alias("nonzero"), F.col("nonzero.before").alias("nonzero_before")
    )


def superposition(samples: DataFrame, steps: DataFrame, ends: DataFrame, injection: bool = False, block: int = STEP_BLOCK) -> DataFrame:
    """well_id, transient_id, seq, superposition, delta_pressure, delta_time of each sample after a transient's first.

    A well's steps are held once, in blocks of `block`. A sample meets the blocks up to its
    transient's last step, adds up each in place, and its parts are summed: no row holds more
    steps than a block, and none is shuffled with a sample. Terms are added from the last step
    back, as the SQL's join brings them: a derivative over a small rise of superposition shows
    the last bits of the sum; logarithms are the C library's, as the JVM's differ in them. A sample at
    the very start of a rate has log10(0), which is -inf. A shut-in divides by its last
    rate that is not 0 (none: null) and turns the sign; an injection divides by its last rate."""
    first = F.min(F.struct("seq", "pressure", "time_hr")).over(Window.partitionBy(*KEYS))
    x = samples.select(*KEYS, "seq", "pressure", "time_hr").withColumn("f", first).filter(F.col("seq") > F.col("f.seq"))
    x = x.join(ends.select(*KEYS, "n_steps", F.col("rate" if injection else "nonzero").alias("qn")), list(KEYS))
    number = lambda bp: F.floor((bp - 1) / block).cast("int")
    held = F.sort_array(F.collect_list(F.struct("bp", "time_hr", "change")), False).alias("steps")
    blocks = steps.groupBy("well_id", number(F.col("bp")).alias("block")).agg(held)
    x = x.withColumn("block", F.explode(F.sequence(F.lit(0), number(F.col("n_steps"))))).join(blocks, ["well_id", "block"])

    @F.arrow_udf("double")
    def part(at: pa.Array, upto: pa.Array, scale: pa.Array, steps: pa.Array) -> pa.Array:
        return log_terms(at, upto, scale, steps, 1.0 if injection else -1.0)

    x = x.select(*KEYS, "seq", part("time_hr", "n_steps", "qn", "steps").alias("part"), F.abs(F.col("pressure") - F.col("f.pressure")).alias("dp"), (F.col("time_hr") - F.col("f.time_hr")).alias("dt"))
    return x.groupBy(*KEYS, "seq").agg(F.sum("part").alias("superposition"), F.first("dp").alias("delta_pressure"), F.first("dt").alias("delta_time"))


def derivative(frame: DataFrame, smoothing: float) -> DataFrame:
    """The Bourdet derivative at the middle points of each transient; a point that is the middle of several has a row for each.

    Null where two superpositions are equal or one is null; NaN where infinite ones leave no number."""
    schema = "well_id {0}, transient_id int, point int, superposition double, delta_pressure double, delta_time double, derivative double".format(dict(frame.dtypes)["well_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            s, p, dt = (t.column(c).to_numpy(zero_copy_only=False) for c in ("superposition", "delta_pressure", "delta_time"))
            cut = group_bounds(t, 2)
            found = [(a, *bourdet_points(dt[a:z], smoothing)) for a, z in zip(cut[:-1], cut[1:], strict=True)]
            if not found:
                continue
            i, j, k = (np.concatenate([f[0] + f[c] for f in found]) for c in (1, 2, 3))
            point = np.concatenate([np.arange(len(f[1])) for f in found]).astype(np.int32)
            d, equal = bourdet_slopes(s, p, i, j, k)
            none = t.column("superposition").is_null().to_numpy(zero_copy_only=False)
            own = t.select([*KEYS, "superposition", "delta_pressure", "delta_time"]).take(pa.array(j))
            cols = [own.column(0), own.column(1).cast(pa.int32()), pa.array(point), *own.columns[2:], pa.array(d, mask=equal | none[i] | none[j] | none[k])]
            yield pa.RecordBatch.from_arrays(cols, names=["well_id", "transient_id", "point", "superposition", "delta_pressure", "delta_time", "derivative"])

    # sorted partitions in batches of whole transients: a group is a slice of arrays, not a frame of its own
    rows = frame.select(*KEYS, "seq", "superposition", "delta_pressure", "delta_time").repartition(*KEYS).sortWithinPartitions(*KEYS, "seq")
    return rows.mapInArrow(run, schema)


def loglog(bhp: DataFrame, transients: DataFrame, points: DataFrame, rates: DataFrame, injection: bool = False, smoothing: float | None = None) -> DataFrame:
    """Derivatives of every transient of a kind, from histories, breakpoints and rebuilt rates."""
    steps = rate_steps(points, rates)
    frame = superposition(transient_samples(bhp, transients), steps, last_steps(steps, transients), injection)
    return derivative(frame, (0.2 if injection else 0.1) if smoothing is None else smoothing)


def normalize(frame: DataFrame, ends: DataFrame, reference: DataFrame) -> DataFrame:
    """frame with pressures and derivatives scaled to a well's reference transient.

    ends: the last steps of each transient; reference: well_id, nonzero and
    nonzero_before of its last steps. Pressures are scaled by the last change of rate, by
    the last rate where the last two are equal, and by the last rate that is not 0
    where a transient ends at 0."""
    ref = reference.select("well_id", F.col("nonzero").alias("qr"), F.coalesce("nonzero_before", F.lit(0.0)).alias("qr_prev"))
    z, y = F.col("rate"), F.col("rate_before")
    change = F.when(z == 0, F.col("nonzero")).when(z != y, z - y).otherwise(z)  # one rate, or two equal ones: the rate itself
    own = ends.select(*KEYS, F.col("nonzero").alias("q"), change.alias("dq"))
    x = frame.join(own, list(KEYS)).join(ref, "well_id")
    s, a = F.abs(ratio(F.col("qr"), F.col("dq"))), F.abs(ratio(F.col("qr") - F.col("qr_prev"), F.col("dq")))
    sd, ad = F.abs(ratio(F.col("qr"), F.col("q"))), F.abs(ratio(F.col("qr") - F.col("qr_prev"), F.col("q")))
    return x.select(*frame.columns, (F.col("delta_pressure") * s).alias("pn_saphir"), (F.col("delta_pressure") * a).alias("pn_autowell"), (F.col("derivative") * sd).alias("derivative_saphir"), (F.col("derivative") * ad).alias("derivative_autowell"))


def interpolate_on_grid(frame: DataFrame, group: list[str], member: str, x: str, y: str, points: int) -> DataFrame:
    """group, member, g, grid, value: y at `points` log-spaced x common to a group, linear between samples, the end values beyond."""
    f = frame.select(*group, member, F.col(x).alias("x"), F.col(y).alias("value")).na.drop()
    span = f.groupBy(*group).agg(F.greatest(F.min("x"), F.lit(1e-12)).alias("a"), F.max("x").alias("z")).select(*group, log_ends(F.col("a"), F.col("z"), points).alias("e"))
    return on_log_grid(f.join(span, group), [*group, member], "x", ["value"], F.col("e.lo"), F.col("e.hi"), points, ends=(F.col("e.first"), F.col("e.last")))


def envelope(frame: DataFrame, group: list[str], member: str = "transient_id", points: int = 500, log_half_window: float = 0.2, k_std: float = 2.0, time_col: str = "delta_time", value_col: str = "derivative") -> DataFrame:
    """group, g, grid, mean, lower, upper: in log10, mean and k population deviations over a centred window of the pooled values.

    The values of one grid point are reduced to number, mean and squares about it
    first, so that what a group gathers is `points` long however many members it
    has. A window without positive values takes the one before."""
    v = interpolate_on_grid(frame, group, member, time_col, value_col, points)
    lv = F.when(F.col("value") > 0, F.log10("value"))
    sums = v.groupBy(*group, "g").agg(F.first("grid").alias("grid"), F.count(lv).alias("n"), F.coalesce(F.avg(lv), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(lv), F.lit(0.0)).alias("v"))
    rows = sums.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("g", "grid", "n", "m", "v"))).alias("r"))  # `points` rows, whatever the group
    step = F.log10(ratio(F.try_element_at("r", F.lit(2))["grid"], F.col("r")[0]["grid"]))
    half = F.greatest(F.lit(1), F.least(F.bround(ratio(F.lit(log_half_window), step)), F.lit(float(points))).cast("int"))
    centre = F.col("x.g")
    near = F.slice("r", F.greatest(centre - half, F.lit(0)) + 1, F.least(centre, half) + half + 1)
    rows = rows.select(*group, F.explode("r").alias("x"), "r").select(*group, "x", F.explode(near).alias("y"))
    off = F.col("y.m") - F.col("x.m")  # from the centre's mean, so that equal values deviate by nothing
    w = rows.groupBy(*group, F.col("x.g").alias("g"), F.col("x.grid").alias("grid"), F.col("x.m").alias("m0")).agg(
        F.sum("y.n").alias("n"), F.sum(F.col("y.n") * off).alias("s"), F.sum(F.col("y.n") * (F.col("y.v") + off * off)).alias("q")
    )
    mean = ratio(F.col("s"), F.col("n"))
    std = F.sqrt(F.greatest(ratio(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0)))
    c = w.select(*group, "g", "grid", (F.col("m0") + mean).alias("m"), F.when(F.col("n") > 0, std).alias("d"))
    before = Window.partitionBy(*group).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("m", F.last("m", True).over(before)).withColumn("d", F.coalesce(F.last("d", True).over(before), F.lit(0.0)))
    power = lambda e: F.pow(F.lit(10.0), e)
    return c.select(*group, "g", "grid", power(F.col("m")).alias("mean"), power(F.col("m") - k_std * F.col("d")).alias("lower"), power(F.col("m") + k_std * F.col("d")).alias("upper"))
