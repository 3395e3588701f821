"""Shut-in transients from pressure: valleys, the shoulders before them, and the intervals between."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from gaugewright.functions.kernels import Edge, flats_and_walls, group_bounds, low_flats, stitch, wall_cuts, whole_groups
from gaugewright.functions.numeric import ratio
from gaugewright.functions.staging import united

DEFAULT_INTERVAL = 50.0
SLICE = 1 << 16  # samples of a well that are worked on at once
_CLAMP = pa.list_(pa.float64())
EDGE = pa.struct([(c, pa.float64() if c in ("first", "second", "last", "last_but_one") else pa.int64() if c in ("slice", "n", "first_tail", "last_head") else _CLAMP) for c in Edge._fields])
TRANSIENT = ("well_id", "start_hr", "end_hr", "duration_hr", "start_ts", "end_ts", "status")


class Tpmr(NamedTuple):
    breakpoints: DataFrame  # of all shut-ins
    breakpoints_interval: DataFrame  # of those longer than the interval
    transients: DataFrame
    transients_interval: DataFrame


def default_prominence(bhp: DataFrame) -> DataFrame:
    """well_id, prominence: half of the spread from the 5th to the 90th percentile (exact percentiles)."""
    q = F.percentile("pressure", F.array(F.lit(0.9), F.lit(0.05)))
    return bhp.groupBy("well_id").agg(q.alias("q")).select("well_id", F.round((F.col("q")[0] - F.col("q")[1]) / 2, 9).alias("prominence"))


def detect_valleys(bhp: DataFrame, prominence: float | None = None, slice_samples: int = SLICE) -> DataFrame:
    """The samples that are prominent valleys, labelled flowing. Samples without a pressure, or with NaN, count as absent.

    A well is worked on in slices of `slice_samples` numbers of seq: a slice gives the valleys that its own walls do not rule out, and
    one row of a few numbers for its neighbours. Only those rows come
    together by well, and say which valleys the walls of other slices allow."""
    src = bhp.select("well_id", "seq", "ts", "pressure", "time_hr").filter(F.col("pressure").isNotNull() & ~F.isnan(F.col("pressure").cast("double")))
    out = src.schema
    src = src.withColumn("slice", F.floor(F.col("seq") / slice_samples))
    p = default_prominence(bhp) if prominence is None else None
    with_p = src.join(p, "well_id") if p is not None else src.withColumn("prominence", F.lit(float(prominence)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            p, bounds, at, opens, edges = t.column("pressure").to_numpy().astype(np.float64), group_bounds(t, 2), [], [], []
            cuts, slices = wall_cuts(p, t.column("prominence").to_numpy(zero_copy_only=False).astype(np.float64)), t.column("slice").to_numpy()
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                s = flats_and_walls(p[a:z], cuts[a:z])
                v, m, k = s.value, len(s.value), low_flats(s)
                pair = lambda x, i: [float(x[0][i]), float(x[1][i])]
                edges += [None] * len(k) + [Edge(slices[a], z - a, v[0], s.tail[0], v[1] if m > 1 else np.nan, v[-1], s.head[-1], v[-2] if m > 1 else np.nan, pair(s.left, m), pair(s.right, 0), pair(s.left, m - 1), pair(s.right, 1))._asdict()]
                at.append(np.append(a + (s.head[k] + s.tail[k]) // 2, a))
                opens.append(np.append(np.stack([s.left[0][k] < v[k], s.right[0][k + 1] < v[k]]), [[False], [False]], axis=1))
            rows = t.select(kind.names[:-3]).take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, np.concatenate(opens, axis=1)), pa.array(edges, EDGE)], names=kind.names)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            bounds, columns = group_bounds(t, 1), t.drop_columns("well_id").to_pydict()
            edges = [Edge(*r) for r in zip(*(columns[c] for c in Edge._fields), strict=True)]
            rows = [r for a, z in zip(bounds[:-1], bounds[1:], strict=True) for r in stitch(edges[a:z])]
            cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32())), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("well_id"), *cols], names=["well_id", "slice", "x_left", "x_right", "places"])

    # sorted partitions in batches of whole slices, as most wells are short
    kind = StructType([out["well_id"], StructField("slice", LongType()), *[f for f in out if f.name != "well_id"]]).add("open_left", "boolean").add("open_right", "boolean").add("edge", from_arrow_type(EDGE))
    worked = with_p.select(*kind.names[:-3], "prominence").repartition("well_id", "slice").sortWithinPartitions("well_id", "slice", "seq").mapInArrow(work, kind)
    edges = worked.filter("edge is not null").select("well_id", *[F.col(f"edge.{c}") for c in Edge._fields])
    met = edges.repartition("well_id").sortWithinPartitions("well_id", "slice").mapInArrow(join_up, StructType([out["well_id"]]).add("slice", "long").add("x_left", "double").add("x_right", "double").add("places", ArrayType(IntegerType())))
    inner = worked.filter("edge is null").join(met.drop("places"), ["well_id", "slice"]).filter("(not open_left or x_left >= pressure) and (not open_right or x_right >= pressure)")
    at_edges = src.join(met.filter("size(places) > 0").select("well_id", "slice", "places"), ["well_id", "slice"])
    at_edges = at_edges.withColumn("place", F.row_number().over(Window.partitionBy("well_id", "slice").orderBy("seq")) - 1).filter(F.array_contains("places", F.col("place")))
    return united(inner.select(*out.names), at_edges.select(*out.names)).withColumn("label", F.lit("flowing"))


def split_segments(bhp: DataFrame, valleys: DataFrame) -> DataFrame:
    """bhp with segment: how many valleys are at or before the sample. What follows the last valley is left out.

    One pass over the union of samples and valleys instead of a range join."""
    marks = valleys.select("well_id", "ts", F.lit(1).alias("v"), *[F.lit(None).cast(t).alias(c) for c, t in bhp.dtypes if c not in ("well_id", "ts")]).distinct()
    both = united(bhp.withColumn("v", F.lit(0)), marks)
    w = Window.partitionBy("well_id").orderBy("ts", F.desc("v"), "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("segment", F.sum("v").over(w)).withColumn("n", F.sum("v").over(Window.partitionBy("well_id")))
    return both.filter((F.col("v") == 0) & (F.col("segment") < F.col("n"))).drop("v", "n")


def detect_shoulders(segments: DataFrame) -> DataFrame:
    """Of each segment the sample where pressure leaves its top: the elbow between the highest sample and the last, or the highest, labelled shutin.

    The elbow is the sample farthest above the chord, in units of the part's own
    extent (the latest of ties). It counts if it is not the last sample and is
    above the mean of the highest and last pressure."""
    by = Window.partitionBy("well_id", "segment")
    top = F.max(F.struct("pressure", "seq")).over(by)
    x = segments.withColumn("top", top).withColumn("end", F.max(F.struct("seq", "pressure", "time_hr")).over(by)).filter(F.col("seq") >= F.col("top.seq"))
    lo, hi = F.min("pressure").over(by), F.max("pressure").over(by)
    t0 = F.min("time_hr").over(by)
    x = x.withColumn("x", ratio(F.col("time_hr") - t0, F.col("end.time_hr") - t0)).withColumn("y", ratio(F.col("pressure") - lo, hi - lo)).withColumn("y0", ratio(F.col("end.pressure") - lo, hi - lo))
    bend = -(F.col("y") - F.col("y0")) - (1 - F.col("y0")) * (F.col("x") - 1)
    row = F.struct("seq", "ts", "pressure", "time_hr")
    # rounding keeps both ends of the chord at exactly 0 in any engine
    best = x.groupBy("well_id", "segment").agg(F.min_by(row, F.struct(F.round(bend, 9).alias("b"), F.negate("seq").alias("s"))).alias("e"), F.first("top").alias("top"), F.first("end").alias("end"), F.min_by(row, "seq").alias("m"), F.max(bend.isNull()).alias("flat"))
    use = ~F.col("flat") & (F.col("e.seq") != F.col("end.seq")) & (F.col("e.pressure") > (F.col("top.pressure") + F.col("end.pressure")) / 2)
    return best.select("well_id", "segment", F.when(use, F.col("e")).otherwise(F.col("m")).alias("r")).select("well_id", "segment", "r.*", F.lit("shutin").alias("label"))


def _numbered(valleys: DataFrame) -> DataFrame:
    """Valleys with the segment that they end."""
    return valleys.withColumn("segment", F.row_number().over(Window.partitionBy("well_id").orderBy("ts", "seq")) - 1)


def combine_breakpoints(bhp: DataFrame, valleys: DataFrame, shoulders: DataFrame) -> DataFrame:
    """First sample, valleys, shoulders and last sample by time, one for each timestamp (valley, shoulder, first, last)."""
    cols = ["well_id", "seq", "ts", "pressure", "time_hr"]
    row = F.struct(*cols[1:])
    ends = bhp.groupBy("well_id").agg(F.min_by(row, "seq").alias("a"), F.max_by(row, "seq").alias("z"))
    parts = [valleys.select(*cols, F.lit("flowing").alias("label"), F.lit(0).alias("rank")), shoulders.select(*cols, F.lit("shutin").alias("label"), F.lit(1).alias("rank")),
             ends.select("well_id", "a.*", F.lit("start").alias("label"), F.lit(2).alias("rank")), ends.select("well_id", "z.*", F.lit("end").alias("label"), F.lit(3).alias("rank"))]
    every = united(*parts)
    first = Window.partitionBy("well_id", "ts").orderBy("rank", "seq")
    return every.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "rank")


def shutin_transients(valleys: DataFrame, shoulders: DataFrame) -> DataFrame:
    """Each segment's shut-in, from its shoulder to the valley that ends it."""
    v = _numbered(valleys).select("well_id", "segment", F.col("time_hr").alias("end_hr"), F.col("ts").alias("end_ts"))
    s = shoulders.select("well_id", "segment", F.col("time_hr").alias("start_hr"), F.col("ts").alias("start_ts"))
    x = s.join(v, ["well_id", "segment"]).withColumn("duration_hr", F.col("end_hr") - F.col("start_hr"))
    return x.select("well_id", "start_hr", "end_hr", "duration_hr", "start_ts", "end_ts", F.lit("shutin").alias("status"), "segment")


def tpmr(bhp: DataFrame, prominence: float | None = None, interval: float = DEFAULT_INTERVAL) -> Tpmr:
    """All shut-ins of all wells, and those longer than `interval` hours, with their breakpoints."""
    valleys = detect_valleys(bhp, prominence)
    shoulders = detect_shoulders(split_segments(bhp, valleys))
    every = shutin_transients(valleys, shoulders)
    long = every.filter(F.col("duration_hr") > interval)
    keep = long.select("well_id", "segment")
    long_bp = combine_breakpoints(bhp, _numbered(valleys).join(keep, ["well_id", "segment"], "left_semi").drop("segment"), shoulders.join(keep, ["well_id", "segment"], "left_semi"))
    return Tpmr(combine_breakpoints(bhp, valleys, shoulders), long_bp, every.select(*TRANSIENT), long.select(*TRANSIENT))
