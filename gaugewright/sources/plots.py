"""Tables that a plot of a history, its transients or its regimes can be drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.regimes import REGIMES

# A colour for each kind of band.
COLOURS = {"shutin": "tomato", "flowing": "steelblue", "Radial": "green", "Linear-up": "orange", "Linear-down": "purple", "Boundary": "grey", "WBS": "black"}


def bands(transients: DataFrame) -> DataFrame:
    """well_id, x0, x1, label, colour of each transient."""
    names = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    return transients.select("well_id", F.col("start_hr").alias("x0"), F.col("end_hr").alias("x1"), F.col("status").alias("label"), F.try_element_at(names, "status").alias("colour"))


def extents(df: DataFrame, x: str, y: str, by: str = "well_id") -> DataFrame:
    """The axis range of each group."""
    return df.groupBy(by).agg(*[f(c).alias(f"{n}_{a}") for a, c in (("x", x), ("y", y)) for n, f in (("min", F.min), ("max", F.max))])


def regime_points(regimes: DataFrame) -> DataFrame:
    """regimes with the name and colour of each point's regime."""
    names = F.create_map(*[F.lit(x) for kv in REGIMES.items() for x in kv])
    colours = F.create_map(*[F.lit(x) for k, v in REGIMES.items() for x in (k, COLOURS[v])])
    return regimes.withColumn("regime_name", F.try_element_at(names, "regime")).withColumn("colour", F.try_element_at(colours, "regime"))
