"""Reading gauge files and writing results."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The header's default and the names results are exported under.
DEFAULT_WELL = "DUMMY"
EXPORT = {
    "time_hr": "Time", "ts": "Timestamp", "pressure": "Pressure", "rate": "Rate", "start_hr": "start/hr", "end_hr": "end/hr", "duration_hr": "duration/hr",
    "start_ts": "start/timestamp", "end_ts": "end/timestamp", "derivative": "Derivative", "superposition": "Superposition", "delta_pressure": "Delta_Pressure", "delta_time": "Delta_Time",
}


def read_vector(spark: SparkSession, path: str, schema: str | None = None, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """A csv (header, `#` lines are comments) or parquet file or folder, with a closed slice by ts if asked for.

    The slice is a filter that the parquet scan takes over."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        reader = spark.read.option("header", True).option("comment", "#")
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
        df = df.drop("_c0")
    elif kind == "parquet":
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    else:
        raise ValueError(f"{path}: csv and parquet can be read")
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    return df


def write_with_header(df: DataFrame, path: str, well: str | None = None, label: str | None = None, long_label: str | None = None, **more: object) -> str:
    """One csv text file with its metadata as a `# {...}` line; the path used (always ending in .csv).

    A series for exchange is small by purpose, so it is one part."""
    path = path if path.endswith(".csv") else f"{path}.csv"
    meta = {"well": well or DEFAULT_WELL, "label": label or df.columns[-1]} | ({"long label": long_label} if long_label else {}) | more
    head = df.sparkSession.createDataFrame([(0, f"# {meta}"), (1, ",".join(df.columns))], "k int, value string")
    body = df.select(F.lit(2).alias("k"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    head.unionByName(body).coalesce(1).select("value").write.mode("overwrite").text(path)
    return path


def read_header(spark: SparkSession, path: str) -> dict[str, object]:
    """The metadata line of such a file."""
    first = spark.read.text(path).filter(F.col("value").startswith("# ")).first()
    return ast.literal_eval(first.value[2:]) if first else {}


def export(df: DataFrame) -> DataFrame:
    """df under the names of the exchange format."""
    return df.select(*[F.col(c).alias(EXPORT.get(c, c)) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, in folders by columns (well_id, regime, transient_id) if named, so that later reads prune."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
