"""Intermediate tables of this folder, kept as the engine keeps its own."""

import gc

from pyspark.sql import DataFrame, SparkSession

from gaugewright.functions import staging
from gaugewright.functions.staging import drop, new_path, shared_dir

__all__ = ["drop", "free", "keep", "new_path", "shared_dir"]


def free(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back; batches of texts to and from Python stay small meanwhile."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    conf.set(name, "8m")
    try:
        return staging.keep(df, label)
    finally:
        conf.set(name, before)
