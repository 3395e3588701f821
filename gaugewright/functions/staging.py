"""Where intermediate tables live: the folder that the cluster names in spark.checkpoint.dir.

A written table survives the loss of the executor that made it, unlike a local
checkpoint, and Parquet keeps it small. A folder of our own is set only where
the session names none and runs on one machine (tests); on a cluster that is an error."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; made and remembered if the session has none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="gaugewright-")
    return _OWN["dir"]


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver exits."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            _delete(spark, uri)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass

    atexit.register(clean)
    return uri


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark 4.1 may take a union as dealt by the keys of its parts, and leaves out the shuffle that a window, group or join behind it needs. With
#: joins of two shuffled sides before the union, rows of one key are then in several tasks and results are wrong (a window saw a part of its rows).
UNIONS = "spark.sql.unionOutputPartitioning"


def sound_unions(spark: SparkSession) -> None:
    """From now on, what needs a union's rows by a key has them shuffled. Plans are made when a result is asked for, so the setting stays."""
    spark.conf.set(UNIONS, "false")


def united(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all tables, columns by name, null where a table lacks one; safe to be grouped, windowed and joined."""
    sound_unions(first.sparkSession)
    for x in others:
        first = first.unionByName(x, allowMissingColumns=True)
    return first


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there.

    The shuffle files of the write serve nothing else, and go when it ends."""
    spark = df.sparkSession
    sound_unions(spark)
    uri = new_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(uri)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(uri)
    out._stored_uri = uri
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by keep() once nothing will read it again."""
    uri = getattr(df, "_stored_uri", None)
    if uri:
        _delete(df.sparkSession, uri)
