"""Whitening of embeddings by the principal components of their distinct grid vectors.

Entries are put on a grid of 1/256 as whole numbers, so that sums are exact. The
fit list holds each distinct grid vector once; its sums per dimension are added
as integers, and S = n * whole + part splits the mean into a whole number and a
fraction below 1, so that rows are centred (x - whole) - part / n without
cancellation. Spark's RowMatrix gives the Gramian of the centred rows, which over
n is the covariance; its eigenvectors are found on the driver (a matrix of the
dimension squared, whatever the number of rows) and broadcast, and every row is
projected where it lies. The whitened fit list is centred once more and
its covariance held against the identity in the same way.

Defined cases: vectors that are null, empty, or hold entries that are null, not
finite or beyond 2^53 in size (which the grid cannot hold as long integers) take
no part; neither do those of another length than the commonest of what is left
(the longest, if tied). Rows that repeat an id or a vector get rows of their own;
a component whose eigenvalue is not above rounding (d * 1e-14 of the largest) has
null for `whitened`, and is left out of the error; with no such component left,
as for one distinct vector, the error is null, and so is `explained` where all
variance is 0. Deviations beyond 38 digits are null. An empty table gives no rows; extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gaugewright.llm.store import drop, keep

GRID = 256
COMPONENTS = 4
LARGEST = 2.0**53
LOW = (1 << 31) - 1


@dataclass(frozen=True)
class Fit:
    """What whitening needs: the number of distinct vectors, their mean as whole + part / n, components as columns, eigenvalues, the trace."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.values > len(self.whole) * 1e-14 * max(self.values.max(initial=0), 0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Each row on each component, over the root of its eigenvalue; not a number for those that are not live."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, self.centred(x) @ self.vectors / np.sqrt(np.where(self.live, self.values, 1)), np.nan)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2 for each row, exact."""
        y = x - self.whole
        most = self.n * int(np.abs(y).max(initial=0)) + self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            z = self.n * y - self.part
        else:
            z = self.n * y.astype(object) - self.part.astype(object)
        return (z * z).sum(axis=1)


def on_grid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the grid vector, of each row whose vector takes part (lengths may still differ)."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    kept = df.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(sound, F.lit(False)))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(c * GRID).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(fit_list: DataFrame, d: int) -> list[int]:
    """The sum of each dimension, exact at any size: each task adds halves of 31 bits as long integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                total = [t + (int(h) << 31) + int(low) for t, h, low in zip(total, (x >> 31).sum(axis=0), (x & LOW).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    found = fit_list.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
    by = {r["i"]: int(r["s"]) for r in found}
    return [by[i] for i in range(d)]


def gramian(rows: Column, df: DataFrame, n: int, d: int) -> np.ndarray:
    """Of the rows in an array column, by RowMatrix."""
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(rows).alias("v")), "v")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray()


def _shifted(x: Column, *by: list) -> Column:
    """x less each of the given lists, one after the other."""
    for values in by:
        x = F.zip_with(x, F.array(*map(F.lit, values)), lambda a, b: a - b)
    return x


def fit(fit_list: DataFrame, n: int, d: int, components: int = COMPONENTS) -> Fit:
    """Components of a fit list: a column x of n distinct vectors of d whole numbers."""
    pairs = [divmod(s, n) for s in sums(fit_list, d)]
    whole, part = ([p[k] for p in pairs] for k in (0, 1))
    v = gramian(_shifted(F.col("x"), whole, [p / n for p in part]), fit_list, n, d) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Fit(n, np.array(whole, np.int64), np.array(part, np.int64), vectors * sign, values, float(np.trace(v)))


def identity_error(fit_list: DataFrame, found: Fit) -> float | None:
    """The largest difference from the identity of the covariance of the whitened fit list."""
    live = np.flatnonzero(found.live)
    if not len(live):
        return None
    shared = fit_list.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"z": list(shared.value.whitened(np.stack(b["x"]))[:, live])})

    z = keep(fit_list.select("x").mapInPandas(run, "z array<double>"), "whitened")
    mean = z.agg(*(F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(len(live)))).first()
    error = np.abs(gramian(_shifted(F.col("z"), list(mean)), z, found.n, len(live)) / found.n - np.eye(len(live))).max()
    drop(z)
    return float(error)


def project(rows: DataFrame, found: Fit) -> DataFrame:
    """vec_id, deviation and the whitened components z of every row of (vec_id, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(found)
    schema = rows.select("vec_id").schema.add("deviation", "decimal(38,0)").add("z", ArrayType(DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["x"])
                exact = [Decimal(int(v)) if int(v) < 10**38 else None for v in shared.value.deviations(x)]
                yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": exact, "z": list(shared.value.whitened(x))})

    return rows.select("vec_id", "x").mapInPandas(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error of every row that takes part and each component."""
    rows = on_grid(df, id_col, vector_col)
    kinds = keep(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "grid-vectors")
    common = kinds.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("rows"), F.desc("d")).first()
    schema = rows.select("vec_id").schema.add("component", "integer").add("n", "long").add("deviation", "decimal(38,0)").add("whitened", "double")
    schema = schema.add("explained", "double").add("identity_error", "double")
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    d, n = common["d"], common["n"]
    fit_list = kinds.filter(F.size("x") == d).select("x")
    found = fit(fit_list, n, d, components)
    error = identity_error(fit_list, found)
    share = F.array(*(F.lit(float(e) / found.trace if found.trace > 0 else None).cast("double") for e in found.values))
    out = project(rows.filter(F.size("x") == d), found).select("vec_id", "deviation", F.posexplode("z").alias("at", "value"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(~F.isnan("value"), F.col("value")).alias("whitened"),
        share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
