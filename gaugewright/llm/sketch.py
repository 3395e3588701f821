"""Sketches of fixed size over a whole table: made in parts, added up in blocks, and small enough for the driver and a broadcast at any input size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.bytesets import mix

BLOCKS = 64
SIEVE = 1 << 24  # slots of the sieve: 16 MB as bytes in a task, 2 MB as bits


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64)
    return (h % np.uint64(SIEVE)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(SIEVE)).astype(np.int64)


def tally(df: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], size: int, dtype: str, join: np.ufunc = np.add) -> np.ndarray:
    """One array of `size` for all of df: count(batch, array) updates a task's own, join merges two.

    Tasks' arrays are merged in lanes, about as many as the root of the tasks, and the lanes' in turn: none merges more than that root."""
    width = size // BLOCKS
    lanes = max(1, math.isqrt(df.rdd.getNumPartitions()) // 4)
    shape = "block int, lane int, x binary"

    def table(blocks: list[int], lane: list[int], arrays: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(lane, pa.int32()), pa.array(arrays, pa.binary())], names=["block", "lane", "x"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for b in batches:
            count(b, total)
        lane = TaskContext.get().partitionId() % lanes
        for i in range(BLOCKS):
            x = total[i * width : (i + 1) * width]
            if x.any():
                yield table([i], [lane], [x.tobytes()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(x, dtype)
                sums[block] = join(sums[block], x) if block in sums else x
        yield table(list(sums), [0] * len(sums), [x.tobytes() for x in sums.values()])

    parts = df.mapInArrow(part, shape)
    if lanes > 1:
        parts = parts.repartition(8 * lanes, "block", "lane").mapInArrow(merge, shape)
    out = np.zeros(size, dtype)
    for row in parts.repartition(8, "block").mapInArrow(merge, shape).collect():  # BLOCKS rows of a fixed size
        out[row.block * width : (row.block + 1) * width] = np.frombuffer(row.x, dtype)
    return out


def _marked(h: np.ndarray, total: np.ndarray) -> None:
    for s in _slots(h):
        total[s] = 1


def members(wanted: DataFrame) -> Broadcast:
    """Bits of a Bloom filter of `wanted` (its one column, long): 2 MB, whatever is wanted. See maybe()."""
    bits = np.packbits(tally(wanted, lambda b, total: _marked(mix(b.column(0).to_numpy().view(np.uint64)), total), SIEVE, "u1", np.maximum))
    return wanted.sparkSession.sparkContext.broadcast(bits)


def maybe(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be among those that the bits were made of."""
    ok = np.ones(len(ids), bool)
    for s in _slots(mix(ids.view(np.uint64))):
        ok &= (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 > 0
    return ok


def sieve(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key may be among those of `wanted` (its one column): a Bloom filter, before a join that decides.

    Its size is fixed; where it fills up, more rows pass and the join does the work."""
    return split(df, key, wanted)[0]


def split(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be wanted, and those whose key is not."""
    bits = np.packbits(tally(wanted.select(F.xxhash64(wanted.columns[0]).alias("h")), lambda b, total: _marked(b.column(0).to_numpy(), total), SIEVE, "u1", np.maximum))
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def part(passing: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                for s in _slots(b.column(b.num_columns - 1).to_numpy()):
                    ok &= (held[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 > 0
                ok = ok if passing else ~ok
                if ok.any():
                    yield b.filter(pa.array(ok)).select(range(b.num_columns - 1))

        name = "hash"
        while name in df.columns:  # the last column, whatever the others are called
            name += "_"
        hashed = df.select("*", F.xxhash64(key).alias(name))
        return hashed.mapInArrow(run, df.schema)

    return part(True), part(False)
