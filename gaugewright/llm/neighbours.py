"""Approximate nearest neighbours by inner product: NN-descent, then greedy search of its graph.

Equal vectors are one node (with their least ids). Every node is indexed. The
graph starts from random blocks and improves in rounds of joins: each node
gathers its neighbours and a sample of those it is a neighbour of, with their
vectors; any two that meet there are neighbours of neighbours, and are offered
to each other if they beat what the other has. Queries then search greedily from
their own node: the best unexpanded nodes of a beam are joined to their
neighbours, scored, and kept if they are among the best. Vectors travel as bytes
(int8 at the scale of their own largest component, and that scale); the beam is finally scored on the
original vectors in double precision, and the best are returned.

A node's list and beam have fixed sizes; samples of reverse neighbours are drawn
by rate, as in the method, so that a node which is near to very many has no long
list anywhere. Recall is measured against brute force in the tests.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without an id; nor those of another length than the most
frequent one of the rest (of equally frequent ones the longest);
ties go to the smaller vec_id; an empty table gives no rows; fewer candidates
than asked for are all returned if one block holds them; extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm.store import drop, free, keep

K = 32  # neighbours of a node
REVERSE = 32  # sampled reverse ones
OFFERS = 10  # a node takes from one meeting
BLOCK = 64
ROUNDS, SETTLED = 8, 0.02
BEAM, EXPAND, STEPS = 64, 10, 4
TOP = 20
PER_BUCKET = 4_000_000
_PACKED = "bucket int, a binary, c binary, s binary"


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    x = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists(v, lambda e: e != 0)
    x = x.filter(fine)
    sizes = x.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.agg(F.max(F.struct("n", "d")).alias("x")).select("x.d")  # one row
    return x.join(F.broadcast(usual), F.size("v") == F.col("d")).drop("d")


def _groups(batches: Iterator[pa.RecordBatch], column: int = 0, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Sorted batches again, cut so that no run of equal keys is split."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if n + len(key) >= rows else -1
        if cut >= 0 and (cut or (held and held[-1].column(column)[-1].as_py() != key[0])):
            if cut:
                held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [b.slice(cut)], b.num_rows - cut
        else:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array) -> np.ndarray:
    size = len(column[0].as_buffer())
    raw = np.frombuffer(b"".join(x.as_buffer() for x in column), np.int8).reshape(-1, size)
    scale = np.ascontiguousarray(raw[:, -4:]).view("<f4")
    return raw[:, :-4].astype(np.float32) * scale


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))


def _pack(a: np.ndarray, c: np.ndarray, s: np.ndarray, buckets: int) -> pa.RecordBatch:
    where = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(where, kind="stable")
    a, c, s = a[order], c[order], s[order].astype("<f4")
    cut = np.searchsorted(where[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    put = lambda x: pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), put(a), put(c), put(s)], names=["bucket", "a", "c", "s"])


def _meet(members: DataFrame, parts: int, buckets: int, offers: int) -> DataFrame:
    """Offers from meetings: members w, a, q, worst; any two of a meeting are offered to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            w, a, worst = (b.column(i).to_numpy() for i in (0, 1, 3))
            x = _matrix(b.column(2))
            cut = _bounds(w)
            out: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi - lo < 2:
                    continue
                own, m = a[lo:hi], x[lo:hi]
                s = m @ m.T
                np.fill_diagonal(s, -np.inf)
                if hi - lo > offers + 1:
                    best = np.argpartition(-s, offers, axis=1)[:, :offers]
                else:
                    best = np.broadcast_to(np.arange(hi - lo), (hi - lo, hi - lo))
                got = np.take_along_axis(s, best, axis=1)
                i, j = np.nonzero((got > worst[lo:hi, None]) & (own[best] != own[:, None]))
                out.append((own[i], own[best[i, j]], got[i, j]))
            if out:
                yield _pack(*(np.concatenate(z) for z in zip(*out, strict=True)), buckets)

    return members.repartition(parts, "w").sortWithinPartitions("w").mapInArrow(run, _PACKED)


def _merge(offers: DataFrame, graph: DataFrame | None, buckets: int) -> DataFrame:
    """u, nbrs, scores, changed: the best K of what each node has and is offered."""
    packed = offers.select("bucket", "a", "c", "s", F.lit(1).alias("fresh"))
    if graph is not None:

        def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    n = np.diff(b.column(1).offsets.to_numpy())
                    yield _pack(np.repeat(b.column(0).to_numpy(), n), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(), buckets)

        packed = packed.union(graph.select("u", "nbrs", "scores").mapInArrow(repack, _PACKED).withColumn("fresh", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        a, c, s = (np.frombuffer(b"".join(x for b in held for x in b.column(i).to_pylist()), t) for i, t in ((1, "<i8"), (2, "<i8"), (3, "<f4")))
        fresh = np.concatenate([np.repeat(b.column(4).to_numpy(), [len(x) // 8 for x in b.column(1).to_pylist()]) for b in held])
        order = np.lexsort((fresh, c, a))
        a, c, s, fresh = a[order], c[order], s[order], fresh[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        a, c, s, fresh = a[new], c[new], s[new], fresh[new]
        order = np.lexsort((c, -s, a))
        a, c, s, fresh = a[order], c[order], s[order], fresh[order]
        cut = _bounds(a)
        place = np.arange(len(a)) - np.repeat(cut[:-1], np.diff(cut))
        top = place < K
        a, c, s, fresh = a[top], c[top], s[top], fresh[top]
        cut = _bounds(a)
        off = pa.array(cut.astype(np.int32))
        out = pa.RecordBatch.from_arrays([pa.array(a[cut[:-1]]), pa.ListArray.from_arrays(off, pa.array(c)), pa.ListArray.from_arrays(off, pa.array(s)), pa.array(np.add.reduceat(fresh, cut[:-1]).astype(np.int32))], names=["u", "nbrs", "scores", "changed"])
        for i in range(0, out.num_rows, 5000):
            yield out.slice(i, 5000)

    return packed.repartition(buckets, "bucket").mapInArrow(run, "u long, nbrs array<long>, scores array<float>, changed int")


def _reverse(graph: DataFrame, salt: int) -> DataFrame:
    """w, a: for each node a sample, of REVERSE on average at most, of those it is a neighbour of."""
    e = graph.select(F.col("u").alias("a"), F.explode("nbrs").alias("w"))
    n = e.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("w", "a", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    return e.join(n, "w").filter(draw * F.col("n") < REVERSE).select("w", "a")


def build(nodes: DataFrame) -> DataFrame:
    """u, nbrs, scores: the neighbour graph of nodes (u, q)."""
    spark = nodes.sparkSession
    n = nodes.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * (K + REVERSE) // PER_BUCKET + 1)
    # offers are packed by bucket: as many as their number asks for, not as there are partitions
    buckets = max(2 * spark.sparkContext.defaultParallelism, n * (K + REVERSE) * OFFERS // (2 * PER_BUCKET) + 1)
    blocks = max(1, -(-n // BLOCK))
    start = nodes.select(F.explode(F.array(*[F.pmod(F.xxhash64("u", F.lit(t)), F.lit(blocks)) + t * blocks for t in range(2)])).alias("w"), F.col("u").alias("a"), "q", F.lit(float("-inf")).cast("float").alias("worst"))
    graph = keep(_merge(_meet(start, parts, buckets, K), None, buckets), "graph")
    for r in range(ROUNDS):
        ends = graph.select("u", F.when(F.size("scores") < K, F.lit(float("-inf"))).otherwise(F.array_min("scores")).cast("float").alias("worst"))
        state = nodes.join(ends, "u", "left").select(F.col("u").alias("a"), "q", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        meet = graph.select(F.col("u").alias("w"), F.explode(F.concat(F.array("u"), "nbrs")).alias("a")).union(_reverse(graph, r)).distinct()
        new = keep(_merge(_meet(meet.join(state, "a").select("w", "a", "q", "worst"), parts, buckets, OFFERS), graph, buckets), "graph")
        drop(graph)
        graph = new
        free(spark)
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        if changed <= SETTLED * K * n:
            break
    return graph


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """q, c, score: the beam of each query node after greedy search from itself."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ways = keep(graph.select(F.col("u").alias("f"), F.explode("nbrs").alias("c")).union(_reverse(graph, ROUNDS).select(F.col("w").alias("f"), F.col("a").alias("c"))).distinct(), "ways")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            q, c, done = (b.column(i).to_numpy() for i in range(3))
            x = _matrix(b.column(3))
            cut = _bounds(q)
            out: list[tuple[np.ndarray, ...]] = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own = np.flatnonzero(c[lo:hi] == q[lo])
                s = x[lo:hi] @ x[lo + own[0]]
                s[own[0]] = np.inf  # the query's own node stays
                best = np.lexsort((c[lo:hi], -s))[: BEAM + 1]
                seen = done[lo:hi][best].astype(bool)
                go = np.zeros(len(best), bool)
                go[np.flatnonzero(~seen)[:EXPAND]] = True
                out.append((np.full(len(best), q[lo]), c[lo:hi][best], s[best], (seen | go).astype(np.int32), go))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names=["q", "c", "score", "done", "go"])

    def scored(pairs: DataFrame) -> DataFrame:
        x = pairs.groupBy("q", "c").agg(F.max("done").alias("done")).join(nodes.select(F.col("u").alias("c"), F.col("q").alias("v")), "c")
        return keep(x.select("q", "c", "done", "v").repartition(parts, "q").sortWithinPartitions("q").mapInArrow(run, "q long, c long, score float, done int, go boolean"), "beam")

    at = queries.select(F.col("u").alias("q"))
    beam = scored(at.select("q", F.col("q").alias("c"), F.lit(1).alias("done")).union(at.join(ways, at["q"] == ways["f"]).select("q", "c", F.lit(0).alias("done"))))
    for _ in range(STEPS):
        front = beam.filter("go").select("q", F.col("c").alias("f"))
        more = front.join(ways, "f").select("q", "c", F.lit(0).alias("done"))
        beam = scored(beam.select("q", "c", "done").union(more))
        free(spark)
        if beam.filter("go").isEmpty():
            break
    return beam.select("q", "c")


def nearest(df: DataFrame, every: int = 20, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the `top` found of all other rows."""
    rows = keep(_valid(df, id_col, vector_col), "vectors")
    reps = keep(rows.groupBy("v").agg(F.min("vec_id").alias("u")), "vector-nodes")
    held = keep(rows.join(reps, "v").select("u", "vec_id"), "vector-ids")
    first = Window.partitionBy("u").orderBy("vec_id")
    least = held.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= top + 1).drop("n")  # equal scores go to the smaller ids
    largest = F.array_max(F.transform("v", F.abs))
    middle = reps.agg(F.avg(F.log(largest)).alias("middle"))  # one row: scales are kept near 1, so that products stay in range

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                own = np.abs(x).max(axis=1)
                scale = np.exp(np.clip(np.log(own) - b.column(2).to_numpy(), -34, 34)) / 127
                x = np.rint(127 * (x / own[:, None])).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() + s.tobytes() for v, s in zip(x, scale.astype("<f4"), strict=True)], pa.binary())], names=["u", "q"])

    nodes = keep(reps.crossJoin(F.broadcast(middle)).select("u", "v", "middle").mapInArrow(shrink, "u long, q binary"), "vector-bytes")
    asked = held.filter(F.col("vec_id") % every == 0)
    found = search(nodes, build(nodes), asked.select("u").distinct())
    side = lambda a: reps.select(F.col("u").alias(a), F.col("v").alias(f"v{a}"))
    exact = found.join(side("q"), "q").join(side("c"), "c")
    dot = F.aggregate(F.zip_with("vq", "vc", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    exact = exact.select("q", "c", dot.alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    exact = exact.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top + 1).drop("n")
    out = asked.select(F.col("u").alias("q"), F.col("vec_id").alias("query_id")).join(exact, "q").join(least.withColumnRenamed("u", "c"), "c").filter("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
