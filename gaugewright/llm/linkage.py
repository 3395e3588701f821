"""Connected groups of a similarity relation that is given by shared keys and an exact check.

Three steps. index() finds the keys that two ids share, with index entries
packed as arrays, one row for a batch and bucket. contract() joins what is
plainly alike: each id is checked against the centre (least id) it shares most
keys with, then components against components drawn anew for each key, so a
large group of near copies becomes one component by a number of checks in
proportion to its rows. across() then compares ids of different components: the
members of a key are dealt into pieces of bounded bytes, pieces meet in pairs in
tasks of their own, and a task emits only those pairs that a cheap test of small
signatures leaves, so no link between two groups is lost and no table of all
pairs of a key is ever made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm import bytesets as B
from gaugewright.llm.store import drop, free, keep

Check = Callable[[DataFrame], DataFrame]  # pairs (a, b) -> those of them that are linked
PER_PACK = 150_000  # index entries that a task packs at once
PER_BUCKET = 250_000  # index entries that one task sorts
PIECE = 1 << 19  # bytes of the members of a key in one piece
SLAB = 1 << 20  # pairs that a task looks at at once
FEW = 64  # members of a key up to which keys are looked at together
#: Bytes of a key that go into the index beside its bucket: a bucket has about as many entries at every size of input, so the chance that two of its keys
#: look alike does not grow, and such keys only make candidates.
KEY = 5
SPREAD, SMALL = 1, 2  # flags of an entry
U = np.uint64


@dataclass
class Entries:
    """Index entries: key and id of each, the id's size, where in it the key stands, flags; and the ids that have joined a component, with it."""

    key: np.ndarray
    id: np.ndarray
    size: np.ndarray
    at: np.ndarray
    flags: np.ndarray
    moved: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def binaries(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data).view(dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def _planes(a: np.ndarray, width: int) -> np.ndarray:
    """The `width` low bytes of whole numbers, all first bytes before all second ones: bytes that seldom differ compress well in a shuffle."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1)[:, :width].T)


def _numbers(column: pa.Array, width: int, dtype: str) -> np.ndarray:
    """What _planes made into the rows of column."""
    data, n = binaries(column, "u1")
    n //= width
    end = np.cumsum(n)
    at = np.arange(end[-1]) + np.repeat((width - 1) * (end - n), n)
    step = np.repeat(n, n)
    out = np.zeros((end[-1], np.dtype(dtype).itemsize), np.uint8)
    for i in range(width):
        out[:, i] = data[at + i * step]
    return out.view(dtype).ravel()


def _paired(key: np.ndarray, value: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which entries have another of the same key whose value is at most `most` away: in order of values, the one before or after."""
    order = np.lexsort((value, key))
    k, v, m = key[order], value[order].astype(np.int64), most[order]
    near = (k[1:] == k[:-1]) & (v[1:] - v[:-1] <= np.maximum(m[1:], m[:-1]))
    out = np.zeros(len(k), bool)
    out[order[1:]] |= near
    out[order[:-1]] |= near
    return out


def index(df: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[Entries]], total: int, ratio: float, slip: float = np.inf) -> DataFrame:
    """key, id, size, at, small, comp, centre of every entry whose key is shared by two components, where
    another entry has a size within the factor `ratio` and a place within `slip` of its size.

    total: about how many entries there are. centre: the least id of the key (the entry's
    own, if sizes or places keep the two apart); null where an entry is marked SPREAD: such rows are dealt over all buckets, come out
    whether shared or not, and are for Spark to group."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PER_BUCKET + 1)
    buckets = 4 * parts  # so that tasks get about as many each

    def packed(held: list[Entries]) -> pa.RecordBatch:
        key, ids, size, at, flags = (np.concatenate([getattr(x, f) for x in held]) for f in ("key", "id", "size", "at", "flags"))
        moved = np.unique(np.concatenate([np.stack(x.moved, axis=1) for x in held]), axis=0).astype(np.int64)
        spread = flags & SPREAD > 0
        home = (key % U(buckets)).astype("<i4")
        bucket = np.where(spread, (B.mix(key ^ ids.view(U)) % U(buckets)).astype("<i4"), home)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))

        def pack(a: np.ndarray, width: int) -> pa.Array:
            a = a[order]
            return pa.array([_planes(a[cut[i] : cut[i + 1]], width).tobytes() for i in full], pa.binary())

        # a bucket gets the components of the ids in it, not of all
        place = np.minimum(np.searchsorted(moved[:, 0], ids[order]), len(moved) - 1)
        hit = moved[place, 0] == ids[order] if len(moved) else np.zeros(len(ids), bool)
        to = np.unique(bucket[order][hit].astype(np.int64) * len(moved) + place[hit])
        of = np.searchsorted(to, np.append(full, buckets) * len(moved))
        components = [moved[to[a:z] % len(moved)].tobytes() if z > a else b"" for a, z in zip(of[:-1], of[1:], strict=True)]
        cols = [pack(key >> U(64 - 8 * KEY), KEY), pack(ids, 8), pack(size.astype("<i4"), 4), pack(at.astype("<i4"), 4), pack(flags.astype("u1"), 1), pack(home, 4)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *cols, pa.array(components, pa.binary())], names=["bucket", "k", "c", "s", "p", "f", "h", "m"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for e in entries(b):
                held.append(e)
                n += len(e.key)
                if n >= PER_PACK:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        held = zip(*[[_numbers(b.column(i), w, t) for i, (w, t) in enumerate(((KEY, "u8"), (8, "i8"), (4, "<i4"), (4, "<i4"), (1, "u1"), (4, "<i4")), 1)] for b in parts], strict=True)
        key, ids, size, at, flags, home = map(np.concatenate, held)
        moved = np.concatenate([binaries(b.column(7), "i8")[0] for b in parts])
        key = key << U(63 - 8 * KEY) | home.astype(U)
        order = np.lexsort((ids, key))
        order = order[np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (ids[order][1:] != ids[order][:-1])))]
        key, ids, size, at, flags = (x[order] for x in (key, ids, size, at, flags))
        spread = flags & SPREAD > 0
        ok = _paired(key, size, (1 / ratio - 1) * size + 1e-6)
        if np.isfinite(slip):
            ok &= _paired(key, at, slip / ratio * size)  # a partner may be larger by 1 / ratio
        ok |= spread
        if not ok.any():
            return
        key, ids, size, at, flags = (x[ok] for x in (key, ids, size, at, flags))
        moved = np.unique(moved.reshape(-1, 2), axis=0)
        comp = ids.copy()
        if len(moved):
            place = np.minimum(np.searchsorted(moved[:, 0], ids), len(moved) - 1)
            comp = np.where(moved[place, 0] == ids, moved[place, 1], ids)
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
        mixed = np.minimum.reduceat(comp, head) < np.maximum.reduceat(comp, head)
        mixed &= np.bitwise_or.reduceat(flags, head) & SMALL > 0  # a pair needs an entry of its smaller set
        spread = spread[ok]
        out = mixed[run] | spread
        first = head[run]  # ids are in order within a key
        near = (np.minimum(size, size[first]) >= ratio * np.maximum(size, size[first])) & (np.abs(at - at[first]) <= slip * np.maximum(size, size[first]))
        least = np.where(near, ids[first], ids)[out]
        cols = [key[out].view(np.int64), ids[out], size[out], at[out], flags[out] & SMALL > 0, comp[out]]
        full = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(least, mask=spread[out])], names=["key", "id", "size", "at", "small", "comp", "centre"])
        for i in range(0, full.num_rows, 50_000):
            yield full.slice(i, 50_000)

    rows = df.mapInArrow(emit, "bucket int, k binary, c binary, s binary, p binary, f binary, h binary, m binary")
    return rows.repartition(parts, "bucket").mapInArrow(group, "key long, id long, size int, at int, small boolean, comp long, centre long")


def _same(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(id, comp): the least id reachable from each id by edges (a, b); ids without an edge are left out.

    Alternating large and small stars: each round is two map-side combined minima
    and two joins, and the number of rounds is logarithmic. No round gathers a
    component or the neighbours of a node in one place."""
    e = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while before != (before := _same(e)):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        new = keep(small.filter("a <> b").distinct(), label)
        drop(e)
        e = new
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def merge(comp: DataFrame | None, links: DataFrame, label: str) -> DataFrame:
    """comp (id, comp) after links (a, b) between ids; ids that no link has named yet are their own component."""
    if comp is None:
        return keep(components(links, label), label)
    side = lambda x: comp.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
    named = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(named, label).select(F.col("id").alias("comp"), F.col("comp").alias("into"))
    every = comp.unionByName(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left_anti").select("id", F.col("id").alias("comp")))
    return keep(every.join(merged, "comp", "left").select("id", F.coalesce("into", "comp").alias("comp")), label)


def contract(shared: DataFrame, check: Check, ratio: float, label: str, slip: float = np.inf, rounds: int = 1) -> DataFrame:
    """(id, comp) of the ids that checks against centres and drawn components have linked.

    Rounds end when one finds no link, or after `rounds`: they only spare work, the
    links that they leave are found by across()."""
    spread = shared.filter("centre is null")
    centres = spread.groupBy("key").agg(F.min("id").alias("centre"))
    star = shared.filter("centre is not null").select("id", "centre").union(spread.select("key", "id").join(centres, "key").select("id", "centre"))
    star = star.filter("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("n"))
    best = star.groupBy("id").agg(F.max(F.struct("n", F.negate("centre").alias("c"))).alias("x"))
    links = keep(check(best.select(F.col("id").alias("a"), F.negate("x.c").alias("b"))), f"{label}-star")
    comp = merge(None, links, f"{label}-comp")
    drop(links)
    for r in range(rounds):
        rows = shared.select("key", "id", "size", "at").join(comp, "id", "left").select("key", "id", "size", "at", F.coalesce("comp", "id").alias("comp"))
        draw = F.struct(F.xxhash64("key", "comp", F.lit(r)).alias("d"), "comp", "id", "size", "at")
        larger, smaller = F.greatest("size", "lo.size"), F.least("size", "lo.size")
        near = (smaller >= ratio * larger) & (F.abs(F.col("at") - F.col("lo.at")) <= slip * larger)
        mixed = rows.groupBy("key").agg(F.min(draw).alias("lo"), F.min("comp").alias("a"), F.max("comp").alias("z")).filter("a < z").select("key", "lo")
        tries = rows.join(mixed, "key").filter("comp <> lo.comp").filter(near).groupBy("comp", F.col("lo.comp").alias("other")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", F.col("lo.id").alias("centre"))).alias("p"))
        # each component tries the other with which it shares most of the drawn keys
        most = Window.partitionBy("comp").orderBy(F.desc("n"), "other")
        tries = tries.withColumn("k", F.row_number().over(most)).filter("k = 1")
        links = keep(check(tries.select(F.col("p.id").alias("a"), F.col("p.centre").alias("b"))), f"{label}-round")
        last, old = links.isEmpty(), comp
        if not last:
            comp = merge(old, links, f"{label}-comp")
            drop(old)
        drop(links)
        free(shared.sparkSession)
        if last:
            break
    return comp


def settle(pairs: DataFrame, comp: DataFrame, check: Check, label: str, rounds: int = 2) -> DataFrame:
    """(id, comp) after every link among pairs (a, b).

    A round tries one pair for each component, with the one that it shares most pairs
    with; pairs that have come into one component need no check then, and all that
    are still open after the rounds are checked. A table of pairs goes as soon as the next one is written."""

    def still_open(pairs: DataFrame) -> DataFrame:
        side = lambda x: comp.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
        named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        return named.filter("ca <> cb")

    for r in range(rounds):
        left = keep(still_open(pairs), f"{label}-open")
        drop(pairs)
        both = left.select("a", "b", F.col("ca").alias("c"), F.col("cb").alias("other")).union(left.select("a", "b", F.col("cb").alias("c"), F.col("ca").alias("other")))
        shared = both.groupBy("c", "other").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("a", "b", F.lit(r)).alias("d"), "a", "b")).alias("p"))
        tried = keep(shared.groupBy("c").agg(F.max(F.struct("n", F.negate("other"), "p")).alias("x")).select("x.p.a", "x.p.b").distinct(), f"{label}-tried")
        links = keep(check(tried), f"{label}-tried-links")
        old, comp = comp, merge(comp, links, f"{label}-comp")
        pairs = keep(left.select("a", "b").join(tried, ["a", "b"], "left_anti"), f"{label}-untried")
        for x in (left, tried, links, old):
            drop(x)
    links = keep(check(still_open(pairs).select("a", "b")), f"{label}-links")
    drop(pairs)
    return merge(comp, links, f"{label}-comp")


@dataclass
class Members:
    """Of one piece of a key."""

    id: np.ndarray
    comp: np.ndarray
    size: np.ndarray
    at: np.ndarray
    small: np.ndarray
    sig: np.ndarray  # bytes of all signatures
    start: np.ndarray  # where each begins in sig
    width: np.ndarray  # how many bytes it has


#: Members x and y, and the numbers i, j in them of the pairs to test -> which pairs may be linked.
Test = Callable[[Members, Members, np.ndarray, np.ndarray], np.ndarray]


def _flat(column: pa.Array) -> tuple[Members, np.ndarray]:
    """The members of all rows, and where each row's begin."""
    flat = column.flatten()
    cut = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    of = {flat.type.field(i).name: x for i, x in enumerate(flat.flatten())}
    sig, width = binaries(of["sig"], "u1")
    cols = [of[x].to_numpy(zero_copy_only=False) for x in ("id", "comp", "size", "at", "small")]
    return Members(*cols, sig, np.cumsum(width) - width, width), cut


def _part(m: Members, a: int, z: int) -> Members:
    return Members(*(x[a:z] for x in (m.id, m.comp, m.size, m.at, m.small)), m.sig, m.start[a:z], m.width[a:z])


def _members(column: pa.Array) -> list[Members]:
    m, cut = _flat(column)
    return [_part(m, a, z) for a, z in zip(cut[:-1], cut[1:], strict=True)]


def _candidates(x: Members, y: Members, same: bool, ratio: float, slip: float, test: Test) -> tuple[np.ndarray, np.ndarray]:
    out = []
    step = max(1, SLAB // max(1, len(y.id)))
    for a in range(0, len(x.id), step):
        s = slice(a, a + step)
        p, q = x.size[s, None].astype(float), y.size[None, :].astype(float)
        ok = (x.comp[s, None] != y.comp[None, :]) & (p * ratio <= q) & (q * ratio <= p)
        if np.isfinite(slip):
            ok &= np.abs(x.at[s, None] - y.at[None, :]) <= slip * np.maximum(p, q)
        ok &= np.where(p < q, x.small[s, None], np.where(p > q, y.small[None, :], x.small[s, None] | y.small[None, :]))
        if same:
            ok &= np.arange(len(y.id))[None, :] > np.arange(a, min(a + step, len(x.id)))[:, None]
        i, j = np.nonzero(ok)
        if len(i):
            i = i + a
            may = test(x, y, i, j)
            p, q = x.id[i[may]], y.id[j[may]]
            out.append((np.minimum(p, q), np.maximum(p, q)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _within_keys(m: Members, cut: np.ndarray, ratio: float, slip: float, test: Test) -> list[tuple[np.ndarray, np.ndarray]]:
    """_candidates of each key's members among themselves: keys of a few members, which most are, many at once."""
    n = np.diff(cut)
    found = [_candidates(x := _part(m, cut[g], cut[g + 1]), x, True, ratio, slip, test) for g in np.flatnonzero(n > FEW).tolist()]
    end = np.repeat(np.where(n > FEW, cut[:-1], cut[1:]), n)
    partners = np.maximum(end - np.arange(len(end)) - 1, 0)  # those behind a member in its key
    total = np.concatenate(([0], np.cumsum(partners)))
    a = 0
    while a < len(end):
        z = max(a + 1, int(np.searchsorted(total, total[a] + SLAB // 8, side="right")) - 1)
        k = partners[a:z]
        i = np.repeat(np.arange(a, z), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[a:z] - total[a], k)
        p, q = m.size[i].astype(float), m.size[j].astype(float)
        ok = (m.comp[i] != m.comp[j]) & (p * ratio <= q) & (q * ratio <= p) & np.where(p < q, m.small[i], np.where(p > q, m.small[j], m.small[i] | m.small[j]))
        if np.isfinite(slip):
            ok &= np.abs(m.at[i] - m.at[j]) <= slip * np.maximum(p, q)
        i, j = i[ok], j[ok]
        if len(i):
            may = test(m, m, i, j)
            p, q = m.id[i[may]], m.id[j[may]]
            found.append((np.minimum(p, q), np.maximum(p, q)))
        a = z
    return found


def across(rows: DataFrame, comp: DataFrame | None, sigs: Callable[[DataFrame], DataFrame], width: Column, ratio: float, test: Test, label: str, slip: float = np.inf) -> DataFrame:
    """Pairs (a, b) of ids in different components that share a key, have sizes within the factor `ratio`, places of it
    within `slip` of the larger size, an entry of the smaller one marked small, and pass the test.

    rows: key, id, size, at, small (and comp, if `comp` is None), dropped as soon as its rows are dealt if keep() made it; comp: id, comp;
    sigs: (wanted ids) -> id, sig; width: bounds a signature's bytes."""
    given = rows
    if comp is not None:
        rows = rows.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rows = keep(rows.select("key", "id", "size", "at", "small", "comp", width.alias("bytes")), f"{label}-rows")
    drop(given)
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.sum(F.col("bytes") + 32) / PIECE).alias("pieces")).filter("lo < hi")
    mixed = keep(rows.join(keys.select("key", "pieces"), "key").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))), f"{label}-mixed")
    drop(rows)
    sig = sigs(mixed.select("id").distinct())
    beside = F.collect_list(F.struct("id", "comp", "size", "at", "small", "sig"))  # PIECE bytes, as dealt
    packed = lambda rows: rows.join(sig, "id").groupBy("key", "piece").agg(beside.alias("m"))
    packs = keep(packed(mixed.filter("pieces > 1")), f"{label}-packs")  # only keys of many pieces are joined to themselves
    x = packs.select("key", F.col("piece").alias("p"), F.col("m").alias("x")).join(packs.select("key", F.col("piece").alias("q"), F.col("m").alias("y")), "key").filter("p <= q").select("p", "q", "x", "y")

    def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            both = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["a", "b"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pairs(_within_keys(*_flat(b.column(0)), ratio, slip, test))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _members(b.column(2)), _members(b.column(3)), strict=True)
            yield from pairs([_candidates(xs, ys, p == q, ratio, slip, test) for p, q, xs, ys in rows])

    found = packed(mixed.filter("pieces = 1")).select("m").mapInArrow(alone, "a long, b long").union(x.mapInArrow(compare, "a long, b long"))
    out = keep(found.distinct(), f"{label}-pairs")
    drop(packs)
    drop(mixed)
    return out
