"""Alignment of two tokenizers: which of their tokens cover the same bytes, and how often ids meet in a corpus.

A text with a space before it is encoded by a byte-level BPE (A) and a piece
vocabulary (B). Every byte gets a label: no token ends there, one of A does, one
of B does, or both do. A regular expression scans the label string for spans up
to each both-label; the labels in a span count the tokens of its group. A text's
groups give its linked id pairs with their multiplicity; those rows are written
once, and everything corpus-wide is joins and sums over them:

* the documents that hold a pair are counted by pair;
* each A id's highest count is a table no longer than A's vocabulary, and broadcast;
* counts go back to the documents' rows by a join on the pair. A pair that stands
  in more than 1/HOT_PAIRS of all rows comes from a broadcast table, which such
  a share bounds at HOT_PAIRS rows; all other pairs are shuffled, and none of those
  is hot. Both ways give the same sums.

Within a group only distinct ids are paired, with the product of their numbers, so
a long group of repeated tokens costs no more than its distinct pairs, at most
the product of the vocabularies.

Defined cases: texts that are null or empty, or whose joined A or B bytes are not
the text with its space (a marker that stands in the text itself), have no tokens
and zeros; strings of special tokens are plain text; texts of any length are read
whole; rows that repeat an id are documents of their own; ties for the highest
count are all best; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from gaugewright.llm import bpe
from gaugewright.llm.pieces import Pieces, blocks, pieces, segment
from gaugewright.llm.store import drop, keep

BLOCK_BYTES = 2_000_000  # of text whose arrays are held at once
HOT_PAIRS = 1 << 17  # rows of the broadcast table at most
SLICE = 1 << 20  # pairs of long groups that are spread out at once
GROUP = re.compile(rb"[^3]*3")  # labels: 0 none, 1 A-end, 2 B-end, 3 both
PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())])
LINK = StructType().add("a", "integer").add("b", "integer").add("times", "long")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


@lru_cache(maxsize=4)
def _decimals(size: int, between: str, last: str) -> tuple[np.ndarray, np.ndarray]:
    return np.array([f"{i}{between}" for i in range(size)], object), np.array([f"{i}{last}" for i in range(size)], object)


def _bytes(flat: np.ndarray, offset: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    n = lengths[ids]
    end = np.cumsum(n)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(offset[ids] - (end - n), n)]


def _ends(lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of each token in the joined bytes of all texts, and of each text."""
    end = np.cumsum(lengths)
    return end, np.append(0, end)[begin]


def _faithful(texts: pa.Array, *sides: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which texts equal the joined bytes of each side (all bytes, and where each text's begin)."""
    data = texts.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw, ok = np.frombuffer(data.buffers()[2], np.uint8), np.ones(len(texts), bool)
    for joined, at in sides:
        same = np.diff(at) == np.diff(offsets)
        ok &= [bool(s) and np.array_equal(joined[at[i] : at[i + 1]], raw[offsets[i] : offsets[i + 1]]) for i, s in enumerate(same)]
    return ok


def groups(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The end of each span up to a both-label, and how many tokens of A and of B end in it."""
    end = np.cumsum(np.fromiter(map(len, GROUP.findall((labels + 48).tobytes())), np.int64))
    many = [np.diff(np.cumsum(labels & bit > 0)[end - 1], prepend=0) for bit in (1, 2)]
    return end, *many


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group with their numbers, by group."""
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def _sum(text: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each text and pair (20 bits each for ids; a text's number fits in what is left)."""
    key, at = np.unique(text << 40 | a << 20 | b, return_inverse=True)
    return key >> 40, key >> 20 & 0xFFFFF, key & 0xFFFFF, np.bincount(at, weights=times).astype(np.int64) if len(key) else times[:0]


def linked(text: np.ndarray, ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, A id, B id and number of links of each distinct pair of each text; text: of each group, ga and gb: group of each token."""
    one = (na == 1) & (nb == 1)
    found = [_sum(text[ga[one[ga]]], a[one[ga]], b[one[gb]], np.ones(int(one.sum()), np.int64))]
    g, x, nx = _distinct(ga[~one[ga]], a[~one[ga]])
    h, y, ny = _distinct(gb[~one[gb]], b[~one[gb]])
    first, last = np.searchsorted(h, g), np.searchsorted(h, g, side="right")  # each distinct A id of a group meets its distinct B ids
    size = np.cumsum(last - first)
    at = 0
    while at < len(g):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        n = (last - first)[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        end = np.cumsum(n)
        j = np.arange(end[-1]) + np.repeat(first[at:stop] - (end - n), n)
        found.append(_sum(text[g[i]], x[i], y[j], nx[i] * ny[j]))
        at = stop
    return _sum(*map(np.concatenate, zip(*found, strict=True))) if len(found) > 1 else found[0]


def digests(begin: np.ndarray, text: np.ndarray, ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, sizes: tuple[int, int]) -> list[str]:
    """SHA-256 of each text's groups in decimals; begin: of each text's groups."""
    out = np.empty(len(a) + len(b), object)
    ca, cb = np.cumsum(na), np.cumsum(nb)
    for at, ids, group, through, (between, last) in (
        (np.arange(len(a)) + (cb - nb)[ga], a, ga, ca, _decimals(sizes[0], ",", "|")),
        (np.arange(len(b)) + ca[gb], b, gb, cb, _decimals(sizes[1], ",", ";")),
    ):
        out[at] = between[ids]
        closing = through - 1
        out[at[closing]] = last[ids[closing]]
    cut = np.append(0, ca + cb)[begin]
    return [hashlib.sha256("".join(out[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _select(ids: np.ndarray, begin: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(begin)
    return ids[np.repeat(ok, n)], np.append(0, np.cumsum(n[ok]))


def block(v: bpe.Vocabulary, p: Pieces, texts: pa.Array) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, ...]]]:
    """COUNTS of each text (a row of four), the groups' digest, and each text's pairs."""
    counts, digest = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    nothing = tuple(np.zeros(0, np.int64) for _ in range(3))
    pairs = [nothing] * len(texts)
    live = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    if not len(live):
        return counts, digest, pairs
    taken = texts.take(pa.array(live)) if len(live) < len(texts) else texts
    spaced = pc.binary_join_element_wise(pa.scalar(" "), taken, "")
    a, at = bpe.encode_block(v, spaced, led=True)
    b, bt = segment(p, taken)
    sides = [(_bytes(v.flat, v.offset, v.lengths, a), _ends(v.lengths[a], at)[1]), (p.joined(b), _ends(p.lengths[b], bt)[1])]
    ok = _faithful(spaced, *sides)
    del sides
    if not ok.all():
        a, at = _select(a, at, ok)
        b, bt = _select(b, bt, ok)
        live = live[ok]
    if not len(live):
        return counts, digest, pairs
    (ea, ta), (eb, _) = _ends(v.lengths[a], at), _ends(p.lengths[b], bt)
    labels = np.zeros(int(ta[-1]), np.uint8)
    labels[ea - 1] = 1
    labels[eb - 1] |= 2
    end, na, nb = groups(labels)
    del labels
    text = np.searchsorted(ta, end, side="left") - 1
    ga, gb = np.repeat(np.arange(len(end)), na), np.repeat(np.arange(len(end)), nb)
    begin = np.searchsorted(text, np.arange(len(live) + 1))
    links = np.append(0, np.cumsum(na * nb))
    counts[live] = np.stack([np.diff(at), np.diff(bt), np.diff(begin), np.diff(links[begin])], axis=1)
    for i, d in zip(live.tolist(), digests(begin, text, ga, a, gb, b, na, nb, (v.size, len(p.lengths))), strict=True):
        digest[i] = d
    t, x, y, times = linked(text, ga, a, gb, b, na, nb)
    cut = np.searchsorted(t, np.arange(len(live) + 1))
    for k, i in enumerate(live.tolist()):
        pairs[i] = tuple(z[cut[k] : cut[k + 1]] for z in (x, y, times))
    return counts, digest, pairs


def tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: its number, doc_id, COUNTS, groups_sha256 and its linked pairs (a, b, times)."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = src.select("row", "doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("groups_sha256", "string").add("links", ArrayType(LINK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = bpe.vocabulary(path_a, special=False), pieces(path_b)
        if max(v.size, len(p.lengths)) > 1 << 20:
            raise ValueError("ids of more than 20 bits")
        for batch in batches:
            for at, stop in blocks(batch.column(2), BLOCK_BYTES):
                part = batch.slice(at, stop - at)
                counts, digest, pairs = block(v, p, part.column(2))
                x, y, times = (np.concatenate([q[k] for q in pairs]) for k in range(3))
                offsets = np.append(0, np.cumsum([len(q[0]) for q in pairs])).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(times)], fields=list(PAIR))
                cols = [part.column(0), part.column(1), *map(pa.array, counts.T), pa.array(digest, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), rows)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked) and best (n is the highest of its A id): one row for each pair."""
    n = keep(aligned.select(F.explode("links").alias("l")).groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    top = n.groupBy("a").agg(F.max("n").alias("top"))  # no longer than the vocabulary
    return n.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, COUNTS, n_best, count_sum and groups_sha256: one row for each row of docs."""
    aligned = keep(tokens(docs, path_a, path_b, id_col), "aligned")
    known = keep(pair_counts(aligned), "pairs")
    rows = aligned.select("row", F.explode("links").alias("l")).select("row", "l.*")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * HOT_PAIRS > total
    hot = F.broadcast(known.filter(often))
    weigh = lambda found: found.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    add = lambda found: found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    both = add(weigh(rows.join(hot, ["a", "b"]))).union(add(weigh(rows.join(hot, ["a", "b"], "left_anti").join(known.filter(~often), ["a", "b"]))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = aligned.drop("links").join(add(both), "row", "left").select("doc_id", *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")
    return out


__all__ = ["align", "block", "drop", "groups", "linked", "pair_counts", "tokens"]
