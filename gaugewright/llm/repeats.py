"""Repeated strings of the corpus, by sampled suffixes with the length of their earlier matches.

A string of `length` bytes that occurs twice starts two suffixes which agree to
that depth. Instead of one suffix array over the corpus (which no executor could
hold), suffixes are compared in groups that any two such must share: of the
64-byte grams in a string, the one with the least hash, its anchor, depends on
the string alone, so equal strings have equal anchors at equal offsets. Each
text is cut into blocks, the runs of strings with one anchor (about two in
`length` bytes). Blocks that are equal as a whole settle all their strings at
once; only where a gram has blocks that differ are the blocks' bytes brought
together, and their suffixes put in order of their first `length` bytes (by
64-bit fingerprints). In that order the suffixes with an equal prefix stand
together, by position: a neighbour that is smaller is an earlier match, a
neighbour that is larger a later one; a string with neither is unique.

Texts are known by fingerprint, so equal texts are compared once. All groupings
by gram and block are map-side combined aggregations and joins that Spark can
split; groups of HOT_BLOCKS differing blocks and more send single fingerprints
instead of bytes, which spread over all tasks.

Defined cases: null and empty texts have nothing to remove; texts shorter than
`length` have no string; equal rows are copies of each other, so all of them go;
with keep_first the bytes of a string's first occurrence (by least doc_id of the
text, then position) stay; bytes are cut on the input, whatever UTF-8 sequence
they belong to; extra columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm import bytesets as B
from gaugewright.llm.store import keep

LENGTH, GRAM = 400, 64
HOT_BLOCKS = 50_000
U = np.uint64
_POS = U((1 << 31) - 1)  # places in a text: an Arrow string has fewer bytes than this


def text_marks(c: B.Chunk, prefix: np.ndarray) -> np.ndarray:
    """Fingerprint of each text of a chunk."""
    return B.mix(B.spans(prefix, c.start, c.stop) + U(1))


def blocks(c: B.Chunk, prefix: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each block: text, first and last string start in the chunk, gram hash, block hash."""
    n = len(c.buf)
    k = min(GRAM, length)
    w = length - k + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    at = np.arange(n - k + 1)
    gram = B.spans(prefix, at, at + k)
    v = (gram & ~_POS) | at.astype(U)
    count = -(-len(v) // w) * w
    v = np.concatenate((v, np.full(count - len(v), U(2**64 - 1)))).reshape(-1, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - length + 1)
    anchor = (np.minimum(behind[p], ahead[p + w - 1]) & _POS).astype(np.int64)
    long = c.stop - c.start >= length
    valid = np.zeros(len(p) + 1, np.int64)
    np.add.at(valid, c.start[long], 1)
    np.add.at(valid, np.minimum(c.stop[long] - length + 1, len(p)), -1)
    valid = np.cumsum(valid)[:-1] > 0
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    head[c.start[long]] = True
    lo = np.flatnonzero(head)
    tail = valid.copy()
    tail[:-1] &= ~valid[1:] | head[1:]
    hi = np.flatnonzero(tail)
    h = gram[anchor[lo]]
    whole = B.mix(B.spans(prefix, lo, hi + length) + (anchor[lo] - lo).astype(U) * U(0x9FB21C651E98DF25))
    return c.owner(lo), lo, hi, h, whole


def _table(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if x.dtype == U else x) for x in cols], names=names.split())


def _marks(docs: DataFrame, id_col: str) -> DataFrame:
    """doc_id, fp, n_bytes, sha256 of each row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n, sha = [], [], []
            for c in B.chunks(b.column(1)):
                fp.append(text_marks(c, c.prefix()))
                n.append(c.stop - c.start)
                sha += [hashlib.sha256(c.buf[s:e]).hexdigest() for s, e in zip(c.start, c.stop, strict=True)]
            if fp:
                yield _table("doc_id fp n_bytes sha", b.column(0), np.concatenate(fp), np.concatenate(n), pa.array(sha))

    return src.mapInArrow(run, src.select("doc_id").schema.add("fp", "long").add("n_bytes", "long").add("sha", "string"))


def _blocks(docs: DataFrame, length: int) -> DataFrame:
    """h, whole, fp, lo, hi (string starts in the text) of each block; equal texts of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in B.chunks(b.column(0)):
                prefix = c.prefix()
                who, lo, hi, h, whole = blocks(c, prefix, length)
                fp = text_marks(c, prefix)
                _, first = np.unique(fp, return_index=True)
                once = np.isin(who, first)
                who, lo, hi, h, whole = (x[once] for x in (who, lo, hi, h, whole))
                yield _table("h whole fp lo hi", h, whole, fp[who], lo - c.start[who], hi - c.start[who])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, whole long, fp long, lo long, hi long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, text of the wanted texts, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [text_marks(c, c.prefix()) for c in B.chunks(b.column(0))]
            if fp:
                yield _table("fp text", np.concatenate(fp), b.column(0))

    every = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").mapInArrow(run, "fp long, text string")
    return every.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.any_value("text").alias("text"))


def _asked(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """h, fp, ord, lo and the bytes of each block asked for."""
    by = asked.groupBy("fp", "ord").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("want"))  # a text's own blocks
    rows = by.join(texts, "fp").select("fp", "ord", "want.h", "want.lo", "want.hi", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, ord_, hs, los, his, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                data = text.encode()
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array([fp] * len(hs), pa.int64()), pa.array([ord_] * len(hs), pa.int64()), pa.array(los, pa.int64()), pa.array([data[x : y + length] for x, y in zip(los, his, strict=True)], pa.binary())], names=["h", "fp", "ord", "lo", "bytes"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for r in run(batches):
            held.append(r)
            n += r.num_rows
            if n >= 2000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return rows.mapInArrow(merged, "h long, fp long, ord long, lo long, bytes binary")


def _suffixes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Of each string in a batch of blocks: fingerprint, fp, ord, start."""
    out = []
    data = batch.column("bytes")
    sizes = np.array([len(x.as_buffer()) for x in data], np.int64)
    fp, order, lo = (batch.column(x).to_numpy() for x in ("fp", "ord", "lo"))
    i = 0
    while i < len(sizes):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), B.CHUNK)))
        buf = np.frombuffer(b"".join(x.as_py() for x in data.slice(i, j - i)), np.uint8)
        c = B.Chunk(slice(i, j), buf, np.zeros(0), np.zeros(0))
        n = sizes[i:j] - length + 1
        end = np.cumsum(n)
        within = np.arange(end[-1]) - np.repeat(end - n, n)
        p = within + np.repeat(np.cumsum(sizes[i:j]) - sizes[i:j], n)
        out.append((B.spans(c.prefix(), p, p + length), np.repeat(fp[i:j], n), np.repeat(order[i:j], n), within + np.repeat(lo[i:j], n)))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U),) + (np.zeros(0, np.int64),) * 3


def _matches(asked: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """fp, lo, hi: runs of string starts with another (keep_first: an earlier) match among the blocks of their gram."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_suffixes(b, length) for b in batches if b.num_rows]
        if not found:
            return
        suffix, fp, rank, at = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((at, fp, rank, suffix))
        suffix, fp, at = suffix[by], fp[by], at[by]
        same = suffix[1:] == suffix[:-1]
        other = same & ((fp[1:] != fp[:-1]) | (at[1:] != at[:-1]))
        hit = np.zeros(len(suffix), bool)
        hit[1:] = other  # the previous smaller position in suffix order
        if not keep_first:
            hit[:-1] |= other  # the next one
        by = np.lexsort((at[hit], fp[hit]))
        fp, at = fp[hit][by], at[hit][by]
        if len(fp):
            head = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (at[1:] > at[:-1] + 1))))
            yield _table("fp lo hi", fp[head], at[head], at[np.append(head[1:], len(at)) - 1])

    return asked.repartition(parts, "h").mapInArrow(order, "fp long, lo long, hi long")


def _hot_matches(asked: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """As _matches, for grams with so many differing blocks that their suffixes must spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _table("suffix fp ord lo", *_suffixes(b, length))

    s = asked.mapInArrow(run, "suffix long, fp long, ord long, lo long")
    where = F.struct("ord", "fp", "lo")
    ends = s.groupBy("suffix").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first <> last")
    out = s.join(ends, "suffix")
    if keep_first:
        out = out.filter(where != F.col("first"))
    return out.select("fp", "lo", F.col("lo").alias("hi"))


def repeated(docs: DataFrame, id_col: str = "doc_id", length: int = LENGTH, keep_first: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked for) of each row of docs."""
    marks = keep(_marks(docs, id_col), "repeats-marks")
    copies = marks.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.coalesce(F.min("doc_id"), F.lit(-1)).cast("long").alias("ord"))
    every = keep(_blocks(docs, length).join(copies.select("fp", "ord"), "fp"), "repeats-blocks")
    where = F.struct("ord", "fp", "lo", "hi")
    classes = keep(every.groupBy("h", "whole").agg(F.min(where).alias("first"), F.max(where).alias("last")), "repeats-classes")
    settled = every.join(classes.filter("first <> last").select("h", "whole", "first"), ["h", "whole"])
    if keep_first:
        settled = settled.filter(where != F.col("first"))
    settled = settled.select("fp", "lo", "hi")
    differing = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    asked = keep(classes.join(differing, "h").select("h", "n", "first.fp", "first.ord", "first.lo", "first.hi"), "repeats-asked")
    texts = keep(_texts(docs, settled.select("fp").union(asked.select("fp")).distinct()), "repeats-texts")
    runs = settled.unionByName(_matches(_asked(texts, asked.filter(F.col("n") < HOT_BLOCKS), length), length, keep_first))
    runs = runs.unionByName(_hot_matches(_asked(texts, asked.filter(F.col("n") >= HOT_BLOCKS), length), length, keep_first))
    by = runs.groupBy("fp").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))  # a text's own runs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for fp, los, his, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, np.array(los, np.int64), 1)
                np.add.at(edge, np.array(his, np.int64) + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                rest = data[~gone].tobytes()
                out.append((fp, int(gone.sum()), int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum()), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())], names=["fp", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = by.join(texts, "fp").select("fp", "r.lo", "r.hi", "text").mapInArrow(cut, "fp long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rows = marks.join(done, "fp", "left")
    zero = F.lit(0).cast("long")
    if keep_first:
        # of equal texts, the row with the least id keeps what the text keeps; the others go whole (ties: all rows of that id keep it)
        rows = rows.join(copies, "fp", "left")
        gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length) & (F.coalesce("doc_id", F.lit(-1)) != F.col("ord"))
    else:
        rows = rows.join(copies.select("fp", "copies"), "fp", "left")
        gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = [F.col("doc_id"), F.col("n_bytes"), F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
           F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
           F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    if with_text:
        out.append(F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return rows.select(*out)
