"""Byte-fallback piece encoding by a distinct-chunk table.

White space is a marker (U+2581) in a piece vocabulary, and no piece of the usual
ones holds a marker behind another character. So merges never run over the start
of a marked word: a text falls into chunks, each a run of markers with the word
behind it, that are segmented apart. Newlines cut as well where no piece of
several characters holds one. A block of texts has one table of its distinct
chunks: the library segments each of them once, and their ids are joined back to
every position by the chunk's number. Blocks hold BLOCK_BYTES of text, so tables
stay bounded whatever the input; words repeat so much within a block that a table
of the whole corpus, with a shuffle of all words, would save next to nothing.

A vocabulary whose pieces cross markers, that changes texts before it segments
them, or that is no BPE is not cut: each distinct text is a chunk of its own.

Defined cases: a null or empty text has no pieces and decodes to nothing; markers
that stand in a text itself are taken as spaces, as the library does, and decode
to spaces; texts of any length are segmented whole; repeated rows are encoded
each; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from sentencepiece import sentencepiece_model_pb2

from gaugewright.llm import bytesets as B

MARKER = "▁"
BLOCK_BYTES = 6_000_000  # of text whose distinct chunks share a table
PREFIXED, AFTER_NEWLINE = 0, 1  # chunks whose marker the library puts before them; those it puts one too many before
# Types of pieces and of models in the public format of such vocabularies.
CONTROL, USER_DEFINED, BYTE, BPE = 3, 4, 6, 2


class Pieces:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        named = [(p.piece, p.type) for p in spec.pieces]
        crossing = any(MARKER in p.lstrip(MARKER) for p, kind in named if kind != BYTE)
        plain = not spec.normalizer_spec.precompiled_charsmap and not spec.normalizer_spec.remove_extra_whitespaces
        plain = plain and spec.normalizer_spec.add_dummy_prefix and not spec.trainer_spec.treat_whitespace_as_suffix
        kinds = {kind for _, kind in named}
        self.lossless = plain and BYTE in kinds and USER_DEFINED not in kinds
        marker = self.library.piece_to_id(MARKER)
        self.cuts = self.lossless and not crossing and spec.trainer_spec.model_type == BPE and not self.library.is_unknown(marker)
        self.newline_cuts = not any("\n" in p for p, _ in named if len(p) > 1)
        self.marker = marker
        surface = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARKER, " ").encode() for p, kind in named]
        self.lengths = np.array([len(b) for b in surface], np.int64)
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.offset = np.cumsum(self.lengths) - self.lengths
        self.decimal = np.array([str(i) for i in range(len(surface))], object)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, markers as spaces, end to end."""
        n = self.lengths[ids]
        end = np.cumsum(n)
        return self.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(self.offset[ids] - (end - n), n)]

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode gives: without the space that encoding put in front."""
        if not self.lossless:
            return self.library.decode(ids.tolist())
        out = self.joined(ids)
        return out[1 if len(out) and out[0] == 32 else 0 :].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def cut(p: Pieces, c: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, kind and text of each chunk; the marker that the library will put there again is left out."""
    buf, n = c.buf, len(c.buf)
    wide = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) if n > 2 else np.zeros(0, np.int64)
    size = (buf == 32).astype(np.int8)  # bytes of the marker that begins here
    size[wide] = 3
    marked = size > 0
    for k in (1, 2):
        marked[wide + k] = True
    first = np.zeros(n, bool)
    first[c.start[c.start < c.stop]] = True
    inner = np.zeros(n, bool)
    if p.cuts:
        inner[1:] = (size[1:] > 0) & ~marked[:-1]
        if p.newline_cuts:
            inner[1:] |= (buf[1:] == 10) & (buf[:-1] != 10)
        inner[c.stop] = False
    s = np.flatnonzero(first | inner)
    who = c.owner(s)
    e = np.minimum(np.append(s[1:], n), c.stop[who])
    kind = np.where(~first[s] & (buf[s] == 10), AFTER_NEWLINE, PREFIXED)
    return np.where(first[s], s, s + size[s]), e, kind, who


def segment(p: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts of a column, and where each text's begin (and a last end)."""
    hashes, where, owners, sources, base = [], [], [], [], 0
    for c in B.chunks(column):
        s, e, kind, who = cut(p, c)
        hashes.append(B.mix(B.spans(c.prefix(), s, e) + kind.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
        where.append(np.stack([np.full(len(s), len(sources)), s, e, kind]))
        owners.append(who + base)
        sources.append(memoryview(c.buf))
        base += len(c.start)
    if not base:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    owner, w = np.concatenate(owners), np.concatenate(where, axis=1)
    _, example, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    k, s, e, kind = w[:, example]
    table = p.library.encode([str(sources[i][x:y], "utf-8") for i, x, y in zip(k.tolist(), s.tolist(), e.tolist(), strict=True)], num_threads=1)
    n = np.fromiter(map(len, table), np.int64, len(table))
    ids = np.append(np.fromiter(chain.from_iterable(table), np.int64, int(n.sum())), p.marker)
    begin = np.cumsum(n) - n
    alone = (s == e) & (kind == PREFIXED)  # the library puts no marker before nothing
    begin[alone], n[alone] = len(ids) - 1, 1
    begin[kind == AFTER_NEWLINE] += 1
    n[kind == AFTER_NEWLINE] -= 1
    length = n[number]
    end = np.cumsum(length)
    out = ids[np.arange(end[-1] if len(end) else 0) + np.repeat(begin[number] - (end - length), length)]
    count = np.bincount(owner, weights=length, minlength=base).astype(np.int64)
    return out, np.concatenate(([0], np.cumsum(count)))


def blocks(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text, one row at least."""
    size, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield at, stop
        at = stop


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids: one row for each row of docs."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = src.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        digest = lambda data: hashlib.sha256(data.encode()).hexdigest()
        for b in batches:
            for at, stop in blocks(b.column(1), BLOCK_BYTES):
                flat, begin = segment(p, b.column(1).slice(at, stop - at))
                ids = [flat[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
                cols = [b.column(0).slice(at, stop - at), pa.array(np.diff(begin))]
                cols += [pa.array([digest(",".join(p.decimal[i])) for i in ids], pa.string()), pa.array([digest(p.decode(i)) for i in ids], pa.string())]
                if with_ids:
                    cols.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)
