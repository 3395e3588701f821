"""Byte-level BPE by a pair occurrence index.

A partition's texts are split into pre-tokens; the distinct ones of a block of
texts are laid out in one symbol array. The index maps each pair (by its merge
rank) to all its positions in the block. Ranks are applied in ascending order:
every live position of the rank is merged at once, and the pairs that a merge
makes are appended to the lists of their own ranks. A merge only makes symbols
of later ranks, which the vocabulary is checked for, so one ascending sweep
gives what merging each word by its lowest rank gives.

Defined cases: a null or empty text has no tokens and decodes to nothing; a very
long text or word is one stretch of the array (the sweep is linear in merges);
repeated rows are encoded each; an empty table gives no rows; other columns are
not read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from gaugewright.llm import bytesets as B

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 6_000_000  # of text whose distinct pre-tokens share an index


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(size, len(merges), np.int64)
        born[self.byte_id] = -1
        for r in range(len(merges) - 1, -1, -1):
            born[self.made[r]] = min(born[self.made[r]], r) if born[self.made[r]] >= 0 else -1
        rank = np.arange(len(merges))
        if not ((born[left] < rank) & (born[right] < rank)).all():
            raise ValueError("a merge uses a symbol that a later merge makes: one ascending sweep would not be exact")
        self.size = size
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], rank[order]
        self.pattern = regex.compile(PATTERN)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.offset = np.cumsum(self.lengths) - self.lengths

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; -1: none."""
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], -1)

    def decode(self, ids: np.ndarray) -> str:
        n = self.lengths[ids]
        end = np.cumsum(n)
        take = np.arange(end[-1] if len(end) else 0) + np.repeat(self.offset[ids] - (end - n), n)
        return self.flat[take].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def vocabulary(path: str, special: bool = True) -> Vocabulary:
    """special: whether the strings of special tokens in a text stand for those tokens, or are text like any other."""
    v = Vocabulary(path)
    if not special:
        v.special, v.split = {}, None
    return v


def encode_words(v: Vocabulary, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens (bytes end to end, and the lengths), and where each one's ids begin (and a last end)."""
    n = len(data)
    begin = np.cumsum(length) - length
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(length) + 1, np.int64)
    sym = np.append(v.byte_id[data], np.int32(-1)).astype(np.int64)  # n stands for "no neighbour"
    following = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    following[begin[length > 0] + length[length > 0] - 1] = n
    before[begin[length > 0]] = n
    live = np.ones(n + 1, bool)
    live[n] = False
    index: dict[int, list[np.ndarray]] = {}

    def enter(at: np.ndarray, ranks: np.ndarray) -> list[int]:
        """Append positions to the lists of their ranks."""
        ok = ranks >= 0
        at, ranks = at[ok], ranks[ok]
        if not len(at):
            return []
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        found = ranks[np.concatenate(([0], cut))].tolist()
        for r, part in zip(found, np.split(at, cut) if len(cut) else [at], strict=True):
            index.setdefault(r, []).append(part)
        return found

    pairs = np.flatnonzero(following[:n] < n)
    enter(pairs, v.ranks(sym[pairs], sym[following[pairs]]))
    for r in range(len(v.made)):
        lists = index.pop(r, None)
        if lists is None:
            continue
        x, y, z = v.left[r], v.right[r], v.made[r]
        p = np.sort(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
        q = following[p]
        ok = live[p] & (sym[p] == x) & (sym[q] == y)
        p, q = p[ok], q[ok]
        if len(p) > 1:
            fresh = np.concatenate(([True], p[1:] != p[:-1]))
            p, q = p[fresh], q[fresh]
            if x == y and len(p) > 1:  # runs: every second pair from the left
                chained = np.concatenate(([False], q[:-1] == p[1:]))
                i = np.arange(len(p))
                p, q = (a[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0] for a in (p, q))
        if not len(p):
            continue
        after = following[q]
        sym[p], live[q], following[p] = z, False, after
        inner = after < n
        before[after[inner]] = p[inner]
        prior = before[p]
        left = prior < n
        enter(np.concatenate((prior[left], p[inner])), np.concatenate((v.ranks(sym[prior[left]], sym[p[left]]), v.ranks(sym[p[inner]], sym[after[inner]]))))
    kept = np.flatnonzero(live[:n])
    return sym[kept], np.append(np.searchsorted(kept, begin), len(kept))


def gather(ids: np.ndarray, begin: np.ndarray, which: np.ndarray) -> np.ndarray:
    """ids[begin[w]:begin[w + 1]] for each w of which, one after the other."""
    n = begin[which + 1] - begin[which]
    end = np.cumsum(n)
    return ids[np.arange(end[-1]) + np.repeat(begin[which] - (end - n), n)] if len(which) else ids[:0]


def irregular(c: B.Chunk, led: bool = False) -> np.ndarray:
    """Texts of a chunk with white space other than single inner spaces and newlines, or with "<|" in them.

    led: every text begins with a space and something behind it, and that space is no oddity."""
    buf = c.buf
    ends = np.zeros(len(buf), bool)
    ends[c.stop] = True  # the newlines between texts
    odd = (buf < 32) & ((buf != 10) & (buf >= 9) & (buf <= 13) | (buf >= 28))
    space = (buf == 32) | (buf == 10)
    odd[1:] |= space[1:] & space[:-1] & ~(ends[1:] & ends[:-1])
    odd[c.start] |= space[c.start] & ~ends[c.start]
    if led:
        odd[c.start] = False
    wide = np.flatnonzero((buf[:-2] == 0xC2) | (buf[:-2] == 0xE1) | (buf[:-2] == 0xE2) | (buf[:-2] == 0xE3) | (buf[:-2] == 0x3C)) if len(buf) > 2 else np.zeros(0, np.int64)
    x, y, z = (buf[wide + k] for k in range(3))
    hit = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0x3C) & (y == 0x7C)
    hit |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
    odd[wide[hit]] = True
    return np.bincount(np.searchsorted(c.stop, np.flatnonzero(odd)), minlength=len(c.start))[: len(c.start)] > 0


def encode_block(v: Vocabulary, column: pa.Array, led: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts of a column, by one index over its distinct units, and where each text's ids begin (and a last end).

    Pre-tokens never run over the start of a single space or newline between
    non-spaces, so a text's units are its words with the space before them, and
    its newlines. The texts named by irregular() go through the pattern whole,
    each as one unit. Unit 0 is a newline."""
    hashes, where, texts_of, sources = [], [], [], []
    wholes: list[tuple[int, str]] = []
    base = 0
    for c in B.chunks(column):
        odd = irregular(c, led)
        s, e = c.words()
        who = c.owner(s)
        ok = ~odd[who]
        s, e, who = s[ok], e[ok], who[ok]
        before = c.buf[np.maximum(s - 1, 0)]
        spaced = (s > c.start[who]) & (before == 32)
        lined = (s > c.start[who]) & (before == 10)
        h = B.mix(B.spans(c.prefix(), s, e) + spaced.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        hashes.append(h)
        where.append(np.stack([np.full(len(s), len(sources)), s - spaced, e, lined]))
        texts_of.append(who + base)
        sources.append(c.buf)
        wholes += [(base + int(i), c.buf[c.start[i] : c.stop[i]].tobytes().decode()) for i in np.flatnonzero(odd)]
        base += len(c.start)
    if not base:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    h, w, owner = np.concatenate(hashes), np.concatenate(where, axis=1), np.concatenate(texts_of)
    _, first, unit = np.unique(h, return_index=True, return_inverse=True)
    out = bytearray()
    views = [memoryview(x) for x in sources]
    for k, s, e in zip(*w[:3, first].tolist(), strict=True):
        out += views[k][s:e]
        out += b"\n"
    words = v.pattern.findall(out.decode())
    # a space behind the newline that ends a unit stays with its word; so those newlines are the only ones
    chars = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(bytes(out), np.uint8)
    head = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    begin = head[np.cumsum(chars) - chars] if len(words) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(data)))
    closing = data[begin] == 10
    number = np.cumsum(closing) - closing + 1  # unit of each pre-token
    body = np.ones(len(data), bool)
    body[begin[closing]] = False
    extra: list[list[bytes]] = []
    order: list[int] = []
    for text_at, text in wholes:
        parts = [x for x in v.split.split(text) if x] if v.split else [text]
        extra.append([x for p in parts for x in ([p.encode()] if p in v.special else [t.encode() for t in v.pattern.findall(p)])])
        order.append(text_at)
    flat = [x for u in extra for x in u]
    special = {k.encode(): i for k, i in v.special.items()}
    lengths = np.concatenate(([1], length[~closing], np.fromiter(map(len, flat), np.int64, len(flat))))
    data = np.concatenate((np.array([10], np.uint8), data[body], np.frombuffer(b"".join(flat), np.uint8)))
    units = np.concatenate(([0], number[~closing], np.repeat(np.arange(len(wholes)) + len(first) + 1, [len(u) for u in extra]).astype(np.int64)))
    fixed = np.array([special.get(x, -1) for x in flat], np.int64)
    ids, at = encode_words(v, data, lengths)
    if (fixed >= 0).any():  # a special token's text stands alone only where it was cut out
        tail = len(lengths) - len(fixed)
        keep = np.ones(len(ids), bool)
        for i in np.flatnonzero(fixed >= 0):
            a, b = at[tail + i], at[tail + i + 1]
            ids[a] = fixed[i]
            keep[a + 1 : b] = False
        total = np.concatenate(([0], np.cumsum(keep)))
        ids, at = ids[keep], total[at]
    begin = at[np.searchsorted(units, np.arange(len(first) + len(wholes) + 2))]
    # the texts' units in order: a newline unit goes before each word that follows one
    lined = w[3].astype(bool)
    sequence = np.insert(unit + 1, np.flatnonzero(lined), 0)
    seq_owner = np.insert(owner, np.flatnonzero(lined), owner[lined])
    if wholes:
        put = np.searchsorted(seq_owner, order)
        sequence = np.insert(sequence, put, np.arange(len(wholes)) + len(first) + 1)
        seq_owner = np.insert(seq_owner, put, order)
    count = np.bincount(seq_owner, weights=(begin[sequence + 1] - begin[sequence]), minlength=base).astype(np.int64)
    return gather(ids, begin, sequence), np.concatenate(([0], np.cumsum(count)))


def encode(v: Vocabulary, texts: list[str | None]) -> list[np.ndarray]:
    """The ids of each text."""
    ids, begin = encode_block(v, pa.array(texts, pa.string()))
    return [ids[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", with_ids: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids: one row for each row of docs.

    block_bytes: of text that a task works on at once; smaller blocks take less memory and more time."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = src.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = b.column(1)
            at = 0
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + block_bytes, side="right")))
                flat, begin = encode_block(v, texts.slice(at, stop - at))
                ids = [flat[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
                cols = [b.column(0).slice(at, stop - at), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(v.decode(i).encode()).hexdigest() for i in ids], pa.string())]
                if with_ids:
                    cols.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                at = stop

    return src.mapInArrow(run, schema)
