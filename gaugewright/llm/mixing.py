"""Mixing documents to target token weights by soft domain membership.

A softmax classifier over hashed words learns the domains of the labelled table
from at most TRAIN_ROWS labelled documents (taken by the hash of their id, so
that any input gives the same ones) and gives every document a posterior over
the domains. Nonnegative rates r then minimise the squared misses of the
expected domain totals, sum over domains of (sum_d r_d t_d p_dk - T_k)^2 / C_k,
with t tokens and C the totals at rate 1, by projected gradient steps from
r = 1: r_d <- max(0, r_d - p_d . miss / C). Each step is one distributed sum of
as many numbers as there are domains; a document's rate follows from its
posterior and the few misses so far, so no rates are stored or shuffled.

Defined cases: null and empty texts have no tokens and the prior's posterior;
labels that are null, repeated against each other or of unknown documents do not
train, and of rows that repeat a labelled id with other texts the least text does;
texts of any length are read whole; with fewer than two labelled domains all documents are one domain and
keep the rate of its target; rows that repeat an id get a rate each; an empty
table gives no rows; extra columns pass through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from gaugewright.llm import bytesets as B
from gaugewright.llm.store import keep

TRAIN_ROWS = 8_000
BITS = 14
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Setting:
    #: Target totals as multiples of the domains' present totals; domains not named keep theirs.
    targets: tuple[tuple[str, float], ...] = (("quality1_toxic0", 1.0), ("quality0_toxic0", 0.5), ("quality1_toxic1", 0.0), ("quality0_toxic1", 0.0))
    steps: int = 40
    tolerance: float = 1e-4  # of all tokens, in the sum of the misses
    settled: float = 1e-4  # a step that betters the sum of squares by less than this part of that at rates of 1 is the last


@dataclass
class Model:
    domains: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray


@dataclass
class Solution:
    """The steps that lead from rates of 1 to the fitted ones; target totals, totals reached; whether more steps would better them no further."""

    history: list[np.ndarray]
    want: np.ndarray
    now: np.ndarray
    converged: bool


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and text, hashed word and weight of each distinct pair (rows of unit length)."""
    counts, rows, cols = [], [], []
    base = 0
    for c in B.chunks(column):
        h, who, n = B.word_hashes(c)
        raw = h >> U(64 - BITS)
        c.buf = _LOWER[c.buf]
        low, _, _ = B.word_hashes(c)
        for x in (raw, B.mix(low) >> U(64 - BITS)):
            pair = np.unique((who.astype(np.int64) << BITS) | x.astype(np.int64))
            rows.append((pair >> BITS) + base)
            cols.append(pair & ((1 << BITS) - 1))
        counts.append(n)
        base += len(n)
    if not base:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    r, c = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(r, kind="stable")
    r, c = r[order], c[order]
    size = np.bincount(r, minlength=base)
    return np.concatenate(counts), r, c, 1 / np.sqrt(np.maximum(size, 1))[r]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is derived from their texts stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def scores(m: Model, rows: int, r: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.stack([np.bincount(r, weights=m.weights[c, k] * w, minlength=rows) for k in range(len(m.domains))], axis=1) + m.bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(words: list[np.ndarray], domain: list[str], steps: int = 120) -> Model:
    """Softmax regression with adaptive steps on the hashed words of each text."""
    names = sorted(set(domain))
    y = np.array([names.index(d) for d in domain])
    size = np.array([len(x) for x in words])
    r, c = np.repeat(np.arange(len(words)), size), np.concatenate(words).astype(np.int64)
    w = 1 / np.sqrt(np.maximum(size, 1))[r]
    n, k = len(y), len(names)
    m = Model(names, np.zeros((1 << BITS, k)), np.log(np.bincount(y, minlength=k) / n))
    truth = np.eye(k)[y]
    balance = (n / (k * np.bincount(y, minlength=k)))[y] ** 0.5
    seen, seen_bias = np.full((1 << BITS, k), 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        miss = (scores(m, n, r, c, w) - truth) * balance[:, None] / n
        g = np.stack([np.bincount(c, weights=miss[r, j] * w, minlength=1 << BITS) for j in range(k)], axis=1) + 1e-6 * m.weights
        gb = miss.sum(axis=0)
        seen += g * g
        seen_bias += gb * gb
        m.weights -= 1.0 * g / np.sqrt(seen)
        m.bias -= 0.1 * gb / np.sqrt(seen_bias)
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of at most `rows` labelled documents; the driver gets their hashed words, at most 2**BITS of each, not their texts."""
    ok = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    ok = ok.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"), F.min("toxic").alias("t"), F.max("toxic").alias("t2")).filter("q = q2 and t = t2")
    ok = ok.select("doc_id", F.concat(F.lit("quality"), F.col("q"), F.lit("_toxic"), F.col("t")).alias("domain"))
    some = ok.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most TRAIN_ROWS ids and names: a bounded broadcast
    held = docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    held = held.groupBy("doc_id").agg(F.first("domain").alias("domain"), F.min("text").alias("text"))  # of rows that share an id, the least text

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            _, r, c, _ = features(b.column(2))
            cut = np.searchsorted(r, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c[x:y].astype("<i2").tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "domain", "words"])

    got = held.mapInArrow(hashed, held.select("doc_id", "domain").schema.add("words", "binary")).toArrow().sort_by("doc_id")
    domains = got["domain"].to_pylist()
    if len(set(domains)) < 2:
        return Model(domains[:1] or ["all"], np.zeros((1 << BITS, 1)), np.zeros(1))
    return fit([np.frombuffer(x, "<i2") for x in got["words"].to_pylist()], domains)


def _rates(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for g in history:
        r = np.maximum(0, r - p @ g)
    return r


def posteriors(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns to carry, n_tokens, and the posterior: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a domain
    src = docs.select(*carry, F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _slices(batches):
            n, r, c, w = features(b.column(len(carry)))
            p = scores(m, b.num_rows, r, c, w)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], names=[*carry, "n_tokens", "posterior"])

    return src.mapInArrow(run, src.select(*carry).schema.add("n_tokens", LongType()).add("posterior", ArrayType(DoubleType())))


def _totals(table: DataFrame, history: list[np.ndarray], k: int) -> np.ndarray:
    """Expected token totals by domain at the rates of a history: k numbers from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            p = np.asarray(b.column(1).flatten()).reshape(-1, k)
            total += (_rates(p, history) * b.column(0).to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["k", "total"])

    out = np.zeros(k)
    for row in table.select("n_tokens", "posterior").mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("t")).collect():
        out[row.k] = row.t
    return out


def solve(table: DataFrame, domains: list[str], setting: Setting) -> Solution:
    k = len(domains)
    now = base = _totals(table, [], k)
    want = base * np.array([dict(setting.targets).get(d, 1.0) for d in domains])
    scale = np.maximum(base, 1e-9)
    squares = lambda total: float((((total - want) ** 2) / scale).sum())
    out = Solution([], want, now, False)
    while True:
        if np.abs(out.now - want).sum() <= setting.tolerance * max(base.sum(), 1e-9):
            out.converged = True
        if out.converged or len(out.history) >= setting.steps:
            return out
        before = squares(out.now)
        out.history.append((out.now - want) / scale)
        out.now = _totals(table, out.history, k)
        out.converged = 0 <= before - squares(out.now) <= setting.settled * squares(base)


def _copies(rate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    return np.floor(rate + draw).astype(np.int64)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior, rate, converged (of the whole fit): one row for each row of docs."""
    x = docs.select(F.col(id_col).alias("doc_id"), "text")
    model = train(x, labels)
    table = keep(posteriors(x, model, ["doc_id"]), "mixing")
    fitted = solve(table, model.domains, setting)
    rate = F.lit(1.0)
    for g in fitted.history:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col("posterior")[i] * float(v) for i, v in enumerate(g)), F.lit(0.0)))
    names = F.array(*map(F.lit, model.domains))
    best = F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    return table.select("doc_id", "n_tokens", best.alias("domain"), F.transform("posterior", lambda v: F.round(v, 6)).alias("posterior"), F.round(rate, 6).alias("rate"), F.lit(fitted.converged).alias("converged"))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", setting: Setting = Setting()) -> DataFrame:
    """docs with each row as many times as its rate says (fractions by a draw from the text's hash), no further columns."""
    model = train(docs.select(F.col(id_col).alias("doc_id"), "text"), labels)
    k = len(model.domains)
    table = keep(posteriors(docs.select("text"), model, []), "mixing")
    history = solve(table, model.domains, setting).history
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _slices(batches):
            _, r, c, w = features(b.column(at))
            rate = _rates(scores(m, b.num_rows, r, c, w).reshape(-1, k), history)
            marks = np.concatenate([B.spans(x.prefix(), x.start, x.stop) for x in B.chunks(b.column(at))])
            n = _copies(rate, (B.mix(marks) >> U(11)).astype(np.float64) / 2**53)
            yield b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))

    return docs.mapInArrow(run, docs.schema)
