"""Quality rules judged by document and by host.

Each document is measured once (words, symbols, repeated lines and windows). A
document fails by itself on its own measures; a host fails when, for any rule, the share
of its documents that fail it, shrunk towards a beta prior fitted to all hosts,
is over a cut relative to that of all documents. Host sums are map-side combined, so a host with a third of all rows
costs no more than any other, and verdicts come back by a join on the host that
Spark broadcasts only if the verdict table is small.

Defined cases: a null or empty text has no words and fails on its length; rows
with a null host share one null host; repeated rows are measured and counted
each; an empty table gives no rows; further columns pass through untouched."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm import bytesets as B
from gaugewright.llm.store import keep

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    max_symbol_pct: int = 20  # of the code points in words; this and the next three count for hosts only
    max_dup_lines_pct: int = 10  # repeated lines for 100 words
    min_word_chars: int = 2
    max_word_chars: int = 20
    host_lift: float = 3.0  # times the mean of all documents that a host's shrunk rate of a rule may be,
    host_min_rate: float = 0.3  # where that lies
    host_max_rate: float = 0.5  # between these two


def measure(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """The measures of each text of a string column."""
    parts: list[dict[str, np.ndarray]] = []
    for c in B.chunks(column):
        prefix = c.prefix()
        h, who, n_words = B.word_hashes(c, prefix)
        head = (c.buf & 0xC0) != 0x80
        out = {"n_words": n_words, "word_chars": B.sums(head & ~B.SEP[c.buf], c.start, c.stop), "n_symbols": B.sums(_SYMBOL[c.buf], c.start, c.stop)}
        ls, le = c.lines()
        has_word = B.sums(~B.SEP[c.buf], ls, le) > 0
        ls, le = ls[has_word], le[has_word]
        at = c.owner(ls)
        key = B.mix(B.spans(prefix, ls, le) + at.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        _, first = np.unique(key, return_index=True)
        out["n_dup_lines"] = np.bincount(at, minlength=len(c.start)) - np.bincount(at[first], minlength=len(c.start))
        covered = np.zeros(len(h) + 1, np.int64)
        g = B.grams(h, window)
        inside = np.flatnonzero(who[: len(g)] == who[window - 1 : window - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
        if len(inside):
            key = B.mix(g[inside] + who[inside].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            twice = inside[count[inverse] > 1]
            covered += np.bincount(twice, minlength=len(covered)) - np.bincount(twice + window, minlength=len(covered))
        repeated = np.cumsum(covered)[:-1] > 0
        out["n_repeat_words"] = np.bincount(who[repeated], minlength=len(c.start))
        parts.append(out)
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in MEASURES}


def _measured(docs: DataFrame, carry: list[str], rules: Rules) -> DataFrame:
    """docs' columns `carry` with the measures behind them."""
    src = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    schema = src.drop("__text").schema
    for m in MEASURES:
        schema = schema.add(m, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(b.num_columns - 1), rules.window)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(carry))] + [pa.array(m[k]) for k in MEASURES], names=[*carry, *MEASURES])

    return src.mapInArrow(run, schema)


def failed(rules: Rules) -> F.Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))


def rule_failures(rules: Rules) -> dict[str, F.Column]:
    """The rules that are counted by host: those of the base, both at once, and softer ones that reject no document alone."""
    n = F.col("n_words")
    return {
        "failed": failed(rules),
        "short": n < rules.min_words,
        "repeating": 100 * F.col("n_repeat_words") > rules.max_repeat_pct * n,
        "symbols": 100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > rules.max_dup_lines_pct * n,
        "lengths": (F.col("word_chars") < rules.min_word_chars * n) | (F.col("word_chars") > rules.max_word_chars * n),
    }


def _prior(by: DataFrame, name: str) -> list[F.Column]:
    """Mean and strength of the beta prior of one rule over hosts.

    The mean is that of all documents. Hosts' raw rates spread by chance as well as
    by nature; the analysis of variance takes chance out: with m_b and m_w the mean
    squares between and within hosts and n0 the usual size of a host, the correlation
    of two documents of a host is (m_b - m_w) / (m_b + (n0 - 1) m_w), and the strength
    is its odds against. Hosts that differ by no more than chance, or of which nothing
    can be told (one host; one document each), get all documents' weight."""
    n, f = F.col("n_docs"), F.col(f"n_{name}")
    total, k = F.sum(n), F.count(F.lit(1))
    mean = F.try_divide(F.sum(f), total)
    between = F.try_divide(F.sum(f * f / n) - F.sum(f) * mean, k - 1)
    within = F.try_divide(F.sum(f) - F.sum(f * f / n), total - k)
    usual = F.try_divide(total - F.try_divide(F.sum(n.cast("double") * n), total), k - 1)
    odds = F.try_divide(usual * within, between - within)  # (1 - correlation) / correlation, where that is above 0
    strength = F.when(between > within, F.least(F.greatest(odds, F.lit(1.0)), total.cast("double")))
    return [mean.alias(f"mean_{name}"), F.coalesce(strength, total.cast("double"), F.lit(1.0)).alias(f"strength_{name}")]


def host_rates(measured: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """Per host: documents, failures by rule, each rule's rate shrunk by an empirical beta prior, and the verdict.

    A host is rejected if a shrunk rate is over that rule's cut: host_lift times the
    mean of all documents, but from host_min_rate to host_max_rate."""
    counted = rule_failures(rules)
    by = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(c).alias(f"n_{k}") for k, c in counted.items()])
    prior = by.agg(*[c for k in counted for c in _prior(by, k)])
    out = by.crossJoin(F.broadcast(prior))  # one row: a broadcast of fixed size
    over = []
    for k in counted:
        mean, strength = F.col(f"mean_{k}"), F.col(f"strength_{k}")
        out = out.withColumn(f"rate_{k}", (F.col(f"n_{k}") + mean * strength) / (F.col("n_docs") + strength))
        cut = F.least(F.lit(rules.host_max_rate), F.greatest(F.lit(rules.host_min_rate), rules.host_lift * mean))
        over.append(F.col(f"rate_{k}") > cut)
    return out.withColumn("shrunk_rate", F.col("rate_failed")).withColumn("host_rejected", F.exists(F.array(*over), lambda x: x))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """id, measures, base_failed, host_rate, kept: one row for each row of docs."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("__host"), "text")
    m = keep(_measured(src, ["doc_id", "__host"], rules), "quality")
    hosts = host_rates(m, "__host", rules).select("host", "shrunk_rate", "host_rejected")
    out = m.join(hosts, m["__host"].eqNullSafe(hosts["host"]), "left")
    base = failed(rules)
    return out.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & ~F.col("host_rejected")).alias("kept"), F.round("shrunk_rate", 9).alias("host_rate"))


def filter_documents(docs: DataFrame, host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, with all their columns and no others.

    Measures are made twice, once for the hosts and once beside the text, so that
    no text is shuffled and rows need no unique id."""
    cols = docs.columns
    plain = docs.select(F.col(host_col).cast("string").alias("__host"), "text")
    rejected = host_rates(_measured(plain, ["__host"], rules), "__host", rules).filter("host_rejected").select(F.col("host").alias("__rejected_host"))
    # numbered names: the documents' own may be those of measures
    names = [f"c{i}" for i in range(len(cols))]
    full = _measured(docs.toDF(*names).withColumn("text", F.col(names[cols.index("text")])), names, rules).filter(~failed(rules))
    h = F.col(f"c{cols.index(host_col)}").cast("string")
    return full.join(rejected, h.eqNullSafe(F.col("__rejected_host")), "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
