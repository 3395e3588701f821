"""Whitening, alignment of tokenizers and piece encoding against plain versions and the public libraries."""

import hashlib
import itertools
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from gaugewright.llm import align, bpe, pieces, whitening
from gaugewright.llm.queries import PIECES, tokenizer_path

SCHEMA = "doc_id long, text string, row string, links string, n_tokens string, n int"
STUFF = [" ", "\n", "▁", "a", "b", "the", "ing", "é", "日", "\t", "\r", "1", "23", "<", "0x0A>", " ", "🙂", "<|endoftext|>", "aaaaaaa", "ΩΨ", "<s>", "\x00"]
ODD = [None, "", " ", "  ", " a", "a ", "  a", "\n", " \n ", "\na\n b", "a▁b", "▁a", "<|endoftext|>", "<s> <0x41> <unk>", "a\r\nb\tc", "x" * 5000, " " * 3000, "ab " * 2000, "日本語 テキスト\n漢字"]


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(11)
    return ODD + ["".join(rng.choice(STUFF) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts(300)
    rows = [(i, t, "r", "l", "n", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (5, "another text", "r", "l", "n", 1)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces_equal_library(docs, empty):
    path = tokenizer_path(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.tokenize(docs, path, with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), tuple(ids)] += 1
    assert Counter((*r[:4], tuple(r["ids"])) for r in got) == want
    assert pieces.pieces(path).cuts
    assert pieces.tokenize(empty, path).count() == 0


@pytest.mark.parametrize("change", ["crossing", "newline", "suffix", "spaces", "symbol", "newline in a piece"])
def test_pieces_of_other_vocabularies(tmp_path, change):
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(tokenizer_path(PIECES), "rb").read())
    if change == "crossing":
        spec.pieces[400].piece = "a▁b"
    elif change == "spaces":
        spec.normalizer_spec.remove_extra_whitespaces = True
    elif change == "suffix":
        spec.trainer_spec.treat_whitespace_as_suffix = True
    elif change == "symbol":
        spec.pieces[400].piece, spec.pieces[400].type = "a b", pieces.USER_DEFINED
    else:
        spec.pieces[400].piece, spec.pieces[400].score = "\nb", 5.0
        spec.pieces.add(piece="\n", score=0.0, type=1)
    path = str(tmp_path / "other.model")
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    p, texts = pieces.Pieces(path), odd_texts(400)
    assert p.cuts == change.startswith("newline")
    ids, begin = pieces.segment(p, pa.array(texts, pa.string()))
    for t, x, y in zip(texts, begin[:-1], begin[1:], strict=True):
        want = p.library.encode(t or "")
        assert ids[x:y].tolist() == want, t
        assert p.decode(ids[x:y]) == p.library.decode(want), t


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    """Counts, digest and links of each text by loops over its tokens."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    alphabet, out = bpe.byte_alphabet(), []
    for text in texts:
        a, b, groups, links = [], [], [], Counter()
        if text:
            e = tokenizer.encode(" " + text, add_special_tokens=False)
            b = library.encode(text)
            spans_a = [bytes(alphabet[c] for c in tokenizer.id_to_token(i)) for i in e.ids]
            spans_b = [bytes([int(s[3:-1], 16)]) if library.is_byte(i) else s.replace("▁", " ").encode() for i in b for s in [library.id_to_piece(i)]]
            if b"".join(spans_a) == b"".join(spans_b) == (" " + text).encode():
                a = e.ids
                ends = [list(itertools.accumulate(map(len, s))) for s in (spans_a, spans_b)]
                last = 0
                for end in sorted({*ends[0]} & {*ends[1]}):
                    x, y = ([i for i, at in zip(ids, at_end, strict=True) if last < at <= end] for ids, at_end in zip((a, b), ends, strict=True))
                    groups.append((x, y))
                    links.update(itertools.product(x, y))
                    last = end
            else:
                b = []
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), links.total(), sha(text_of) if groups else "", links))
    return out


@pytest.mark.parametrize("hot", [1, 300, 1 << 17])
def test_alignment_against_plain(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(align, "HOT_PAIRS", hot)
    monkeypatch.setattr(align, "SLICE", 40)
    rows = docs.collect()
    plain = plain_alignment([r["text"] for r in rows])
    held = Counter(pair for p in plain for pair in p[5])
    top: dict[int, int] = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    want = Counter()
    for r, (na, nb, ng, nl, digest, links) in zip(rows, plain, strict=True):
        best = sum(times for pair, times in links.items() if held[pair] == top[pair[0]])
        want[r["doc_id"], na, nb, ng, nl, best, sum(times * held[pair] for pair, times in links.items()), digest] += 1
    out = align.align(docs, tokenizer_path(), tokenizer_path(PIECES))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == want
    assert align.align(empty, tokenizer_path(), tokenizer_path(PIECES)).count() == 0


def test_long_groups_pair_distinct_ids_only():
    """10,000 tokens of each side in one group, of 3 and 2 ids: 6 pairs that stand for 10^8 links."""
    n = 10_000
    a, b = np.arange(n) % 3, np.arange(n) % 2
    zero, one = np.zeros(n, np.int64), np.array([n])
    text, x, y, times = align.linked(np.array([0]), zero, a, zero, b, one, one)
    assert len(text) == 6 and times.sum() == n * n
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), times.tolist(), strict=True))[0, 1] == 3334 * 5000


VECTORS = "vec_id long, embedding array<float>, x string, component string, n int"


def test_whitening_against_plain(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(400, 7)) * [9, 5, 3, 2, 1, 0.5, 0.1] + [1e4, 0, 0, -50, 0, 0, 3]).astype(np.float32)
    rows = [(i, x.tolist(), "x", "c", 1) for i, x in enumerate(v)] + [(i, v[0].tolist(), "x", "c", 1) for i in range(1000, 1300)]
    bad = [None, [], [None] * 7, [1.0] * 6 + [float("nan")], [float("inf")] + [1.0] * 6, [1.0] * 6, [1e30] * 7, [-0.0] * 6 + [0.001]]
    rows += [(2000 + i, x, "x", "c", 1) for i, x in enumerate(bad)] + [(1, v[1].tolist(), "x", "c", 1)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).toPandas()
    x = np.floor(v.astype(float) * 256).astype(np.int64)
    zero = np.zeros(7, np.int64)  # the last of the bad ones is sound
    distinct = [list(map(int, t)) for t in {tuple(t) for t in x.tolist()} | {tuple(zero.tolist())}]
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(t, sums, strict=True)] for t in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    assert len(got) == 4 * (400 + 300 + 1 + 1) and set(got["n"]) == {n} and set(got["vec_id"]) == {*range(400), *range(1000, 1300), 2007}
    own = {i: t for i, t in enumerate(x.tolist())} | {i: x[0].tolist() for i in range(1000, 1300)} | {2007: zero.tolist()}
    for i, part in got.groupby("vec_id"):
        assert {int(d) for d in part["deviation"]} == {sum((n * c - s) ** 2 for c, s in zip(own[i], sums, strict=True))}
    for k, part in got.groupby("component"):
        want = [float(np.dot([float(Fraction(n * c - s, n)) for c, s in zip(own[i], sums, strict=True)], vectors[:, -k]) / values[-k] ** 0.5) for i in part["vec_id"]]
        sign = np.sign(want[0] * part["whitened"].iloc[0])
        np.testing.assert_allclose(part["whitened"] * sign, want, atol=1e-9)
        np.testing.assert_allclose(part["explained"], values[-k] / values.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame([(i, x, "x", "c", 1) for i, x in enumerate(rows)], VECTORS)
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([None, []])).count() == 0
    one = whitening.whiten(make([[1.0, 2.0]] * 3)).collect()
    assert len(one) == 6 and {(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(make([[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [5.0, 0.0, 0.0]])).toPandas()  # one component only
    assert flat[flat["component"] > 1]["whitened"].isna().all() and flat[flat["component"] == 1]["whitened"].notna().all()
    assert flat["identity_error"].iloc[0] < 1e-12 and len(flat) == 9


def test_whitening_of_large_numbers(spark):
    """Sums and deviations beyond 64 bits stay exact."""
    big = 2.0**52
    rows = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 2.0]), (2, [-big, 1.0]), (3, [big, 1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(rows).filter("component = 1").collect()}
    x = {0: (2**60, 256), 1: (2**60, 512), 2: (-(2**60), 256)}
    s = [sum(t[k] for t in x.values()) for k in (0, 1)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in (x | {3: x[0]}).items()}
    assert got == {i: w for i, w in want.items() if w < 10**38}
