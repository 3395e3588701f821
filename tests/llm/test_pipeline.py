import corpus_pipeline
import __spark_entry__ as entry
from gaugewright.llm import bpe
from gaugewright.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.keep(out, "test")
        assert 0 < docs.count() <= 2 * n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_encoding_in_the_pipeline_works_on_small_blocks(spark, monkeypatch):
    """The same rows as in large blocks, and no block of text over the stage's bound but a single long text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    given = {}
    plain = bpe.tokenize
    want = sorted(map(tuple, plain(docs, tokenizer_path()).collect()))
    monkeypatch.setattr(corpus_pipeline.bpe, "tokenize", lambda *a, **k: given.update(k) or plain(*a, **(k | {"block_bytes": 5_000})))
    assert sorted(map(tuple, corpus_pipeline.encode(spark, docs, SF).collect())) == want
    assert given["block_bytes"] < bpe.BLOCK_BYTES
