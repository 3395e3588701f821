import base64
import hashlib
import io
from collections import Counter

import numpy as np
import pytest

from gaugewright.llm import neighbours, warc
from gaugewright.llm.linkage import components


def brute(rows, every, top):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            out[i] = sorted(((-float(np.dot(v, w)), j) for j, w in good if j != i))[:top]
    return out


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.5, 2, size=(400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [None] + [1.0] * 11), (2060, [float("nan")] * 12), (2080, [1.0, 2.0]), (None, x[0].tolist()), (2100, [float("inf")] * 12)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score"), every=20, top=20).toPandas()
    want = brute(rows, 20, 20)
    assert set(got["query_id"]) == set(want)
    hit = 0
    for q, best in want.items():
        g = got[got["query_id"] == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g["vec_id"])
        assert list(zip(-g["score"], g["vec_id"])) == sorted(zip(-g["score"], g["vec_id"]))
        hit += len(set(g["vec_id"]) & {j for _, j in best})
    assert hit / (20 * len(want)) >= 0.9
    g = got[got["query_id"] == 1000].sort_values("rank")  # one of many equal vectors: ties by id
    assert g["vec_id"].tolist()[:3] == [j for _, j in want[1000]][:3]


def test_neighbours_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest(few).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert neighbours.nearest(few.filter("false")).count() == 0


def test_warc_round_trip(spark):
    rows = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "own é"), (7, "http://a/7", None), (8, "http://x\r\ny", ""), (1, "http://a/1", "WARC/1.1\r\n\r\n"), (1, "http://a/1", "WARC/1.1\r\n\r\n"), (None, "http://n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as path")
    got = warc.captures(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min([x for x in (i, first.get(h or "")) if x is not None], default=None)
    by = {r.page_id: r for r in got}
    for i, _, h in rows:
        b, r = (h or "").encode(), by[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert {r.record_type for r in warc.captures(pages, min_revisit_bytes=5).filter("page_id = 5").collect()} == {"response"}
    assert warc.captures(pages.filter("false")).count() == 0


def test_warc_repeated_page_ids_in_several_tasks(spark):
    """Rows of one page_id spread over tasks, with equal and differing payloads, are one capture each."""
    rows = [(7, f"u{i}", "same") for i in range(40)] + [(7, "v", "other")] * 3 + [(9, "w", "same"), (3, "x", "other"), (None, "y", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.captures(pages).collect())
    assert got == {(7, 4, "response", None): 40, (7, 5, "revisit", 3): 3, (9, 4, "revisit", 7): 1, (3, 5, "response", None): 1, (None, 4, "revisit", 7): 1}
    nested = warc.assemble(warc.read(spark, warc.write(pages))).collect()
    assert len({r.capture_id for r in nested}) == len(rows) == len(nested)
    assert {r.response.refers_to is None for r in nested if r.response.type == "revisit" and r.response.payload_digest == warc.digest(b"same")} == {True}


def test_warc_records_and_assembly(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 4}</p>") for i in range(30)], "page_id long, url string, html string")
    manifest = warc.write(pages, file_bytes=2000)
    assert manifest.count() > 4 and manifest.selectExpr("sum(records)").first()[0] == 90
    records = warc.read(spark, manifest)
    assert {r.type: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 30, "metadata": 30, "response": 4, "revisit": 26}
    nested = warc.assemble(records).collect()
    assert len(nested) == 30 and all(r.request.target_uri == r.response.target_uri and r.metadata.fields["page-id"] == r.request.target_uri.rsplit("/", 1)[1] for r in nested)
    ids = {r.capture_id for r in nested}
    assert all(r.response.refers_to in ids for r in nested if r.response.type == "revisit")


def test_warc_stops_at_broken_archives():
    data = warc.record("response", [("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert [b for _, b in warc.read_records(io.BytesIO(data * 2))] == [b"HTTP/1.1 200 OK\r\n\r\nbody"] * 2
    with pytest.raises((EOFError, ValueError)):
        list(warc.read_records(io.BytesIO(data[:-9])))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (7, 3), (160, 159)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 161)}


def test_neighbours_of_the_usual_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 12)))]
    df = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest(df([*rows, (40, [1.0] * 13)]), every=10).collect()))
    assert {r[0] for r in got} == {0, 10, 20} and got == sorted(map(tuple, neighbours.nearest(df(rows), every=10).collect()))


def test_neighbours_recall_beside_huge_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[[11, 501, 1001]] *= 5000
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, top=20).toPandas()
    want = brute(rows, 20, 20)
    hit = sum(len(set(got.loc[got["query_id"] == q, "vec_id"]) & {j for _, j in best}) for q, best in want.items())
    print("recall", hit / (20 * len(want)))
    assert hit / (20 * len(want)) >= 0.9
