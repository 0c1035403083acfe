from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.operators import search, symbols

SCHEMA = "chunk_id string, project_id string, path string, language string, symbol string, start_line int, end_line int, content string, embedding array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [
        ("a", "p", "/x/a.go", "go", "Foo", 1, 2, "A", [1.0, 0.0]), ("b", "p", "/x/b.go", "go", "Bar", 1, 2, "B", [0.9, 0.1]), ("c", "q", "/y/c.go", "go", "Foo", 1, 2, "C", [0.9, 0.1]),
        ("d", "p", "/z/foo.md", "markdown", "x", 5, 9, "D", [0.5, 0.5]), ("e", "p", "/z/foo.md", "markdown", "y", 1, 4, "E", [0.5, 0.5]), ("f", "p", "/n", None, None, 1, 1, None, None), ("g", "p", "/short", None, None, 1, 1, None, [1.0]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r.chunk_id for r in df.collect()]


def test_top_k_breaks_ties_by_id_and_skips_odd_vectors(vectors):
    assert ids(search.search(vectors, [1.0, 0.0], k=9)) == ["a", "b", "c", "d", "e"]
    assert ids(search.search(vectors.limit(0), [1.0, 0.0])) == []
    assert len(ids(search.search(vectors, [1.0, 0.0], k=0))) == 5


def test_path_filter_after_the_fetch(spark):
    rows = [(str(i), "p", "/out", None, None, 1, 1, None, [1.0 - i / 100]) for i in range(4)] + [("9", "p", "/in/x", None, None, 1, 1, None, [0.1])]
    v = spark.createDataFrame(rows, SCHEMA)
    assert ids(search.search(v, [1.0], k=1, path="/in")) == []
    assert ids(search.search(v, [1.0], k=1, path="/in", exact=True)) == ["9"]


def test_boost(vectors):
    got = {r.chunk_id: r.score for r in search.search(vectors, [1.0, 0.0], text="foo", k=9).collect()}
    assert got["a"] == pytest.approx(1.1)
    assert got["c"] == pytest.approx(1.0)
    assert got["d"] == pytest.approx(0.55)
    assert got["b"] == pytest.approx(0.9)


def test_filters(vectors):
    assert ids(search.search(vectors, [1.0, 0.0], project="q")) == ["c"]
    assert ids(search.search(vectors, [1.0, 0.0], language="markdown")) == ["d", "e"]


def test_best_per_path(vectors):
    hits = search.scored(vectors, [1.0, 0.0])
    assert sorted(ids(search.best_per_path(hits))) == ["a", "b", "c", "e"]


def test_unified(vectors):
    hits = search.scored(vectors, [1.0, 0.0])
    got = [(r.source, r.path) for r in search.unified({"code": hits.where("language = 'go'"), "docs": hits}, 10).collect()]
    assert got[0] == ("code", "/x/a.go")
    assert len(got) == 5
    assert ("docs", "/x/a.go") not in got


@pytest.mark.parametrize("block", [1, 2, 100])
def test_batch_top_k_equals_brute_force(spark, block):
    import random

    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(40)] + [(99, None)]
    v = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>").repartition(3)
    q = v.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(x.query_id, x.rank): (x.chunk_id, x.score) for x in search.batch_top_k(q, v, 5, block).collect()}
    have = dict(rows)
    for n in (0, 10, 20, 30):
        best = sorted(((-round(sum(a * b for a, b in zip(have[n], e)), 6), i) for i, e in rows if e))[:5]
        assert [got[n, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 20
    assert search.batch_top_k(q.limit(0), v, 5).count() == 0


def test_symbols(spark):
    rows = [("p", "/foo.go", "go", "FooBar", "", 1, 2), ("p", "/bar.go", "go", "BarBaz", "", 1, 2), ("q", "/qux.py", "python", "Qux", "", 1, 2), ("q", "/n", "go", "", "", 1, 2), ("q", "/m", "go", None, "", 1, 2), ("q", "/b", "python", "bar", "", 3, 4)]
    chunks = spark.createDataFrame(rows, "project_id string, path string, language string, symbol string, signature string, start_line int, end_line int")
    s = symbols.locations(chunks)
    assert s.count() == 4
    assert {r.symbol for r in symbols.fuzzy(s, "Bar").collect()} == {"FooBar", "BarBaz", "bar"}
    assert [r.symbol for r in symbols.exact(s, "BAR").collect()] == ["bar"]
    assert [r.path for r in symbols.find_symbol(s, "Bar").collect()] == ["/b"]
    # an exact hit in another project keeps the partial ones out
    assert symbols.find_symbol(s, "Bar", project="p").count() == 0
    assert [r.path for r in symbols.find_symbol(s, "fooB", language="GO").collect()] == ["/foo.go"]
    near = symbols.find_symbol(s, "nothing", semantic=lambda q: chunks.where("symbol = 'Qux'").withColumn("symbol", F.lit("NothingElse")))
    assert [r.symbol for r in near.collect()] == ["NothingElse"]
    index = {r.symbol_key: r.places for r in symbols.symbol_index(chunks).collect()}
    assert index == {"foobar": 1, "barbaz": 1, "qux": 1, "bar": 1}
    hot = spark.range(2_500).select(F.lit("p").alias("project_id"), F.concat(F.lit("/f"), F.col("id")).alias("path"), F.lit("go").alias("language"), F.lit("Hot").alias("symbol"), F.lit("").alias("signature"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    blocks = symbols.symbol_index(hot, 1_000).collect()
    assert len(blocks) == 3
    assert sum(b.places for b in blocks) == 2_500


def test_memory_search_can_be_exact(spark):
    rows = [(f"c{i:02}", "memory-cascade", "/hot", i, "x", [1.0, 0.0]) for i in range(20)] + [(f"d{i:02}", "memory-cascade", f"/p{i}", 0, "x", [0.5, 0.0]) for i in range(12)]
    vectors = spark.createDataFrame(rows, "chunk_id string, project_id string, path string, start_line int, content string, embedding array<double>")
    assert search.memory_search(vectors, [1.0, 0.0], 10).count() == 1
    got = search.memory_search(vectors, [1.0, 0.0], 10, exact=True).collect()
    assert len(got) == 10
    assert got[0].path == "/hot"


def test_batches_meet_in_blocks(spark):
    """Small blocks, ties, vectors of other lengths and nulls give the same as all pairs by hand."""
    import random

    r = random.Random(3)
    v = [(i, [float(r.randint(0, 3)) for _ in range(4)]) for i in range(120)] + [(500, None), (501, []), (502, [1.0, 2.0])]
    q = [(i, x) for i, x in v if i % 10 == 0]
    vectors = spark.createDataFrame(v, "chunk_id bigint, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([*q, (900, [1.0, 1.0]), (901, None)], "query_id bigint, query array<double>").repartition(2)
    for sent in (1 << 20, 0):
        search.SENT_BYTES = sent
        try:
            got = {(x.query_id, x["rank"]): (x.chunk_id, x.score) for x in search.batch_top_k(queries, vectors, 5, block=7).collect()}
        finally:
            search.SENT_BYTES = 64 << 20
        want = {}
        for qi, qv in [*q, (900, [1.0, 1.0])]:
            if qv:
                best = sorted((-sum(a * b for a, b in zip(qv, x)), i) for i, x in v if x and len(x) == len(qv))[:5]
                want |= {(qi, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
        assert got == want
