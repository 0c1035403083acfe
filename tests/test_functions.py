from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillstone.functions import bytes as fb
from quillstone.functions import text as ft
from quillstone.functions import vectors as fv
from quillstone.sources.embedder import HashedEmbedder, ServiceEmbedder


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("title", "want"), [("Fetch Frozen_batch", "fetch-frozen-batch"), ("  a/b\\c:d ", "a-b-c-d"), ("Ärger!", "rger"), ("", "note"), (None, "note"), ("***", "note"), ("a" * 80, "a" * 60), ("a  b", "a--b")])
def test_slug(spark, title, want):
    assert one(spark, title, ft.slug) == want


def test_text(spark):
    assert one(spark, "/a/b.C.GO", ft.extension) == ".go"
    assert one(spark, "/a.b/c", ft.extension) == ""
    assert one(spark, "/x/y.mjs", ft.language) == "javascript"
    assert one(spark, "/x/y", ft.language) == ""
    assert one(spark, "a\nb\n", lambda c: F.size(ft.lines(c))) == 3
    assert one(spark, "x" * 800, ft.preview) == "x" * 800
    assert one(spark, "x" * 801, ft.preview) == "x" * 800 + "..."
    assert one(spark, "project:some-name-with-hyphens-123", ft.job_prefix) == "project:some-name-with-hyphens"
    assert one(spark, "plain", ft.job_prefix) == "plain"
    assert one(spark, "# t\n\n- **Provider:** other\n", ft.note_provider) == "other"
    assert one(spark, "# t\n", ft.note_provider) == "cascade"
    assert one(spark, "12a", ft.int_or_zero) == 0


@pytest.mark.parametrize(("s", "e", "want"), [(2, 4, "b\nc\nd"), (0, 0, "a\nb\nc\nd\ne\n"), (5, 99, "e\n"), (9, 3, None), (-1, 1, "a")])
def test_line_range(spark, s, e, want):
    assert one(spark, "a\nb\nc\nd\ne\n", lambda c: ft.line_range(c, F.lit(s), F.lit(e))) == want


def test_eta(spark):
    def eta(status, total, done, elapsed):
        return spark.range(1).select(ft.eta_seconds(F.lit(status), F.lit(total), F.lit(done), F.lit(elapsed)).alias("y")).first()["y"]

    assert eta("running", 1000, 100, 120.0) == 1080
    assert [eta("idle", 1000, 100, 120.0), eta("running", 1000, 0, 1.0), eta("running", 0, 0, 1.0), eta("running", 5, 5, 1.0)] == [0, 0, 0, 0]


def test_under(spark):
    rows = spark.createDataFrame([("/tmp", "/tmp"), ("/tmp/a", "/tmp"), ("/tmp2", "/tmp"), ("/x", "/"), ("x", "")], "p string, r string")
    assert [r.y for r in rows.select(ft.under(F.col("p"), F.col("r")).alias("y")).collect()] == [True, True, False, True, True]


def test_bytes(spark):
    assert one(spark, bytearray(b"abcd\0abcd\tjkl"), fb.printable_runs, "binary") == ["abcd", "abcd\tjkl"]
    assert one(spark, bytearray(b"a\0b"), fb.is_text, "binary") is False
    assert one(spark, bytearray(b"a" * 600 + b"\0"), fb.is_text, "binary") is True
    key = F.lit(b"0123456789abcdef")
    sealed = spark.range(1).select(F.aes_encrypt(F.lit("hello"), key, F.lit("GCM")).alias("x"))
    assert sealed.select(fb.decrypted(F.col("x"), key).cast("string").alias("y")).first()["y"] == "hello"
    assert sealed.select(fb.decrypted(F.substring("x", 1, 8), key).alias("y")).first()["y"] is None


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in rows.select(fv.dot(F.col("a"), F.col("b")), F.round(fv.cosine(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [(24.0, 0.96), (0.0, 0.0)]


def test_hashed_embedder_is_the_same_in_both_forms(spark):
    e = HashedEmbedder(16)
    for text in ("The Cursor, the cursor and 9 leases", "", None, "ÄÖ"):
        got = e.embed(spark.createDataFrame([(text,)], "content string")).first()["embedding"]
        assert got == pytest.approx(e.query(text or ""))
        assert math.isclose(sum(x * x for x in got), 1.0, abs_tol=1e-9) or not any(got)


def test_service_embedder_orders_by_index_and_retries(spark):
    calls = []

    def post(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("busy")
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    e = ServiceEmbedder(post, 2, batch=2, wait=0.0)
    assert e._vectors(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]]
    assert calls == [2, 2]

    def fine(texts):
        return [(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)]

    rows = spark.createDataFrame([("a",), ("bbb",), (None,)], "content string")
    assert sorted(tuple(r.embedding) for r in ServiceEmbedder(fine, 2, batch=2).embed(rows).collect()) == [(0.0, 1.0), (1.0, 1.0), (3.0, 1.0)]
