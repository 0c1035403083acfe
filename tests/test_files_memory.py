from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstone.operators import changes, files, memory, stats


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("/r/a.go", "a.go", "func Foo() {}\nfunc Bar() {}\n", dt.datetime(2025, 1, 1, 12)), ("/r/sub/b.md", "sub/b.md", "line1\nline2\nFoo\r\n", dt.datetime(2025, 1, 1, 10)),
        ("/r/sub/deep/er/c.txt", "sub/deep/er/c.txt", "", None), ("/r/bin", "bin", "\0Foo", dt.datetime(2025, 1, 1, 12)), ("/r/none", "none", None, dt.datetime(2025, 1, 1, 11, 30)), ("/r2/x", "x", "Foo", dt.datetime(2024, 1, 1)),
    ]
    return spark.createDataFrame(rows, "path string, rel_path string, content string, mod_time timestamp_ntz")


def test_grep(table):
    assert [(r.path, r.line) for r in files.grep(table, "Foo", root="/r").orderBy("path").collect()] == [("/r/a.go", 1), ("/r/sub/b.md", 3)]
    assert files.grep(table, "func [A-Z][a-z]+", regex=True).count() == 2
    assert files.grep(table, "foo").count() == 0
    assert files.grep_top(table, "func", 1).collect()[0].line == 1
    assert files.grep(table.limit(0), "x").count() == 0
    big = table.limit(1).withColumn("content", F.concat(F.lit("needle"), F.repeat(F.lit("x"), 1 << 20)))
    assert files.grep(big, "needle").count() == 0


def test_context_listing_tree(table):
    assert [r.content for r in files.context(table.where("path = '/r/sub/b.md'"), 2, 3).collect()] == ["line2\nFoo\r"]
    assert {r.path for r in files.listing(table).collect()} == {"/r/a.go", "/r/bin", "/r/none", "/r2/x"}
    got = {(r.path, r.type) for r in files.listing(table, "sub/**", True).collect()}
    assert {("/r/sub", "dir"), ("/r/sub/deep/er", "dir"), ("/r/sub/b.md", "file")} <= got
    tree = {(r.root, r.path, r.parent, r.depth, r.type) for r in files.tree(table, 2).collect()}
    assert ("/r", "sub", "", 1, "dir") in tree
    assert ("/r", "sub/deep", "sub", 2, "dir") in tree
    assert not any(t[3] > 2 for t in tree)


def test_recent(table):
    now = F.lit(dt.datetime(2025, 1, 1, 12, 10)).cast("timestamp_ntz")
    assert {r.path: r.mod_time for r in files.recent(table, now).collect()} == {"/r/a.go": "2025-01-01T12:00:00Z", "/r/bin": "2025-01-01T12:00:00Z", "/r/none": "2025-01-01T11:30:00Z"}
    edge = F.lit(dt.datetime(2025, 1, 1, 13)).cast("timestamp_ntz")
    assert files.recent(table, edge).count() == 0


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "path string, hash string")
    state = spark.createDataFrame([("a", "1"), ("b", "x"), ("gone", "9")], "path string, hash string")
    assert {r.path for r in changes.changed(now, state).collect()} == {"b", "c", "d"}
    assert [r.path for r in changes.deleted(now, state).collect()] == ["gone"]
    sent = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), "old"), (1, dt.datetime(2025, 1, 2), "new"), (2, None, "only")], "file_id int, seen_at timestamp_ntz, v string")
    assert {r.v for r in changes.latest(sent).collect()} == {"new", "only"}
    store = spark.createDataFrame([("x", 5, "old"), ("y", 1, "kept")], "chunk_id string, start_line int, v string")
    new = spark.createDataFrame([("x", 9, "b"), ("x", 2, "a"), ("z", None, "c")], "chunk_id string, start_line int, v string")
    assert {(r.chunk_id, r.v) for r in changes.upsert(store, new).collect()} == {("x", "a"), ("y", "kept"), ("z", "c")}
    assert changes.upsert(store.limit(0), new.limit(0)).count() == 0


def test_dimensions(spark):
    def v(*rows):
        return spark.createDataFrame([(list(map(float, r)),) for r in rows], "embedding array<double>")

    assert changes.check_dimension(v([1, 2], [3, 4])) == 2
    for bad, expected in ((v([1, 2], [1, 2, 3]), None), (v([1, 2]), 3), (v([1]).limit(0), None), (v([]), None)):
        with pytest.raises(changes.DimensionError):
            changes.check_dimension(bad, expected)


def test_counts(spark):
    rows = [("c1", "alpha", "/a", "s"), ("c2", "alpha", "/b", ""), ("c3", "beta", "/c", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, project_id string, path string, symbol string").withColumn("indexed_at", F.lit(dt.datetime(2025, 1, 1)))
    assert {r.project_id: r.chunks for r in stats.by_project(chunks).collect()} == {"alpha": 2, "beta": 1}
    assert tuple(stats.totals(chunks).first()) == (3, 1, 3)
    projects = spark.createDataFrame([("alpha", "/a"), ("gamma", "/g")], "project_id string, path string")
    assert {(r.project_id, r.chunks) for r in stats.project_status(projects, chunks).collect()} == {("alpha", 2), ("gamma", 0)}


TURN = "turn_id int, session_id string, provider string, ordinal int, role string, content string, exported_at timestamp_ntz"


def test_sessions(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "s", "cascade", 0, "user", "# hello", t), (1, "s", "cascade", 0, "user", "# hello", t + dt.timedelta(1)), (2, "s", "cascade", 1, None, "hi", t), (3, "s", "cascade", 2, "assistant", None, t), (4, "s", "cascade", 3, "system", "", t), (5, "s", None, None, "user", "hi", t)]
    turns = spark.createDataFrame(rows, TURN)
    got = memory.session_markdown(turns).first()
    assert got.content.count("### User") == 2
    assert "\\# hello" in got.content
    assert "- **Dialogue turns:** 3\n- **Extracted strings:** 2" in got.content
    assert tuple(memory.session_summary(turns).first()) == ("s", 3, 11, 2)
    assert memory.session_markdown(turns.limit(0)).count() == 0
    assert {r.path for r in memory.session_markdown(turns, part_turns=1).collect()} == {"/memory/chats/s.md", "/memory/chats/s-1.md"}
    kept = {(r.turn_id, r.role) for r in memory.long_enough(turns, 3).collect()}
    assert (5, "user") not in kept
    assert (4, "system") in kept


def test_notes(spark):
    t = dt.datetime(2025, 2, 23, 8, 22, 11)
    rows = [(1, "Fetch it", "body", ["x", "y"], "cursor", t), (1, "Fetch it", "body", ["x", "y"], "cursor", t), (2, None, None, None, None, t), (3, "", "c", [], "", t)]
    notes = spark.createDataFrame(rows, "note_id int, title string, content string, tags array<string>, provider string, written_at timestamp_ntz")
    made = {r.note_id: r for r in memory.note_files(notes).collect()}
    assert made[1].path == "/memory/cursor/20250223-082211-fetch-it.md"
    assert made[1].content == "# Fetch it\n\n- **Provider:** cursor\n- **Tags:** x, y\n- **Saved:** 2025-02-23T08:22:11Z\n\nbody\n"
    assert made[2].path.endswith("-note.md")
    assert "Tags" not in made[3].content
    assert {r.provider for r in memory.listed(memory.note_files(notes)).collect()} == {"cursor", "cascade"}
    assert memory.listed(memory.note_files(notes), "cursor").count() == 1


def test_a_long_session_is_one_text(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, "s", "cascade", ordinal, "user", text, t) for i, (ordinal, text) in enumerate([(0, "hi"), (5_000, "hi"), (12_000, "yo"), (None, "so")])]
    turns = spark.createDataFrame(rows, TURN)
    (whole,) = memory.session_markdown(turns).collect()
    assert whole.path == "/memory/chats/s.md"
    assert "**Decrypted size:** 8 bytes\n- **Dialogue turns:** 4\n- **Extracted strings:** 3\n" in whole.content
    parts = memory.session_markdown(turns, part_turns=5_000).orderBy("path").collect()
    assert [r.path for r in parts] == ["/memory/chats/s-1.md", "/memory/chats/s-2.md", "/memory/chats/s.md"]
    assert all("**Decrypted size:** 8 bytes\n- **Dialogue turns:** 4\n- **Extracted strings:** 3\n" in r.content for r in parts)
    assert sum(r.content.partition("## All extracted strings")[2].count("hi\n") for r in parts) == 1


def test_grep_without_a_limit(table):
    big = table.limit(1).withColumn("content", F.concat(F.lit("needle"), F.repeat(F.lit("x"), 1 << 20)))
    assert files.grep(big, "needle", most_bytes=None).count() == 1
    assert files.grep_top(big, "needle", most_bytes=None).count() == 1
