from __future__ import annotations

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillstone.engine import Engine, ToolError
from quillstone.operators.rules import Rule
from quillstone.plans.index import Index
from quillstone.plans.memory import Memory
from quillstone.plans.progress import Progress, State
from quillstone.sources import chats, chunking, config, scan, sink
from quillstone.streaming.watch import debounce, distinct_until_changed, every, follow

FILES = "project_id string, path string, rel_path string, content string, mod_time timestamp_ntz, hash string, size bigint"


def row(project, rel, content):
    return (project, f"/w/{project}/{rel}", rel, content, dt.datetime(2025, 1, 1), None, len(content or ""))


@pytest.fixture
def files(spark):
    rows = [row("p", "a.go", "package a\n\nfunc Alpha() int {\n\treturn 1\n}\n\ntype Beta struct {\n\tX int\n}\n"), row("p", "b.md", "intro\n# One\ntext\n## Two\nmore\n"), row("q", "c.py", "class C:\n    def m(self):\n        pass\n\n\ndef lone():\n    return 2\n"), row("q", "LICENSE", "free\n"), row("q", "none.go", None)]
    return spark.createDataFrame(rows, FILES)


PROJECTS = "project_id string, path string, extensions array<string>, include array<string>, exclude array<string>, max_file_size_mb int"


@pytest.fixture
def projects(spark):
    return spark.createDataFrame([("p", "/w/p", None, None, None, 0), ("q", "/w/q", None, None, None, 0)], PROJECTS)


def test_chunks(files):
    got = {(r.path.rsplit("/", 1)[1], r.symbol, r.start_line, r.end_line) for r in chunking.chunk(files).collect()}
    assert got == {("a.go", "Alpha", 3, 5), ("a.go", "Beta", 7, 9), ("b.md", "# One", 2, 4), ("b.md", "## Two", 4, 6), ("c.py", "C", 1, 3), ("c.py", "lone", 6, 7), ("LICENSE", "LICENSE", 1, 2)}


def test_markdown_edges(spark):
    text = "pre\n# A\nbody\n## B x\n```\n# in code\n```\n"
    df = spark.createDataFrame([row("p", "x.md", text), row("p", "y.md", "no header"), row("p", "z.md", ""), row("p", "w.md", "# A\n# A\n")], FILES)
    got = sorted((r.path[-4:], r.symbol, r.start_line, r.end_line) for r in chunking.chunk(df).collect())
    assert got == [("w.md", "# A", 1, 2), ("w.md", "# A", 2, 3), ("x.md", "# A", 2, 4), ("x.md", "# in code", 6, 8), ("x.md", "## B x", 4, 6), ("y.md", "y.md", 1, 1), ("z.md", "z.md", 1, 1)]
    assert chunking.chunk(df.limit(0)).count() == 0


def test_chunks_agree_with_the_given_table(spark, sf):
    files = spark.read.parquet(f"{sf}/files.parquet")
    given = {r.chunk_id for r in spark.read.parquet(f"{sf}/chunks.parquet").select("chunk_id").collect()}
    mine = {r.chunk_id for r in chunking.chunk(files.dropDuplicates(["file_id"])).select("chunk_id").collect()}
    # files that do not parse are cut otherwise
    assert len(mine & given) >= 0.95 * len(given)


def test_index_follows_its_files(spark, files, projects, tmp_path):
    index = Index(spark, str(tmp_path))
    assert index.chunks().count() == 0
    assert index.update(files, projects) == {"changed": 3, "deleted": 0, "chunks": 6}
    assert index.update(files, projects)["changed"] == 0
    other = files.where("rel_path <> 'b.md'").withColumn("content", F.when(F.col("rel_path") == "c.py", "def lone():\n    return 3\n").otherwise(F.col("content")))
    assert index.update(other, projects) == {"changed": 1, "deleted": 1, "chunks": 1}
    assert sorted((r.project_id, r.symbol) for r in index.chunks().collect()) == [("p", "Alpha"), ("p", "Beta"), ("q", "lone")]
    assert index.state().count() == 2
    assert index.rebuild(files, projects)["chunks"] == 6
    assert index.chunks().where("size(embedding) = 64").count() == 6
    index.remove("p")
    assert {r.project_id for r in index.chunks().collect()} == {"q"}
    gone = files.where("rel_path = 'c.py'").select("project_id", "path")
    assert index.update_paths(gone, files.limit(0), projects)["deleted"] == 1
    assert index.chunks().count() == 0


def test_an_update_rewrites_the_buckets_of_its_paths_only(spark, tmp_path):
    rows = [(f"p{i % 2}", f"/w/p{i % 2}/f{i}.md", f"f{i}.md", f"# T{i}\ntext {i}\n") for i in range(60)]
    files = spark.createDataFrame(rows, "project_id string, path string, rel_path string, content string")
    index = Index(spark, str(tmp_path), buckets=4)
    index.update(files)

    def written():
        return {os.path.join(d, n) for d, _, names in os.walk(tmp_path / "chunks") for n in names if n.endswith(".parquet")}

    before = written()
    assert len({os.path.dirname(f) for f in before}) == 8
    one = files.where("path = '/w/p0/f0.md'")
    assert index.update_paths(one.select("path"), one.withColumn("content", F.lit("# New\n"))) == {"changed": 1, "deleted": 0, "chunks": 1}
    assert len({os.path.dirname(f) for f in before - written()}) == 1
    assert index.chunks().count() == 60
    # a bucket that is emptied reads as empty
    assert index.update_paths(files.select("path"), files.limit(0))["deleted"] == 60
    assert index.chunks().count() == 0 and index.state().count() == 0
    assert index.update(files)["chunks"] == 60


def test_saved_stats(spark, files, projects, tmp_path):
    index = Index(spark, str(tmp_path))
    assert index.stats().count() == 0
    index.update(files, projects)
    assert {(r.project_id, r.files, r.chunks) for r in index.save_stats().collect()} == {("p", 2, 4), ("q", 1, 2)}
    index.remove("p")
    assert index.stats().count() == 2


def test_memory_follows_its_notes(spark, tmp_path):
    schema = "path string, provider string, content string"
    notes = spark.createDataFrame([("/m/a.md", "cascade", "# A\nalpha\n"), ("/m/b.md", "cascade", "# B\nbeta\n# C\ngamma\n"), ("/m/c.md", "other", "# D\nalpha\n"), ("/m/c.md", "other", "# D\nalpha\n"), ("/m/d.md", None, None), (None, "x", "# E\n")], schema)
    memory = Memory(spark, str(tmp_path))
    assert memory.search("alpha").count() == 0
    assert memory.sync(notes) == {"changed": 3, "deleted": 0, "chunks": 4}
    assert memory.sync(notes) == {"changed": 0, "deleted": 0, "chunks": 0}
    assert memory.search("alpha").first().path == "/m/a.md"
    assert [r.path for r in memory.search("alpha", provider="other").collect()] == ["/m/c.md"]
    assert memory.sync(notes.where("path = '/m/b.md'")) == {"changed": 0, "deleted": 2, "chunks": 0}
    assert {r.project_id for r in memory.state().collect()} == {"memory-cascade"}
    assert memory.write(spark.createDataFrame([("/m/b.md", "cascade", "# F\nnew\n")], schema))["chunks"] == 1
    assert {r.symbol for r in memory.chunks().collect()} == {"# F"}
    assert memory.forget(notes.select("path"))["deleted"] == 1
    assert memory.chunks().count() == 0


def test_chat_providers(spark, tmp_path):
    def field(number, data):
        return bytes([(number << 3 | 2) & 127 | (128 if number > 15 else 0), *([number >> 4] if number > 15 else []), len(data)]) + data

    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "s1.pb").write_bytes(field(2, field(19, b"hello") + field(20, b"hi there")))
    (tmp_path / "other.txt").write_text("x")
    got = chats.turns(spark, str(tmp_path), "cascade").orderBy("ordinal").collect()
    assert [(r.session_id, r.role, r.content) for r in got] == [("s1", "user", "hello"), ("s1", "assistant", "hi there")]
    assert chats.sessions(spark, str(tmp_path / "missing"), "cascade").count() == 0
    chats.register(chats.Provider("notes", "*.txt", lambda files, key: files.select("path", F.lit(0).alias("ordinal"), F.lit("user").alias("role"), F.decode("content", "UTF-8").alias("content"))))
    assert [(r.session_id, r.content) for r in chats.turns(spark, str(tmp_path), "notes").collect()] == [("other", "x")]


def test_index_does_not_keep_ignored_files(spark, files, projects, tmp_path):
    ignores = spark.createDataFrame([("/w/q", "", "*.py\n")], "root string, dir string, content string")
    index = Index(spark, str(tmp_path))
    index.update(files, projects, ignores)
    assert {r.path for r in index.state().collect()} == {"/w/p/a.go", "/w/p/b.md"}


def test_engine(spark, files, projects, tmp_path):
    notes = spark.createDataFrame([("/m/n.md", "cascade", "# Note\n\n- **Provider:** cascade\n\nalpha beta\n")], "path string, provider string, content string")
    e = Engine(spark, str(tmp_path / "index"), files, projects, notes)
    assert e.search_codebase("alpha").count() == 0
    e.rebuild_index()
    assert e.search_codebase("func Alpha return").first().symbol == "Alpha"
    assert "content" not in e.search_codebase("Alpha", include_content=False).columns
    assert e.query_documentation("more").first().symbol == "## Two"
    assert [r.symbol for r in e.find_symbol("alpha").collect()] == ["Alpha"]
    assert e.search("alpha", source="memory").count() == 0
    assert e.sync_memory() == {"changed": 1, "deleted": 0, "chunks": 1}
    assert e.search("alpha", source="memory").first().path == "/m/n.md"
    assert e.get_file_context("/w/p/b.md", 2, 3).first().content == "# One\ntext"
    assert e.fs_read("/w/p/b.md").first().content.endswith("more\n")
    assert [r.line for r in e.grep("func", "p").collect()] == [3]
    assert e.fs_grep("/w/p", "text").count() == 1
    assert [r.path for r in e.list_files("p", pattern="*.md").collect()] == ["/w/p/b.md"]
    assert e.fs_list("/w/q").count() == 3
    assert e.directory_tree("p").count() == 2
    assert e.fs_tree("/w", 1).count() == 2
    assert e.get_recent_changes("p", now=dt.datetime(2025, 1, 1, 0, 30)).count() == 2
    assert {r.project_id: r.chunks for r in e.get_index_status().collect()} == {"p": 4, "q": 2}
    assert e.reindex_files(["/w/p"])["changed"] == 0
    assert e.rebuild_project("q")["chunks"] == 2
    state = e.progress.load()
    assert state.job_id.startswith("project:q-")
    assert e.get_index_job(state.job_id).status == "done"
    assert e.rebuild_memory() == 1
    assert e.add_project("/w/new", "p", str(tmp_path / "conf"), extensions=[".go"]) == "p-1"
    assert json.load(open(tmp_path / "conf" / "p-1.json"))["extensions"] == [".go"]
    e.edit_project("p-1", exclude=["x"])
    assert e.projects.where("project_id = 'p-1'").first()["exclude"] == ["x"]
    e.remove_project("p-1", str(tmp_path / "conf"))
    assert not os.path.exists(tmp_path / "conf" / "p-1.json")
    path = e.memory_write("My Title", "text", ["t"])
    assert e.memory_list("cascade").count() == 2
    assert e.memory_read(path).first().content.startswith("# My Title")
    assert path in {r.path for r in e.memory_search("My Title text").collect()}
    for call, reason in ((lambda: e.search_codebase(" "), "empty_query"), (lambda: e.resolve("zz"), "project_not_found"), (lambda: e.get_index_job("x"), "job_not_found"), (lambda: e.get_file_context("/w2/x"), "path_not_allowed"), (lambda: e.search("x", source="?"), "invalid_argument"), (lambda: e.resolve("p", "../q/../../etc"), "path_not_allowed")):
        with pytest.raises(ToolError) as x:
            call()
        assert x.value.reason == reason


def test_scan(spark, tmp_path):
    for rel, data in {"a.go": b"package a\n", ".hidden/x.md": b"# x\n", "_under/y.py": b"y = 1\n", "d/bin": b"\0\1"}.items():
        os.makedirs(os.path.dirname(tmp_path / rel), exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    (tmp_path / "d" / ".gitignore").write_text("*.log\n")
    got = {r.rel_path: r for r in scan.scan(spark, str(tmp_path), "p").collect()}
    assert set(got) == {"a.go", ".hidden/x.md", "_under/y.py", "d/bin", "d/.gitignore"}
    assert got["d/bin"].content is None
    assert got["a.go"].size == 10
    assert [tuple(r) for r in scan.ignore_files(scan.scan(spark, str(tmp_path), "p")).collect()] == [(str(tmp_path), "d", "*.log\n")]


def field(n, data):
    def num(v):
        out = b""
        while v > 0x7F:
            out += bytes([v & 0x7F | 0x80])
            v >>= 7
        return out + bytes([v])

    return num(n << 3 | 2) + num(len(data)) + data


def test_dialogue(spark):
    good = field(1, b"x") + field(2, field(19, b"hello world")) + field(2, field(20, b"hi there"))
    rows = [("a", bytearray(good)), ("b", bytearray(good[:-3])), ("c", bytearray(b"")), ("d", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = sorted((r.path, r.ordinal, r.role, r.content) for r in scan.dialogue(df).collect())
    assert got == [("a", 0, "user", "hello world"), ("a", 1, "assistant", "hi there"), ("b", 0, "user", "hello world")]
    assert [scan.varint(bytes(b), 0)[0] for b in ([1], [0x96, 1])] == [1, 150]
    with pytest.raises(scan.Malformed):
        scan.varint(b"\x80\x80", 0)
    key = b"0123456789abcdef"
    sealed = df.where("path = 'a'").withColumn("content", F.aes_encrypt("content", F.lit(key), F.lit("GCM")))
    assert scan.dialogue(sealed, key).count() == 2
    assert scan.chat_strings(sealed, key).first().strings == ["hello world", "hi there"]


def test_project_files(spark, tmp_path):
    assert scan.project_files(spark, str(tmp_path / "none")).count() == 0
    config.save_project(str(tmp_path), Rule(path="/some/path", name="my/project", max_file_size_mb=5))
    assert os.listdir(tmp_path) == ["my_project.json"]
    assert scan.project_files(spark, str(tmp_path)).first().max_file_size_mb == 5
    config.delete_project(str(tmp_path), "my/project")
    config.delete_project(str(tmp_path), "my/project")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        scan.project_files(spark, str(tmp_path)).collect()


def test_written_texts(spark, tmp_path):
    rows = spark.createDataFrame([("/a/b.md", "# ü"), ("c.md", ""), ("d.md", None), (None, "x")], "path string, content string")
    assert {tuple(r) for r in sink.write_texts(rows, str(tmp_path)).collect()} == {("/a/b.md", 4), ("c.md", 0)}
    assert (tmp_path / "a" / "b.md").read_text() == "# ü"
    with pytest.raises(Exception, match="leads out"):
        sink.write_texts(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path)).collect()


def test_progress(tmp_path):
    p = Progress(str(tmp_path / "p" / "state.json"))
    assert p.load().status == "idle"
    s = p.start("index", total_files=3)
    assert s.job_id.startswith("index-")
    p.update(phase="embed", total_chunks=1000, done_chunks=100)
    s = p.load()
    assert s.eta(s.started_at + 120) == 1080
    assert [State().eta(1), p.done(done_chunks=1000).eta(1e12), p.fail(ValueError("x")).eta(1e12)] == [0, 0, 0]
    assert p.load().error == "x"


def test_config():
    env = {"A": "x", "HOME": "/h", "QUILLSTONE_EMBEDDING_DIM": "8", "QUILLSTONE_DATA_DIR": "${A}/${B:-y}"}
    assert config.interpolate("${A}-${B}-${B:-d}", env) == "x--d"
    assert config.interpolate("~/z", env) == "/h/z"
    c = config.Config.from_env(env)
    assert (c.embedding_dim, c.data_dir) == (8, "x/y")
    with pytest.raises(ValueError):
        config.Config.from_env({"QUILLSTONE_SYNC_MINUTES": "0"})
    assert config.unique_name("a", {"a", "a-1"}) == "a-2"


EVENTS = "root string, ts timestamp_ntz, path string"


def burst_rows():
    t = dt.datetime(2025, 1, 1)
    return [("r", t + dt.timedelta(seconds=s), p) for s, p in ((0, "a"), (2.0, "b"), (4.000001, "a"), (10, "c"), (10, "c"))]


def test_debounce(spark):
    got = sorted((r.events, r.paths) for r in debounce(spark.createDataFrame(burst_rows(), EVENTS)).collect())
    assert got == [(1, ["a"]), (2, ["a", "b"]), (2, ["c"])]


def test_debounce_streams(spark, tmp_path):
    spark.createDataFrame(burst_rows(), EVENTS).write.parquet(str(tmp_path / "in"))
    late = [("r", dt.datetime(2025, 1, 1, 1), "z"), ("r", dt.datetime(2025, 1, 1, 2), "z")]
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = debounce(stream, delay="1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame(late[:1], EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    spark.createDataFrame(late[1:], EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.events for r in spark.table("bursts").collect()) == [1, 1, 2, 2] or sorted(r.events for r in spark.table("bursts").collect()) == [1, 2, 2]


def test_follow_keeps_the_index(spark, files, projects, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.update(files, projects)
    gone = files.where("rel_path = 'b.md'").select("project_id", "path")
    gone.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("project_id string, path string").parquet(str(tmp_path / "in"))
    there = files.where("rel_path <> 'b.md'")
    q = follow(stream, lambda paths: there.join(paths.select("path"), "path", "left_semi").select(there.columns), index, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    assert q.exception() is None
    assert "/w/p/b.md" not in {r.path for r in index.state().collect()}
    assert index.state().count() == 2


def test_a_snapshot_is_taken_every_period(spark, files, projects, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    now = {"files": files.where("rel_path = 'a.go'")}
    q = every(spark, lambda: index.update(now["files"], projects), str(tmp_path / "cp"), "1 second")
    try:
        for want in (1, 3):
            end = time.time() + 120
            while time.time() < end and index.state().count() != want and q.exception() is None:
                time.sleep(1)
            assert q.exception() is None and index.state().count() == want
            now["files"] = files
    finally:
        q.stop()


def test_memory_files(spark, tmp_path):
    (tmp_path / "cascade").mkdir()
    (tmp_path / "cascade" / "a.md").write_text("# A\n\n- **Provider:** other\n")
    (tmp_path / "cascade" / "b.md").write_text("# B\n")
    (tmp_path / "cascade" / "c.txt").write_text("x")
    assert {(os.path.basename(r.path), r.provider) for r in scan.memory_files(spark, str(tmp_path)).collect()} == {("a.md", "other"), ("b.md", "cascade")}


def test_changed_rules_hold_from_the_next_batch_on(spark, files, projects, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    rules = {"now": projects}
    files.select("project_id", "path").where("rel_path = 'b.md'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("project_id string, path string").parquet(str(tmp_path / "in"))

    def run():
        q = follow(stream, lambda paths: files.join(paths.select("path"), "path", "left_semi").select(files.columns), index, str(tmp_path / "cp"), projects=lambda: rules["now"], availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    assert {r.path for r in index.state().collect()} == {"/w/p/b.md"}
    rules["now"] = projects.withColumn("extensions", F.array(F.lit(".py")))
    files.select("project_id", "path").where("rel_path <> 'b.md'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.path for r in index.state().collect()} == {"/w/p/b.md", "/w/q/c.py"}


def test_distinct_until_changed(spark):
    rows = [("j", "running", 1, 1), ("j", "running", 1, 2), ("j", "running", 2, 3), ("k", "idle", 0, 1)]
    df = spark.createDataFrame(rows, "job_id string, status string, done int, updated_at int")
    assert sorted((r.job_id, r.updated_at) for r in distinct_until_changed(df).collect()) == [("j", 1), ("j", 3), ("k", 1)]
