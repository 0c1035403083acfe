from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.functions.glob import GlobError, glob_regex, rule_regex
from quillstone.operators import rules
from quillstone.operators.rules import Rule

import re

CASES = [
    ("main.go", 100, True), ("README.md", 100, True), ("main_test.go", 100, False), ("vendor/lib.go", 100, False), (".git/FETCH_HEAD", 100, False),
    (".git/objects/maintenance.lock", 100, False), ("big.go", 2097152, False), ("data/file_hashes.json", 100, False), ("data/cc21aa19/2fb51258.gob", 100, False), ("notdata/file.go", 100, True),
]


def judged(spark, rule, cases):
    df = spark.createDataFrame([(r, s) for r, s, _ in cases], "rel string, size bigint")
    got = {r.rel: r.ok for r in df.select("rel", rules.should_index(rule, F.col("rel"), F.col("size")).alias("ok")).collect()}
    return [got[r] for r, _, _ in cases]


def test_truth_tables(spark):
    rule = Rule(extensions=(".go", ".md"), exclude=("**/*_test.go", "data"), max_file_size_mb=1)
    assert judged(spark, rule, CASES) == [w for *_, w in CASES]
    assert judged(spark, Rule(extensions=(".go",), include=("src/**",)), [("main.go", 1, False), ("src/app.go", 1, True)]) == [False, True]
    defaults = [("main.go", 1, True), (".git/FETCH_HEAD", 1, False), ("vendor/lib.go", 1, False), ("node_modules/pkg/index.js", 1, False), ("a/vendor/x.go", 1, True)]
    assert judged(spark, Rule(), defaults) == [w for *_, w in defaults]


def test_capital_patterns_never_match_and_size_zero_is_no_limit(spark):
    assert judged(spark, Rule(include=("SRC/**",)), [("SRC/a.go", 1, False)]) == [False]
    assert judged(spark, Rule(max_file_size_mb=0), [("a.go", 1 << 40, True)]) == [True]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*.go", ["a.go"], ["d/a.go", "a.goo"]), ("**/*.go", ["a.go", "d/e/a.go"], ["a.py"]), ("src/**", ["src", "src/a", "src/a/b"], ["xsrc/a"]), ("a?c", ["abc"], ["ac", "a/c"]),
        ("[a-c]x", ["bx"], ["dx"]), ("[!a]x", ["bx"], ["ax"]), ("{a,b}.md", ["a.md", "b.md"], ["c.md"]), ("a.b", ["a.b"], ["axb"]), ("**", ["", "x/y"], []), ("a\\*b", ["a*b"], ["axb"]),
    ],
)
def test_globs(pattern, yes, no):
    rx = re.compile(glob_regex(pattern))
    assert all(rx.match(p) for p in yes)
    assert not any(rx.match(p) for p in no)


def test_bad_globs():
    for p in ("[a", "{a"):
        with pytest.raises(GlobError):
            glob_regex(p)
        assert not re.match(rule_regex(p), p)


def test_rules_of_projects(spark):
    projects = spark.createDataFrame([("p", None, [], ["data"], 0), ("q", [".py"], ["src/**"], None, 1)], "project_id string, extensions array<string>, include array<string>, exclude array<string>, max_file_size_mb int")
    rows = [("p", "a.go", 1), ("p", "data/a.go", 1), ("q", "src/a.py", 1), ("q", "a.py", 1), ("q", "src/a.py2", 1), ("q", "src/b.py", 2 << 20), (None, "a.go", 1), ("zz", "a.go", 1), ("p", None, 1)]
    files = spark.createDataFrame(rows, "project_id string, rel_path string, size bigint")
    got = {(r.project_id, r.rel_path): r.indexed for r in rules.with_rules(files, projects).collect()}
    assert [k for k, v in got.items() if v] == [("p", "a.go"), ("q", "src/a.py")]
    assert len(got) == len(rows)
    assert rules.with_rules(files.limit(0), projects).count() == 0


def test_ignore_files(spark):
    files = spark.createDataFrame([("/r", p) for p in ("a.log", "d/a.log", "d/keep.log", "build/x", "d/build/y", "src/only.txt", "d/src/only.txt", "ok.txt")], "root string, rel_path string")
    ignores = spark.createDataFrame([("/r", "", "# comment\n*.log\nbuild/\n/src/*.txt\n"), ("/r", "d", "!keep.log\n")], "root string, dir string, content string")
    got = {r.rel_path: r.ignored for r in rules.ignored(files, ignores).collect()}
    assert {p for p, v in got.items() if v} == {"a.log", "d/a.log", "d/keep.log", "build/x", "d/build/y", "src/only.txt"}
    assert not any(r.ignored for r in rules.ignored(files, ignores.limit(0)).collect())


def test_allowed_paths(spark):
    paths = spark.createDataFrame([("/tmp",), ("/tmp/inside",), ("/tmp2",), ("/tmp2/inside",), (None,)], "path string")
    projects = spark.createDataFrame([("/tmp",), ("/other/",)], "path string")
    assert {r.path for r in rules.allowed_paths(paths, projects).collect()} == {"/tmp", "/tmp/inside"}
