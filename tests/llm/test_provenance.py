from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.llm import provenance as P
from quillstone.llm.queries import LAYOUT

CODE = "import x\n\n\ndef run(a, b):\n    for i in a:\n        b.append(i)\n    return b\n"
SCHEMA = "file_id bigint, project_id string, path string, rel_path string, content string"
UPSTREAM = "lib_name string, version string, file_name string, home_project string, content string"


def row(i, project, rel, content=CODE):
    return (i, project, f"/srv/src/{project}/{rel}", rel, content)


@pytest.mark.parametrize(
    "text",
    [
        "// Code generated by apimint. DO NOT EDIT.\npackage a\n", "/*\n * AUTO-GENERATED FILE (x)\n */\n", "// <auto-generated> stubmaker </auto-generated>\n", "# @generated by tablegen from a.schema\n", "// This file was automatically generated by x 2.4; changes will be lost.\n", "x = 1\n\n// Do not edit this file directly. Run `x` to recreate it.\n",
        "// Generated by the x compiler.  DO NOT EDIT!\n", "// Autogenerated by x on build, do not modify by hand\n",
    ],
)
def test_markers(text):
    assert P.marked(text)


@pytest.mark.parametrize("text", ['banner = "Code generated by tool. DO NOT EDIT."\n', "// looks for files marked 'auto-generated file (tool)' and skips them\n", "// ids below are generated by the server, do not edit the stored ones\n", "# Do not split the hash by hand\n", ""])
def test_no_markers(text):
    assert not P.marked(text)


def test_shapes():
    assert P.dense("var a=function(b){for(var i=0,n=b.length;i<n;i++)c(i)};function d(e){return e.map(function(f){return f.k})}" * 6)
    assert not P.dense(CODE * 20)
    assert P.bulk("var x = []byte{\n" + "\t1, 22, 133, 4, 250,\n" * 60 + "}\n")
    assert P.bulk('export const note = "' + "zFHB6DYhO67Gii+qyxXq" * 40 + '";\n')
    assert P.bulk("[\n" + '  {"id": 174, "lat": 31.98952, "lon": 37.49835},\n' * 30 + "]\n")
    assert not P.bulk(CODE * 20)
    assert P.foreign("// Copyright 2023 the x-kit authors.\n", "fastfold") and not P.foreign("// Copyright 2023 the fastfold authors.\n", "fastfold")
    assert P.foreign("// Copied unchanged from markerly 1.8 (https://x.example).\n", "p")
    assert P.foreign("# filter-rs v2.1.0 - https://filter-rs.example\n", "p")
    assert not P.foreign("// plain words\n", "p")


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("*.pb.go", ["a.pb.go", "d/a.pb.go"], ["a.go"]), ("/gen/**", ["gen/a"], ["d/gen/a"]), ("docs/*.txt", ["docs/a.txt"], ["d/docs/a.txt", "docs/d/a.txt"]), ("vendor/", ["vendor/a/b", "x/vendor/a"], ["vendor"]), ("a/**/b", ["a/b", "a/c/d/b"], ["a/c"]), ("[ab].c", ["a.c"], ["c.c"])],
)
def test_attribute_globs(glob, yes, no):
    import re

    rx = re.compile(P.glob_regex(glob))
    assert all(rx.search(p) for p in yes)
    assert not any(rx.search(p) for p in no)


def test_attributes_and_their_precedence(spark):
    rows = [
        row(1, "p", ".gitattributes", "# c\n*.gen.py linguist-generated\nlib/** linguist-vendored=true\nlib/own.py -linguist-vendored\n"), row(2, "p", "deep/.gitattributes", "*.gen.py linguist-generated=false\nx.py linguist-generated\n"),
        row(3, "p", "a.gen.py"), row(4, "p", "deep/a.gen.py"), row(5, "p", "deep/more/x.py"), row(6, "p", "lib/z.py"), row(7, "p", "lib/own.py"), row(8, "p", "x.py"), row(9, "q", "a.gen.py"),
    ]
    files = spark.createDataFrame(rows, SCHEMA)
    rules = P.attribute_rules(files)
    paths = files.select("file_id", F.col("project_id").alias("project"), "rel_path")
    assert {r.file_id: r.excluded for r in P.declared(paths, rules).collect()} == {3: True, 4: False, 5: True, 6: True, 7: False}
    found = {r.file_id for r in P.provenance_found(files, spark.createDataFrame([], UPSTREAM)).collect()}
    assert {3, 5, 6} <= found
    assert not found & {4, 7, 8}


def body(n):
    return "\n".join(f"def name_{n}_{i}(a{i}, b{i}):\n    return a{i} * {n * 7 + i} + b{i}.method_{n}_{i}(key_{i})\n" for i in range(12))


def test_copies(spark):
    up = spark.createDataFrame([("lib", "1.0", "a.py", "home", body(1)), ("lib", "1.0", "b.py", None, body(2))], UPSTREAM)
    rows = [row(1, "p", "src/a.py", body(1)), row(2, "home", "src/a.py", body(1)), row(3, "p", "src/c.py", "# kept in tree\n" + body(2).replace("name_2_3", "renamed")), row(4, "p", "src/d.py", body(3)), row(5, "p", "src/e.py", body(1)[: len(body(1)) // 2]), row(6, "p", "n.py", None)]
    files = spark.createDataFrame(rows, SCHEMA).withColumn("copied", F.lit("clash")).withColumn("project", F.lit("clash"))
    assert {r.file_id for r in P.evidence(files, up).where("copied").collect()} == {1, 3, 5}
    assert P.evidence(files.limit(0), up).count() == 0
    assert {r.file_id for r in P.provenance_found(files, up).collect()} == {1, 3, 5}


def test_mined_patterns_and_their_exceptions(spark):
    rows, i = [], 0
    for p in range(8):
        for k in range(3):
            i += 1
            # two of three files in the tool's folder carry its marker, none in the folder of the same name below geo
            rows.append(row(i, f"p{p}", f"out/dist/f{k}.py", ("# Code generated by x. DO NOT EDIT.\n" if k else "") + CODE))
            i += 1
            rows.append(row(i, f"p{p}", f"geo/dist/g{k}.py"))
            i += 1
            rows.append(row(i, f"p{p}", f"src/h{k}.py"))
    files = spark.createDataFrame(rows + rows[:5], SCHEMA)
    out = P.provenance(files, spark.createDataFrame([], UPSTREAM)).collect()
    assert len(out) == len(rows)
    assert {r.rel_path.split("/")[0] for r in out if not r.hand_written} == {"out"}
    assert sum(not r.hand_written for r in out) == 24
    assert any((r.reason or "").startswith("pattern") for r in out)


def test_paths_without_project(spark):
    files = spark.createDataFrame([(1, None, "/srv/src/p/node_modules/x/a.js", None, "x();\n"), (2, None, None, "a.py", CODE), (3, "p", "/srv/src/p/ok.py", "ok.py", "")], SCHEMA)
    assert {r.file_id for r in P.provenance_found(files, spark.createDataFrame([], UPSTREAM), LAYOUT).collect()} == {1}


def test_reshaped_copies_are_found_whatever_the_number_of_published_files(spark):
    """Line ends, indentation and comments make no difference, and neither do further published files or a licence that all share."""
    licence = "\n".join(f"# clause {i} of the licence says that word{i} may be used by anybody" for i in range(30)) + "\n"
    def published(many):
        ours = [("lib", "1", f"f{k}.py", None, licence + body(k)) for k in range(6)]
        return spark.createDataFrame(ours + [(f"o{k}", "1", "x.py", None, licence + body(100 + k)) for k in range(many)], UPSTREAM)

    rows = []
    for k in range(6):
        text = licence + body(k)
        rows += [row(10 * k, "p", f"s/a{k}.py", text.replace("\n", " ")), row(10 * k + 1, "p", f"s/b{k}.py", text.replace(" ", "   ").replace("\n", "\n\t")), row(10 * k + 2, "p", f"s/c{k}.py", body(k).replace("    ", "\t"))]
    rows += [row(1000, "p", "s/own.py", body(900)), row(1001, "p", "s/near.py", body(901) + licence[:200])]
    files = spark.createDataFrame(rows, SCHEMA)
    for many in (0, 400):
        assert {r.file_id for r in P.evidence(files, published(many)).where("copied").collect()} == {r[0] for r in rows if r[0] < 1000}


def test_short_texts_must_agree_as_a_whole(spark):
    up = spark.createDataFrame([("lib", "1", "a.py", None, "run(1)"), ("lib", "1", "e.py", None, "")], UPSTREAM)
    files = spark.createDataFrame([row(1, "p", "a.py", "run( 1 )\n"), row(2, "p", "b.py", "run(1); run(2)"), row(3, "p", "c.py", "run"), row(4, "p", "d.py", "")], SCHEMA)
    assert {r.file_id for r in P.evidence(files, up).where("copied").collect()} == {1}
    assert len(P.Shingler().shingles("")) == 0 and len(P.Shingler().shingles("a b")) == 1


def test_words_of_comment_lines_are_mined(spark):
    """A phrase that stands at the head of files whose names tell is a pattern elsewhere; one that goes on with the own name is none."""
    rows, i = [], 0
    for p in range(8):
        for k in range(6):
            i += 1
            name = f"src/f{k}_pb2.py" if k < 3 else f"src/f{k}.py"
            rows.append(row(i, f"p{p}", name, "# Ausgabe von Werkzeug 7\n" + CODE))
            i += 1
            rows.append(row(i, f"p{p}", f"src/g{k}.py", f"# made for p{p}\n" + CODE))
        i += 1
        rows.append(row(i, f"p{p}", "src/foot.py", CODE + "# Ausgabe von Werkzeug 9\n"))
    out = P.provenance(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], UPSTREAM)).collect()
    assert {r.rel_path[4] for r in out if not r.hand_written} == {"f"}
    assert sum(not r.hand_written for r in out) == 8 * 7
    assert {r.reason.split(":")[0] for r in out if not r.hand_written} <= {"pattern line", "pattern end"}
