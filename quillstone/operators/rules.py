"""Which files are indexed: include and exclude globs, extensions, size, ignore files."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glob import rule_regex
from ..functions.text import extension, under
from ..session import few

#: What is indexed where a project says nothing, and what never is (anchored at the project's root).
DEFAULT_EXTENSIONS = (".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".rs", ".md")
DEFAULT_EXCLUDES = ("node_modules/**", ".git/**", "vendor/**", "dist/**", "build/**", "__pycache__/**")


@dataclass(frozen=True)
class Rule:
    """A project's rule; empty lists mean the defaults, size 0 means no limit."""

    path: str = ""
    name: str = ""
    extensions: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_file_size_mb: int = 0


def should_index(rule: Rule, rel: Column, size: Column) -> Column:
    """Include (any, if there are some), then exclude (any), then extension, then size.

    Paths are matched in small letters and patterns as they are, so a pattern with capitals never matches.
    """
    low = F.lower(rel)
    keep = F.lit(True)
    if rule.include:
        keep = keep & low.rlike("|".join(f"(?:{rule_regex(p)})" for p in rule.include))
    keep = keep & ~low.rlike("|".join(f"(?:{rule_regex(p)})" for p in (*DEFAULT_EXCLUDES, *rule.exclude)))
    allowed = [e.lower() for e in (rule.extensions or DEFAULT_EXTENSIONS)]
    keep = keep & extension(rel).isin(allowed) & (extension(rel) != "")
    if rule.max_file_size_mb > 0:
        keep = keep & (size <= rule.max_file_size_mb * 1024 * 1024)
    return F.coalesce(keep, F.lit(False))


def with_rules(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``files`` with the column ``indexed``: each file judged by its project's rule in ``projects``, null project ids by none.

    Globs become expressions in tasks, once per project, so that the judgement of the files is one join and ``rlike``.
    Any number of projects may come: few are sent to the tasks, many are joined.
    """

    def compiled(batches):
        for pdf in batches:
            rows = []
            for project, exts, include, exclude, mb in zip(*(pdf[c] for c in ("project_id", "extensions", "include", "exclude", "mb"))):
                rows.append((project, "|".join(f"(?:{rule_regex(p)})" for p in include) or ".*", "|".join(f"(?:{rule_regex(p)})" for p in (*DEFAULT_EXCLUDES, *exclude)), [e.lower() for e in (list(exts) or DEFAULT_EXTENSIONS)], int(mb) << 20))
            yield pd.DataFrame(rows, columns=["project_id", "rule_include", "rule_exclude", "rule_extensions", "rule_bytes"])

    listed = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("extensions", "include", "exclude")]
    given = projects.select("project_id", *listed, F.coalesce("max_file_size_mb", F.lit(0)).cast("bigint").alias("mb"))
    table = few(given.mapInPandas(compiled, "project_id string, rule_include string, rule_exclude string, rule_extensions array<string>, rule_bytes bigint"))
    low, ext = F.lower("rel_path"), extension(F.col("rel_path"))
    keep = (
        F.rlike(low, F.col("rule_include"))
        & ~F.rlike(low, F.col("rule_exclude"))
        & (ext != "")
        & F.array_contains("rule_extensions", ext)
        & ((F.col("rule_bytes") == 0) | (F.col("size") <= F.col("rule_bytes")))
    )
    joined = files.join(table, "project_id", "left")
    return joined.withColumn("indexed", F.coalesce(keep, F.lit(False))).drop("rule_include", "rule_exclude", "rule_extensions", "rule_bytes")


def ignore_regex(line: str) -> tuple[bool, str] | None:
    """(negated, expression on the path below the ignore file's directory) of a line of an ignore file."""
    line = line.rstrip("\r\n")
    if not line.strip() or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    body = body.removeprefix("\\").rstrip()
    directory = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    core = rule_core(body)
    tail = "/.*$" if directory else "(?:/.*)?$"
    return negated, ("^" if anchored else "^(?:.*/)?") + core + tail


def rule_core(body: str) -> str:
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out.append("/.*")
            i += 3
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
            while i < len(body) and body[i] == "*":
                i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            inner = body[i + 1 : j]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = j + 1
        else:
            out.append(re.escape(body[i]))
            i += 1
    return "".join(out)


def ignored(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """``files`` (root, rel_path) with the column ``ignored``, from the text of ignore files (root, dir, content).

    The files of every directory from the root to the file's own are asked, each with the path below it; in one file
    the last matching line decides, and any file that ignores is enough: a deeper ``!`` line does not bring back.
    """

    def parsed(batches):
        for pdf in batches:
            rows = [(root, where, n, *rule) for root, where, text in zip(pdf["root"], pdf["dir"], pdf["content"]) for n, line in enumerate((text or "").split("\n")) if (rule := ignore_regex(line))]
            yield pd.DataFrame(rows, columns=["root", "dir", "line", "negated", "expression"])

    # the files are read in tasks, a row in, a row per line out; their rules meet the paths in a join
    rules = ignore_files.select("root", "dir", "content").mapInPandas(parsed, "root string, dir string, line int, negated boolean, expression string")
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = F.expr("if(dir = '', rel_path, substring(rel_path, length(dir) + 2))")
    met = files.select("root", "rel_path", F.explode(above).alias("dir")).distinct().join(rules, ["root", "dir"]).where(F.rlike(below, F.col("expression")))
    said = met.groupBy("root", "rel_path", "dir").agg(F.max_by("negated", "line").alias("negated")).where(~F.col("negated")).select("root", "rel_path").distinct()
    return files.join(said.withColumn("ignored", F.lit(True)), ["root", "rel_path"], "left").fillna(False, ["ignored"])


def allowed_paths(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The rows of ``paths`` that lie in a project: a semi-join on the path's own prefixes, so no pair of path and project is formed."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    roots = projects.select(F.rtrim(F.col("path"), F.lit("/")).alias("_root")).distinct()
    inside = paths.select("path", F.explode(prefixes).alias("_root")).distinct().join(roots, "_root", "left_semi").select("path").distinct()
    return paths.join(inside, "path", "left_semi")


def delete_under(chunks: DataFrame, root: str) -> DataFrame:
    return chunks.where(~under(F.col("path"), F.lit(root)))
