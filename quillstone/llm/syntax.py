"""Problem 1: source files that do not parse.

Each file is lexed and parsed by the packrat grammar of its extension's language; a file is valid if the grammar
consumes all of it.  A file that fails is parsed again with tracing to report the furthest failure and its cause.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexers
from .common import map_rows, project_of

#: File extensions of the five languages.
EXTENSIONS = {
    "go": "go", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "rs": "rust",
}
SOURCE_PATH = r"\.(" + "|".join(EXTENSIONS) + ")$"
REPORT = "file_id bigint, project string, language string, valid boolean, fail_line int, fail_offset bigint, cause string"

_CONFLICT = re.compile(r"^(<{7}|={7}|>{7}|\|{7})(\s|$)")
_HUNK = re.compile(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@|^diff --git |^\+\+\+ |^--- ")
#: Frames that nesting may take, at first and where that is not enough; what is deeper still gets no verdict.
_RECURSION, _DEEP = 60_000, 4_000_000


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get(path.rsplit("/", 1)[-1].rpartition(".")[2]) if path else None


def has_jsx(path: str) -> bool:
    """Whether the language of the path's extension holds JSX elements."""
    return not path.endswith((".ts", ".mjs", ".cjs"))


def _plain(language: str, text: str, jsx: bool) -> str:
    return lexers.without_jsx(text) if jsx and language in ("javascript", "typescript") else text


def verdict(language: str, text: str, module: bool = True, jsx: bool = True) -> bool | None:
    """Whether ``text`` is syntactically valid; None where it nests deeper than ``_DEEP`` frames."""
    from .languages import LEXERS, grammar

    for frames in (_RECURSION, _DEEP):
        if sys.getrecursionlimit() < frames:
            sys.setrecursionlimit(frames)
        try:
            return grammar(language, module).parse(LEXERS[language].kinds(_plain(language, text, jsx))) >= 0
        except RecursionError:
            continue
        finally:
            sys.setrecursionlimit(_RECURSION)
    return None


def parses(language: str, text: str, module: bool = True, jsx: bool = True) -> bool:
    return verdict(language, text, module, jsx) is True


def diagnose(language: str, text: str, module: bool = True, jsx: bool = True) -> tuple[int, int, str]:
    """(line, offset, cause) of the furthest failure of a text that does not parse."""
    from .languages import LANGUAGES, LEXERS, grammar

    plain = _plain(language, text, jsx)
    kinds = LEXERS[language].kinds(plain)
    try:
        far = grammar(language, module).furthest(kinds)
    except RecursionError:
        return 1, 0, "too_deep"
    at = LEXERS[language].offset(plain, kinds, far)
    line = plain.count("\n", 0, at)
    lines = plain.split("\n")
    near = lines[max(0, line - 2) : line + 2]
    if any(_CONFLICT.match(x) for x in near):
        cause = "merge_conflict"
    elif any(_HUNK.match(x) for x in near):
        cause = "patch_hunk"
    elif not plain[at:].strip():
        cause = "truncated"
    elif any(parses(other, text) for other in LANGUAGES if other != language):
        cause = "wrong_extension"
    elif kinds[far : far + 1] == lexers.BAD:
        cause = "bad_token"
    else:
        cause = "syntax_error"
    return line + 1, at, cause


def _make():
    def row(file_id, path, project, content):
        language = language_of(path)
        if language is None or content is None:
            return
        module = not path.endswith(".cjs")
        valid = verdict(language, content, module, has_jsx(path))
        if valid:
            yield file_id, project, language, True, None, None, None
        elif valid is None:
            yield file_id, project, language, None, None, None, "too_deep"
        else:
            yield file_id, project, language, False, *diagnose(language, content, module, has_jsx(path))

    return row


def syntax_report(files: DataFrame, layout: str | None = None) -> DataFrame:
    """One row per delivered row of ``files`` (file_id, project_id, path, content) in one of the five languages.

    Null paths, other extensions and null contents give no row; an empty or blank text is a valid program except in
    Go, which needs a package clause.  Repeated rows give repeated rows (``syntax_found`` and ``syntax_rates`` count a
    file_id once); further columns are ignored.  A text that nests too deeply to be judged has a null ``valid``.  No shuffle: the work is one pass over the scan.
    """
    source = files.where(F.col("path").rlike(SOURCE_PATH) & F.col("content").isNotNull())
    return map_rows(source, ["file_id", "path", project_of(layout).alias("project"), "content"], REPORT, _make)


def syntax_found(files: DataFrame) -> DataFrame:
    return syntax_report(files).where(~F.col("valid")).select("file_id").distinct()


def syntax_rates(files: DataFrame, layout: str | None = None) -> DataFrame:
    """Per project and language: files, invalid files, their rate, and the invalid files of each cause."""
    causes = ["merge_conflict", "patch_hunk", "truncated", "wrong_extension", "bad_token", "syntax_error", "too_deep"]
    once = syntax_report(files, layout).groupBy("file_id").agg(*(F.first(c).alias(c) for c in ("project", "language", "valid", "cause")))
    return once.groupBy("project", "language").agg(
        F.count("*").alias("files"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.round(F.avg(F.when(~F.col("valid"), 1.0).otherwise(0.0)), 6).alias("rate"),
        *(F.count_if(F.col("cause") == c).alias(c) for c in causes),
    )
