"""Files cut into chunks: Markdown sections, top-level symbols of source files, else the whole file.

Sections and whole files are built-in expressions.  Source files need a scanner per row: strings and comments are
blanked, top-level declarations found, and their ends by braces or indentation.  A file whose brackets do not match,
or without a declaration, is one chunk.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import chunk_id
from ..functions.text import base_name, language, lines, newlines, trimmed

COLUMNS = ["chunk_id", "project_id", "path", "file_hash", "language", "symbol", "signature", "docstring", "content", "start_line", "end_line"]

#: A Markdown header at the start of a line, as a place to split before; line ends are "\\n" only.
HEADER = r"(?md)(?=^#{1,6}[\t\n\f\r ]+.)"


def sections(files: DataFrame) -> DataFrame:
    """One row per Markdown section: header to header.  What precedes the first header is dropped, fenced ``#`` lines count.

    The end line is the line of the next header.  Files without a header are left out.
    """
    parts = F.split("content", HEADER)
    each = files.where(F.col("content").rlike(r"(?md)^#{1,6}[\t\n\f\r ]+.")).select("*", F.posexplode(_with_offsets(parts)).alias("_n", "_s"))
    text = F.col("_s.text")
    header = trimmed(F.regexp_extract(text, r"(?d)^(#{1,6}[\t\n\f\r ]+.+)", 1))
    start = F.col("_s.before") + 1
    rows = each.where(text.rlike(r"(?d)^#{1,6}[\t\n\f\r ]+."))
    return rows.select("project_id", "path", "file_hash", "language", header.alias("symbol"), header.alias("signature"), text.alias("_text"), start.cast("int").alias("start_line"), (start + newlines(text)).cast("int").alias("end_line")).withColumnRenamed("_text", "content")


def _with_offsets(parts):
    """The parts, each with the number of line ends before it."""
    empty = F.array().cast("array<struct<text:string,before:int>>")
    return F.aggregate(
        parts,
        F.struct(empty.alias("out"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(F.concat(acc["out"], F.array(F.struct(p.alias("text"), acc["n"].alias("before")))).alias("out"), (acc["n"] + newlines(p)).alias("n")),
        lambda acc: acc["out"],
    )


def whole(files: DataFrame) -> DataFrame:
    """One row per file, named after it."""
    name = base_name(F.col("path"))
    return files.select("project_id", "path", "file_hash", "language", name.alias("symbol"), name.alias("signature"), "content", F.lit(1).alias("start_line"), F.size(lines(F.col("content"))).alias("end_line"))


# source files ------------------------------------------------------------------------------------------------------

_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_BLANKED = {
    "go": re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|" + _STRING, re.S),
    "rust": re.compile(r'//[^\n]*|/\*(?:[^/*]|/(?!\*)|\*(?!/)|/\*(?:[^/*]|/(?!\*)|\*(?!/))*\*/)*\*/|r(#*)".*?"\1|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\n][^\'\n]*)\'', re.S),
    "javascript": re.compile(r"//[^\n]*|/\*.*?\*/|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\})*\})*`|" + _STRING, re.S),
    "python": re.compile(r'#[^\n]*|[rRbBuUfF]{0,2}(?:"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')', re.S),
}
_BLANKED["typescript"] = _BLANKED["javascript"]
_SYMBOL = {
    "go": re.compile(r"^(?:func\b[^\n]*|type\b[^\n]*)", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*(?:fn|struct|enum|trait|impl)\b[^\n]*", re.M),
    "javascript": re.compile(r"^(?:export[ \t]+(?:default[ \t]+)?)?(?:(?:async[ \t]+)?function\b[^\n]*|class\b[^\n]*|const[ \t]+[\w$]+[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|\(|[\w$]+[ \t]*=>)[^\n]*)", re.M),
    "typescript": re.compile(r"^(?:export[ \t]+(?:default[ \t]+)?)?(?:(?:declare|abstract)[ \t]+)*(?:(?:async[ \t]+)?function\b[^\n]*|class\b[^\n]*|interface\b[^\n]*|enum\b[^\n]*|const[ \t]+[\w$]+[ \t]*(?::[^=\n]*)?=[ \t]*(?:async[ \t]*)?(?:function\b|\(|[\w$]+[ \t]*=>)[^\n]*)", re.M),
    "python": re.compile(r"^(?:async[ \t]+def|def|class)\b[^\n]*", re.M),
}
#: A name in a declaration's first line, after the word that declares it.
_NAME = re.compile(r"\b(?:impl\b(?:<[^>]*>)?[^{\n]*?\bfor|impl(?:<[^>]*>)?|func|def|fn|class|struct|enum|trait|type|function\*?|interface|(?:const|var|let)(?!\s+(?:fn|unsafe|async|extern)\b))\s+(?:\([^)]*\)\s*)?(?:\*\s*)?([A-Za-z_$][\w$]*)")
_BRACKET = re.compile(r"[()\[\]{}]")
_PAIR = {")": "(", "]": "[", "}": "{"}


def _blanks(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def _balanced(code: str) -> bool:
    stack = []
    for m in _BRACKET.finditer(code):
        if m[0] in "([{":
            stack.append(m[0])
        elif not stack or stack.pop() != _PAIR[m[0]]:
            return False
    return not stack


def _end(code: str, start: int) -> int:
    """The place after the declaration that begins at ``start``: its last bracket, or the end of its line."""
    at = start
    while True:
        line = code.find("\n", at)
        line = len(code) if line < 0 else line
        m = _BRACKET.search(code, at, line)
        semicolon = code.find(";", at, line)
        if m and not 0 <= semicolon < m.start():
            depth = 0
            for n in _BRACKET.finditer(code, m.start()):
                depth += 1 if n[0] in "([{" else -1
                if depth == 0:
                    at = n.end()
                    break
            else:
                return len(code)
            if m[0] == "{":
                tail = re.compile(r"[ \t]*;").match(code, at)
                return tail.end() if tail and "=" in code[start : m.start()] else at
            continue
        if 0 <= semicolon:
            return semicolon + 1
        rest = code[at:line].strip()
        if rest.startswith("where") and (brace := code.find("{", at)) >= 0:
            at = brace
            continue
        following = code[line + 1 :].lstrip(" \t\r\n")[:5]
        if rest and not following.startswith(("where", "{")) or line == len(code):
            return line
        if not following.startswith(("where", "{")):
            return at
        at = line + 1


def _python_end(code: str, start: int) -> int:
    end, at = code.find("\n", start), start
    last = len(code) if end < 0 else end
    m = re.compile(r":[ \t]*(?:\n|$)").search(code, start)
    at = m.end() if m else last
    last = max(last, m.start() + 1) if m else last
    while 0 <= at < len(code):
        stop = code.find("\n", at)
        stop = len(code) if stop < 0 else stop
        row = code[at:stop]
        if row.strip():
            if row[0] not in " \t)]}":
                break
            last = at + len(row.rstrip())
        at = stop + 1
    return last


def symbols(lang: str, text: str) -> list[tuple[str, str, int, int]]:
    """(symbol, signature, start, end) of the top-level declarations of a text, in order; none if its brackets do not match."""
    code = _BLANKED[lang].sub(lambda m: _blanks(m[0]), text)
    if not _balanced(code):
        return []
    out, at = [], 0
    for m in _SYMBOL[lang].finditer(code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if start < at:
            continue
        end = _python_end(_solid(code, text), start) if lang == "python" else _end(code, start)
        first = text[start:].split("\n", 1)[0].strip()
        name = _NAME.search(first)
        out.append((name[1] if name else "", first, start, end))
        at = end
    return out


def _solid(code: str, text: str) -> str:
    """``code`` with its blanked strings visible again as marks, so that a line that holds only a string is not empty."""
    return "".join(c if c == "\n" or not c.isspace() or t.isspace() else "s" for c, t in zip(code, text)) if len(code) == len(text) else text


SOURCE = "project_id string, path string, file_hash string, language string, symbol string, signature string, content string, start_line int, end_line int"


def source(files: DataFrame) -> DataFrame:
    """One row per top-level symbol of the source files in ``files``; a file without one is one row named after it."""
    schema = pa.schema([(c, pa.int32() if c.endswith("_line") else pa.string()) for c in (x.split()[0] for x in SOURCE.split(", "))])

    def run(batches):
        for b in batches:
            out = []
            for project, path, file_hash, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                found = symbols(lang, text)
                if not found:
                    name = path.rsplit("/", 1)[-1]
                    out.append((project, path, file_hash, lang, name, name, text, 1, text.count("\n") + 1))
                for symbol, signature, a, z in found:
                    first = text.count("\n", 0, a) + 1
                    out.append((project, path, file_hash, lang, symbol, signature, text[a:z], first, first + text.count("\n", a, z)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return files.select("project_id", "path", "file_hash", "language", "content").mapInArrow(run, SOURCE)


def chunk(files: DataFrame) -> DataFrame:
    """The chunks of ``files`` (project_id, path, hash, content), with their ids; files without content have none."""
    named = files.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select("project_id", "path", F.col("hash").alias("file_hash"), language(F.col("path")).alias("language"), "content")
    has_header = F.col("content").rlike(r"(?md)^#{1,6}[\t\n\f\r ]+.")
    markdown = F.col("language") == "markdown"
    code = F.col("language").isin(list(_SYMBOL))
    parts = sections(named.where(markdown & has_header)).unionByName(whole(named.where(markdown & ~has_header | (F.col("language") == "")))).unionByName(source(named.where(code)))
    return parts.withColumn("chunk_id", chunk_id(F.col("path"), F.col("content"))).withColumn("docstring", F.lit("")).select(*COLUMNS)
