"""Files, projects, chats and notes from storage."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import decrypted, is_text, printable_runs, sha256
from ..functions.text import base_name
from ..session import shared_checkpoint

FILES = "path string, mod_time timestamp, size bigint, content binary"


def scan(spark: SparkSession, root: str, project_id: str, hidden: bool = True) -> DataFrame:
    """The files below ``root`` as the table of files: project_id, path, rel_path, content, mod_time, hash, size.

    Spark's file source passes over names that begin with a dot or underscore.  With ``hidden`` those are listed and read
    in tasks too, by the file system of ``root``.  Files that are not text have no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("modificationTime").alias("mod_time"), F.col("length").alias("size"), "content")
    if hidden:
        rows = rows.unionByName(hidden_files(spark, root).mapInArrow(_reader(root), FILES))
    prefix = root.rstrip("/")
    return rows.select(
        F.lit(project_id).alias("project_id"),
        "path",
        F.substring("path", len(prefix) + 2, 1 << 30).alias("rel_path"),
        F.when(is_text(F.col("content")), F.decode("content", "UTF-8")).alias("content"),
        "mod_time",
        sha256(F.col("content")).alias("hash"),
        "size",
    )


def hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): files whose name, or a directory above it below the root, begins with a dot or underscore.

    The tree is listed level by level, the directories of a level in tasks; the driver sees no names.
    """
    import pyarrow as pa

    def entries(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        for b in batches:
            rows: list[tuple] = []
            for path, inside in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                    rows.append((info.path, info.type == fs.FileType.Directory, inside or info.base_name[:1] in "._"))
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.bool_()))], names=["path", "folder", "inside"])

    from pyarrow import fs

    level = spark.createDataFrame([(fs.FileSystem.from_uri(root)[1], False)], "path string, inside boolean")
    found = None
    while True:
        listed = shared_checkpoint(spark, level.mapInArrow(entries, "path string, folder boolean, inside boolean"))
        files = listed.where("inside and not folder").select("path")
        found = files if found is None else found.unionByName(files)
        level = listed.where("folder").select("path", "inside").repartition("path")
        if level.isEmpty():
            return found.repartition("path")


def _reader(root: str):
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        kinds = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    info = system.get_file_info(path)
                    with system.open_input_stream(path) as f:
                        data = f.read()
                except OSError:  # gone between the listing and the read
                    continue
                columns = [[path], [int(info.mtime.timestamp() * 1e6)], [len(data)], [data]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["path", "mod_time", "size", "content"])

    return read


def ignore_files(files: DataFrame) -> DataFrame:
    """(root, dir, content) of the ignore files among ``files``."""
    root = F.expr("left(path, greatest(length(path) - length(rel_path) - 1, 0))")
    own = files.where(base_name(F.col("path")) == ".gitignore")
    return own.select(root.alias("root"), F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("dir"), "content")


def memory_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, provider, content) of the remembered Markdown files below ``folder``; the provider is that of the header, else the directory's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    path, text = F.regexp_replace("path", "^file:(//)?", ""), F.decode("content", "UTF-8")
    named = F.nullif(F.regexp_extract(text, r"(?m)^- \*\*Provider:\*\* *(\S.*?)\s*$", 1), F.lit(""))
    return files.select(path.alias("path"), F.coalesce(named, F.regexp_extract(path, "([^/]*)/[^/]*$", 1)).alias("provider"), text.alias("content"))


PROJECT = "path string, name string, extensions array<string>, include array<string>, exclude array<string>, max_file_size_mb int"


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.json`` in ``folder``; a missing folder is empty, one bad file fails all."""
    if not os.path.isdir(folder):
        return spark.createDataFrame([], PROJECT)
    return spark.read.schema(PROJECT).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(folder)


def chat_strings(sessions: DataFrame, key: bytes | None = None) -> DataFrame:
    """(path, strings): the distinct printable runs of each session's bytes, in order; encrypted ones with a ``key``."""
    content = F.col("content") if key is None else decrypted(F.col("content"), F.lit(key))
    return sessions.select("path", F.array_distinct(printable_runs(content)).alias("strings"))


def dialogue(sessions: DataFrame, key: bytes | None = None) -> DataFrame:
    """(path, ordinal, role, content): the turns in each session's bytes.

    The bytes are length-delimited fields: field 2 is a step, in a step field 19 is what the user and field 20 what the
    assistant said.  What is malformed ends the reading; the turns before it stay.
    """
    content = F.col("content") if key is None else decrypted(F.col("content"), F.lit(key))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, n, role, text) for p, data in zip(pdf["path"], pdf["content"]) if data is not None for n, (role, text) in enumerate(turns(bytes(data)))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "role", "content"])

    return sessions.select("path", content.alias("content")).mapInPandas(run, "path string, ordinal int, role string, content string")


class Malformed(ValueError):
    pass


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it) of the variable-length number at ``at``."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("truncated or too long a number")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, content) of the length-delimited fields, up to the end or the first malformed one."""
    at = 0
    while at < len(data):
        try:
            tag, at = varint(data, at)
            number, wire = tag >> 3, tag & 7
            if wire == 0:
                _, at = varint(data, at)
            elif wire == 1:
                at += 8
            elif wire == 5:
                at += 4
            elif wire == 2:
                size, at = varint(data, at)
                if at + size > len(data):
                    return
                yield number, data[at : at + size]
                at += size
            else:
                return
        except Malformed:
            return


def turns(data: bytes) -> Iterator[tuple[str, str]]:
    for number, step in fields(data):
        if number != 2:
            continue
        said: dict[str, list[str]] = {"user": [], "assistant": []}
        for n, content in fields(step):
            if n in (19, 20):
                text = printable(content)
                if text:
                    said["user" if n == 19 else "assistant"].append(text)
        for role, parts in said.items():
            if parts:
                yield role, "\n".join(parts)


def printable(data: bytes) -> str:
    """The text of a field, or the texts of the fields in it."""
    try:
        text = data.decode("utf-8")
        if not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", text):
            return text
    except UnicodeDecodeError:
        pass
    return "\n".join(t for t in (printable(c) for _, c in fields(data)) if t)
