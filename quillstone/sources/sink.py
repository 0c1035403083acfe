"""Texts as files: one file per row, written in the tasks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def write_texts(rows: DataFrame, root: str) -> DataFrame:
    """(path, bytes) of the files written below ``root`` from (path, content); null contents are passed over.

    ``root`` must be a folder that all executors see.  A file is written beside its place and moved there, so a task
    that runs again leaves the same files and no half one.  The writing happens when the result is read.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path is None or content is None:
                    continue
                full = os.path.normpath(os.path.join(root, path.lstrip("/")))
                if not full.startswith(os.path.normpath(root) + os.sep):
                    raise ValueError(f"{path} leads out of the folder")
                os.makedirs(os.path.dirname(full), exist_ok=True)
                data = content.encode("utf-8")
                beside = f"{full}.{os.getpid()}.tmp"
                with open(beside, "wb") as f:
                    f.write(data)
                os.replace(beside, full)
                out.append((path, len(data)))
            columns = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["path", "bytes"])

    return rows.select("path", "content").mapInArrow(run, "path string, bytes bigint")
