"""What the operators of this package share: reading tables and running row functions on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an output batch holds at most, so that texts of any length leave a task in bounded pieces.
OUT_ROWS = 2_000
#: Characters of input after which an output batch is sent even if it holds fewer rows.
OUT_CHARS = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, inputs: list[str | Column], schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Rows out of rows, in tasks: ``make()`` runs once per task and gives the function of one row's values.

    Only the columns in ``inputs`` are sent to Python.  The output has exactly the columns of ``schema``, so further
    columns of ``df``, whatever their names, neither reach nor disturb the function.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        fn = make()

        def batch(rows):
            cols = list(zip(*rows)) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out.extend(fn(*row))
                if len(out) >= OUT_ROWS:
                    yield batch(out)
                    out = []
            yield batch(out)

    return df.select(*inputs).mapInArrow(run, schema)


def project_of(layout: str | None = None, project: str = "project_id", path: str = "path") -> Column:
    """The project of a file: its column, or where that is null what the group of ``layout`` finds in the path."""
    if layout is None:
        return F.col(project)
    return F.coalesce(F.col(project), F.nullif(F.regexp_extract(F.col(path), layout, 1), F.lit("")))


def rel_of(layout: str | None = None, rel: str = "rel_path", path: str = "path") -> Column:
    """The path below the project: its column, or where that is null what follows ``layout`` in the path."""
    if layout is None:
        return F.col(rel)
    return F.coalesce(F.col(rel), F.nullif(F.regexp_replace(F.col(path), layout, ""), F.col(path)))
