"""Vector expressions.  Sums are in double, so that results do not depend on the order of summation in float."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, vector: Sequence[float]) -> Column:
    """The dot product of a column of vectors, all as long as ``vector``, with that one vector: a matrix product per Arrow batch."""
    q = np.array(list(vector), dtype=np.float64)

    @F.arrow_udf("double")
    def product(v: pa.Array) -> pa.Array:
        return pa.array(np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), len(q)) @ q)

    return product(a)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector)).cast("array<double>")


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalised(a: Column) -> Column:
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bucket(word: Column, dim: int) -> Column:
    """The dimension a word is hashed to: the first 8 hex digits of its MD5, modulo ``dim``."""
    return F.pmod(F.conv(F.left(F.md5(word.cast("binary")), F.lit(8)), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
