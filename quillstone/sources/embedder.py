"""Embedders: what turns a column of text into a column of vectors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

BATCH = 32


class Embedder(Protocol):
    dim: int

    def query(self, text: str) -> list[float]: ...

    def embed(self, rows: DataFrame, text: str = "content") -> DataFrame: ...


_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=200_000)
def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def hashed(text: str | None, dim: int) -> np.ndarray:
    """Counts of the text's words by hashed dimension, normalised; zeros for a text without words."""
    v = np.zeros(dim)
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        # long words are rare and many; only short ones are remembered
        v[_bucket(word, dim) if len(word) <= 16 else _bucket.__wrapped__(word, dim)] += n
    size = np.sqrt(v @ v)
    return v / size if size else v


class HashedEmbedder:
    """A deterministic stand-in where no model is at hand: counts of hashed words (``functions.vectors.bucket``).

    The same as an expression of arrays and lambdas took more than twice as long, since these are not compiled.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def query(self, text: str) -> list[float]:
        return hashed(text, self.dim).tolist()

    def embed(self, rows: DataFrame, text: str = "content") -> DataFrame:
        dim = self.dim
        return _appended(rows, text, lambda texts: [hashed(t, dim) for t in texts])


def _appended(rows: DataFrame, text: str, vectors: Callable[[list[str | None]], list]) -> DataFrame:
    """``rows`` with the column ``embedding``.  The step is opaque to the optimiser, so no filter or projection above makes it run twice."""
    keep = rows.drop("embedding")
    place = keep.columns.index(text)

    def run(batches):
        for b in batches:
            made = vectors(b.column(place).to_pylist())
            flat = pa.array(np.concatenate([np.asarray(v, dtype=np.float64) for v in made]) if made else np.zeros(0), type=pa.float64())
            ends = np.cumsum([0, *(len(v) for v in made)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, "embedding"])

    schema = StructType([*keep.schema.fields, StructField("embedding", ArrayType(DoubleType()))])
    return keep.mapInArrow(run, schema)


class ServiceEmbedder:
    """A model behind a function that takes texts and gives vectors, ``batch`` texts at a time, with retries.

    ``post`` is called in the tasks; it returns (index, vector) pairs, which are put in order of their index.
    """

    def __init__(self, post: Callable[[Sequence[str]], Sequence[tuple[int, Sequence[float]]]], dim: int, batch: int = BATCH, attempts: int = 3, wait: float = 1.0):
        self.post, self.dim, self.batch, self.attempts, self.wait = post, dim, batch, attempts, wait

    def _vectors(self, texts: Sequence[str]) -> list[list[float]]:
        import time

        for attempt in range(self.attempts):
            try:
                got = sorted(self.post(texts), key=lambda p: p[0])
                if len(got) != len(texts) or any(len(v) != self.dim for _, v in got):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                return [list(map(float, v)) for _, v in got]
            except Exception:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.wait * 2**attempt)
        return []

    def query(self, text: str) -> list[float]:
        return self._vectors([text])[0]

    def embed(self, rows: DataFrame, text: str = "content") -> DataFrame:
        def vectors(texts: list[str | None]) -> list[list[float]]:
            out: list[list[float]] = []
            for k in range(0, len(texts), self.batch):
                out += self._vectors([t or "" for t in texts[k : k + self.batch]])
            return out

        return _appended(rows, text, vectors)
