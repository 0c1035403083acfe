"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import map_rows
from .secrets import tokenizer

#: Characters sent to the tokenizer at once; longer texts are cut after a blank, where no token spans.
PART = 100_000


def count(text: str | None, tokenizers: str | None = None) -> int:
    if not text:
        return 0
    encode, n, at = tokenizer(tokenizers).encode_ordinary, 0, 0
    while at < len(text):
        end = min(len(text), at + PART)
        if end < len(text):
            space = text.rfind(" ", at + 1, end)
            end = space if space > at else end
        n += len(encode(text[at:end]))
        at = end
    return n


def token_counts(documents: DataFrame, columns: list[str], tokenizers: str | None = None) -> DataFrame:
    """``columns`` of each document and ``tokens``; the text itself goes no further than the task that reads it."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", tokens bigint"

    def make():
        def row(*values):
            yield *values[:-1], count(values[-1], tokenizers)

        return row

    return map_rows(documents, [*columns, "text"], schema, make)
