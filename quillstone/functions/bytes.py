"""Expressions on binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, content: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\n"), content), 256)


def is_text(content: Column) -> Column:
    """No zero byte among the first 512."""
    return ~F.contains(F.substring(content, 1, 512), F.lit(b"\x00"))


def printable_runs(content: Column, least: int = 4) -> Column:
    """Runs of printable ASCII, tabs and line ends of at least ``least`` bytes."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[\\t\\n\\r -~]{{{least},}}"), F.lit(0))


def decrypted(content: Column, key: Column) -> Column:
    """AES-GCM with a 12-byte nonce before and a 16-byte tag after the text; null where it cannot be decrypted."""
    return F.try_aes_decrypt(content, key, F.lit("GCM"))
