"""Chat providers: where each keeps its sessions, and how they are read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import dialogue


@dataclass(frozen=True)
class Provider:
    """A chat program: the names of its session files, and the function that makes turns (path, ordinal, role, content) of (path, content)."""

    name: str
    pattern: str
    read: Callable[..., DataFrame] = dialogue


PROVIDERS: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    """Makes a provider known by its name; a later one of the same name takes its place."""
    PROVIDERS[provider.name] = provider
    return provider


register(Provider("cascade", "*.pb"))


def sessions(spark: SparkSession, folder: str, provider: str) -> DataFrame:
    """(provider, session_id, path, content) of the session files below ``folder``; none if the folder is not there."""
    found = PROVIDERS[provider]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "provider string, session_id string, path string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", found.pattern).load(folder)
    path = F.regexp_replace("path", "^file:(//)?", "")
    return files.select(F.lit(provider).alias("provider"), F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1).alias("session_id"), path.alias("path"), "content")


def turns(spark: SparkSession, folder: str, provider: str, key: bytes | None = None) -> DataFrame:
    """(provider, session_id, ordinal, role, content): the turns of a provider's sessions."""
    files = sessions(spark, folder, provider)
    read = PROVIDERS[provider].read(files.select("path", "content"), key)
    return files.select("provider", "session_id", "path").join(read, "path").drop("path")
