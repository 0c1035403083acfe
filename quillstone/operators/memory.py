"""Chat turns and notes as Markdown, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escaped_headers, note_markdown, note_provider, slug
from .changes import latest


def long_enough(turns: DataFrame, least_bytes: int) -> DataFrame:
    """Without the user's turns that are shorter, in bytes; 0 or less keeps all, other roles always stay."""
    if least_bytes <= 0:
        return turns
    return turns.where((F.octet_length("content") >= least_bytes) | ~F.col("role").eqNullSafe(F.lit("user")))


def session_markdown(turns: DataFrame, least_bytes: int = 0, part_turns: int | None = None) -> DataFrame:
    """(session_id, path, content): each session as one Markdown text, turns in order of their ordinal.

    Any role but ``user`` is headed Assistant.  Headers in turns are escaped, so sections are the turns.  Re-sent turns
    count once; turns without text are left out.  With ``part_turns`` a session comes in several texts, cut at multiples
    of that ordinal: the head of each tells of the whole session, and a string is listed in the first that has it.
    """
    kept = long_enough(latest(turns, "turn_id", "exported_at").where(F.length("content") > 0), least_bytes)
    label = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    one = F.struct("ordinal", "turn_id", F.concat(F.lit("### "), label, F.lit("\n\n"), escaped_headers(F.col("content")), F.lit("\n\n")).alias("text"), "content", "fresh")
    of_session = [F.max("provider").alias("provider"), F.sum(F.octet_length("content")).alias("bytes"), F.count("*").alias("n")]
    listed_turns = F.sort_array(F.collect_list(one)).alias("turns")
    if part_turns is None:
        grouped = kept.withColumn("fresh", F.lit(True)).groupBy("session_id", F.lit(0).alias("part")).agg(listed_turns, *of_session)
    else:
        part = F.floor(F.greatest(F.coalesce("ordinal", F.lit(0)), F.lit(0)) / part_turns)
        first = Window.partitionBy("session_id", "content").orderBy(part, "ordinal", "turn_id")
        marked = kept.withColumn("fresh", F.row_number().over(first) == 1)
        # aggregated before the parts are formed
        totals = marked.groupBy(F.col("session_id").alias("_session")).agg(*of_session, F.count_if("fresh").alias("k"))
        grouped = marked.groupBy("session_id", part.alias("part")).agg(listed_turns).join(totals, F.col("session_id").eqNullSafe(F.col("_session")))
    strings = F.array_distinct(F.filter("turns", lambda x: x["fresh"])["content"])
    k = F.size(strings) if part_turns is None else F.col("k")
    head = F.concat(
        F.lit("# Chat trajectory: "), F.col("session_id"), F.lit("\n\n- **Provider:** "), F.coalesce("provider", F.lit("")),
        F.lit("\n- **Decrypted size:** "), F.col("bytes").cast("string"), F.lit(" bytes\n- **Dialogue turns:** "), F.col("n").cast("string"),
        F.lit("\n- **Extracted strings:** "), k.cast("string"), F.lit("\n\n---\n\n"),
    )
    body = F.concat(F.lit("## Dialogue\n\n"), F.array_join(F.col("turns.text"), ""))
    tail = F.concat(F.lit("## All extracted strings\n\n"), F.array_join(F.transform(strings, lambda x: F.concat(escaped_headers(x), F.lit("\n\n"))), ""))
    return grouped.select("session_id", F.concat(F.lit("/memory/chats/"), F.col("session_id"), F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part").cast("string"))).otherwise(""), F.lit(".md")).alias("path"), F.concat(head, body, tail).alias("content"))


def session_summary(turns: DataFrame) -> DataFrame:
    """(session_id, turns, bytes, strings): distinct turns, their bytes, and how many distinct texts they hold."""
    once = latest(turns, "turn_id", "exported_at").where(F.length("content") > 0)
    return once.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum(F.octet_length("content")).alias("bytes"), F.count_distinct("content").alias("strings"))


def note_files(notes: DataFrame) -> DataFrame:
    """(note_id, path, provider, content): notes as they are written to files, repeated notes once."""
    provider = F.coalesce(F.nullif("provider", F.lit("")), F.lit("cascade"))
    name = F.concat(F.date_format("written_at", "yyyyMMdd-HHmmss"), F.lit("-"), slug(F.col("title")), F.lit(".md"))
    text = note_markdown(F.col("title"), F.col("content"), F.coalesce("tags", F.array().cast("array<string>")), provider, F.col("written_at"))
    once = notes.dropDuplicates(["note_id"])
    return once.select("note_id", F.concat(F.lit("/memory/"), provider, F.lit("/"), name).alias("path"), provider.alias("provider"), text.alias("content"))


def listed(files: DataFrame, provider: str | None = None) -> DataFrame:
    """(path, provider) of remembered files, by the provider their header names."""
    rows = files.select("path", note_provider(F.col("content")).alias("provider"))
    return rows.where(F.col("provider") == provider) if provider else rows
