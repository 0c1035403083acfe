"""The memory: remembered files (notes, chats) with the vectors of their sections, kept in step with the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import note_provider
from ..operators.search import memory_search
from .index import Index


class Memory(Index):
    """An index whose projects are ``memory-<provider>`` and whose files are remembered ones (path, content, and provider if the header names none).

    A question meets vectors that were made when the files were last synchronised; nothing is embedded for it but itself.
    """

    @staticmethod
    def files(notes: DataFrame) -> DataFrame:
        """Remembered files as the table of files that an index takes; re-sent ones count once."""
        named = F.col("provider") if "provider" in notes.columns else note_provider(F.col("content"))
        project = F.concat(F.lit("memory-"), F.coalesce(named, F.lit("cascade")))
        rows = notes.where(F.col("path").isNotNull()).select(project.alias("project_id"), "path", F.regexp_extract("path", "[^/]*$", 0).alias("rel_path"), "content")
        return rows.dropDuplicates(["path"])

    def sync(self, notes: DataFrame) -> dict[str, int]:
        """New and changed files are embedded, those that are gone leave; what is unchanged is not touched."""
        files = self.files(notes)
        counts = self.update(files)
        # a provider of which no file is left is in no project of the files
        over = self.state().join(files.select("project_id").distinct(), "project_id", "left_anti").select("path")
        lost = self.update_paths(over, files.limit(0)) if not over.isEmpty() else {"deleted": 0}
        return counts | {"deleted": counts["deleted"] + lost["deleted"]}

    def write(self, notes: DataFrame) -> dict[str, int]:
        """Adds single files, or replaces those with their paths."""
        files = self.files(notes)
        return self.update_paths(files.select("path"), files)

    def forget(self, paths: DataFrame) -> dict[str, int]:
        """Takes single files out."""
        return self.update_paths(paths.select("path"), self.spark.createDataFrame([], "project_id string, path string, rel_path string, content string"))

    def search(self, query: str, k: int = 10, provider: str = "cascade", exact: bool = False) -> DataFrame:
        return memory_search(self.chunks(), self.embedder.query(query), k, provider, exact)
