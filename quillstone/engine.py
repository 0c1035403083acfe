"""The engine's operations as methods; each gives a DataFrame or changes the index."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import under
from .operators import files as fs
from .operators import memory, search, stats, symbols
from .operators.rules import Rule
from .plans.index import Index
from .plans.memory import Memory
from .plans.progress import Progress, State
from .sources import config as configs
from .sources.embedder import Embedder, HashedEmbedder


class ToolError(ValueError):
    """A request that cannot be met; ``reason`` is a short code."""

    def __init__(self, reason: str, message: str, suggestion: str = ""):
        super().__init__(message)
        self.reason, self.suggestion = reason, suggestion


class Engine:
    """Files, an index over them, a memory, and the projects they belong to.

    ``files`` is the table of files (project_id, path, rel_path, content, mod_time, hash, size); ``projects`` has the
    rules (project_id, path, extensions, include, exclude, max_file_size_mb); ``notes`` the remembered files
    (path, provider, content).
    """

    def __init__(self, spark: SparkSession, folder: str, files: DataFrame, projects: DataFrame, notes: DataFrame | None = None, embedder: Embedder | None = None, config: configs.Config | None = None):
        self.spark, self.files, self.projects, self.notes = spark, files, projects, notes
        self.embedder = embedder or HashedEmbedder()
        self.index = Index(spark, folder, self.embedder)
        self.memory = Memory(spark, posixpath.join(folder, "memory"), self.embedder)
        self.config = config or configs.Config()
        self.progress = Progress(posixpath.join(folder, "progress.json"))

    # paths

    def resolve(self, project: str | None = None, path: str | None = None, absolute: bool = False) -> str:
        """The absolute path of ``path`` in ``project``; it must lie in a project unless ``absolute`` is allowed."""
        named = self.projects.where(F.col("project_id") == project).select("path").first() if project else None
        if project and named is None:
            raise ToolError("project_not_found", f"no project {project}", "list_projects names them")
        if path and path.startswith("/"):
            full = posixpath.normpath(path)
        elif project:
            full = posixpath.normpath(posixpath.join(named["path"], path or ""))
        else:
            raise ToolError("missing_argument", "a project or an absolute path is needed")
        if not absolute and self.projects.where(under(F.lit(full), F.rtrim(F.col("path"), F.lit("/")))).isEmpty():
            raise ToolError("path_not_allowed", f"{full} lies in no project")
        return full

    def _query(self, text: str) -> list[float]:
        if not text or not text.strip():
            raise ToolError("empty_query", "the query is empty")
        return self.embedder.query(text)

    # search

    def search_codebase(self, query: str, project=None, path=None, language=None, top_k: int = 10, include_content: bool = True, exact: bool = False) -> DataFrame:
        rows = search.search(self.index.chunks(), self._query(query), query, top_k, project, language, path, exact)
        out = rows.select("chunk_id", "project_id", "path", "language", "symbol", "signature", "start_line", "end_line", "score", "content")
        return out if include_content else out.drop("content")

    def query_documentation(self, query: str, project=None, top_k: int = 10) -> DataFrame:
        return self.search_codebase(query, project, language="markdown", top_k=top_k)

    def find_symbol(self, name: str, project=None, language=None) -> DataFrame:
        if not name.strip():
            raise ToolError("empty_query", "the name is empty")
        return symbols.find_symbol(symbols.locations(self.index.chunks()), name, project, language, lambda q: self.search_codebase(q, project, language=language))

    def search(self, query: str, source: str = "all", project=None, path=None, language=None, top_k: int = 10, include_content: bool = True) -> DataFrame:
        """Code, documentation and memory as one list; the documentation leg takes no language, the memory leg no filter."""
        if source not in ("all", "code", "docs", "memory"):
            raise ToolError("invalid_argument", f"no source {source}")
        legs: dict[str, DataFrame] = {}
        if source in ("all", "code"):
            legs["code"] = self.search_codebase(query, project, path, language, top_k)
        if source in ("all", "docs"):
            legs["docs"] = self.search_codebase(query, project, path, "markdown", top_k)
        if source in ("all", "memory"):
            legs["memory"] = self.memory_search(query, top_k=top_k)
        out = search.unified(legs, top_k)
        return out if include_content else out.drop("content")

    # files

    def get_file_context(self, path: str, start_line: int = 0, end_line: int = 0, absolute: bool = False) -> DataFrame:
        full = self.resolve(None, path, absolute)
        return fs.context(self.files.where(F.col("path") == full), start_line, end_line)

    def fs_read(self, path: str, start_line: int = 0, end_line: int = 0) -> DataFrame:
        return self.get_file_context(path, start_line, end_line, absolute=True)

    def grep(self, query: str, project=None, path=None, regex: bool = False, top_k: int = 20, absolute: bool = False) -> DataFrame:
        if not query:
            raise ToolError("empty_query", "the query is empty")
        return fs.grep_top(self.files, query, top_k, regex, self.resolve(project, path, absolute))

    def fs_grep(self, path: str, query: str, regex: bool = False, top_k: int = 20) -> DataFrame:
        return self.grep(query, None, path, regex, top_k, absolute=True)

    def _below(self, root: str) -> DataFrame:
        inside = self.files.where(under(F.col("path"), F.lit(root)) & (F.col("path") != root))
        return inside.withColumn("rel_path", F.substring("path", len(root.rstrip("/")) + 2, 1 << 30))

    def list_files(self, project=None, path=None, pattern: str = "*", include_dirs: bool = False, absolute: bool = False) -> DataFrame:
        return fs.listing(self._below(self.resolve(project, path, absolute)), pattern, include_dirs).orderBy("path")

    def fs_list(self, path: str, pattern: str = "*", include_dirs: bool = False) -> DataFrame:
        return self.list_files(None, path, pattern, include_dirs, absolute=True)

    def directory_tree(self, project=None, path=None, depth: int = 3, absolute: bool = False) -> DataFrame:
        return fs.tree(self._below(self.resolve(project, path, absolute)), depth).orderBy("path")

    def fs_tree(self, path: str, depth: int = 3) -> DataFrame:
        return self.directory_tree(None, path, depth, absolute=True)

    def get_recent_changes(self, project=None, path=None, minutes: int = 60, now=None) -> DataFrame:
        moment = F.current_timestamp() if now is None else F.lit(now)
        return fs.recent(self._below(self.resolve(project, path)), moment, minutes).orderBy("path")

    # index

    def list_projects(self) -> DataFrame:
        return self.projects.select("project_id", "path").orderBy("project_id")

    def reindex_files(self, paths: list[str]) -> dict[str, int]:
        full = [self.resolve(None, p) for p in paths]
        wanted = self.spark.createDataFrame([(p,) for p in full], "root string")  # as long as the caller's list
        # a directory stands for the files below it, in the table and in the index
        known = self.files.select("project_id", "path").unionByName(self.index.state().select("project_id", "path")).distinct()
        hit = known.join(F.broadcast(wanted), under(F.col("path"), F.col("root")), "left_semi")
        return self.index.update_paths(hit, self.files.join(hit.select("path"), "path", "left_semi"), self.projects)

    def _job(self, prefix: str, project: str, files: DataFrame) -> dict[str, int]:
        self.progress.start(prefix, project)
        try:
            counts = self.index.rebuild(files, self.projects)
        except Exception as error:
            self.progress.fail(error)
            raise
        self.progress.done(done_files=counts["changed"], total_files=counts["changed"], done_chunks=counts["chunks"], total_chunks=counts["chunks"])
        return counts

    def rebuild_project(self, project: str) -> dict[str, int]:
        self.resolve(project)
        return self._job(f"project:{project}", project, self.files.where(F.col("project_id") == project))

    def rebuild_index(self) -> dict[str, int]:
        return self._job("index", "", self.files)

    def get_index_job(self, job_id: str) -> State:
        """The state of a job; only the latest is known."""
        state = self.progress.load()
        if state.job_id != job_id:
            raise ToolError("job_not_found", f"no job {job_id}")
        return state

    def get_index_status(self) -> DataFrame:
        return stats.project_status(self.projects, self.index.chunks()).orderBy("project_id")

    # projects

    def add_project(self, path: str, name: str = "", folder: str | None = None, **rule) -> str:
        """Writes the project's file under a free name and returns the name."""
        taken = {r["project_id"] for r in self.projects.select("project_id").toLocalIterator()}
        free = configs.unique_name(name or posixpath.basename(path.rstrip("/")), taken)
        made = Rule(path=path, name=free, **{k: tuple(v) if isinstance(v, list) else v for k, v in rule.items()})
        if folder:
            configs.save_project(folder, made)
        row = self.spark.createDataFrame([(free, path, list(made.extensions), list(made.include), list(made.exclude), made.max_file_size_mb)], self.projects.select("project_id", "path", "extensions", "include", "exclude", "max_file_size_mb").schema)
        self.projects = self.projects.unionByName(row, allowMissingColumns=True)
        return free

    def edit_project(self, name: str, folder: str | None = None, **rule) -> None:
        old = self.projects.where(F.col("project_id") == name).first()
        if old is None:
            raise ToolError("project_not_found", f"no project {name}")
        values = {k: rule.get(k, old[k]) for k in ("extensions", "include", "exclude", "max_file_size_mb")}
        self.projects = self.projects.where(F.col("project_id") != name)
        self.add_project(old["path"], name, folder, **{k: v if v is not None else (0 if k == "max_file_size_mb" else []) for k, v in values.items()})

    def remove_project(self, name: str, folder: str | None = None) -> None:
        self.resolve(name)
        if folder:
            configs.delete_project(folder, name)
        self.projects = self.projects.where(F.col("project_id") != name)
        self.index.remove(name)

    # memory

    def _remembered(self) -> DataFrame:
        if self.notes is None:
            raise ToolError("not_ready", "there is no memory")
        return self.notes.select("path", "provider", "content")

    def sync_memory(self) -> dict[str, int]:
        """Brings the memory's vectors in line with the remembered files; a job to run every ``sync_minutes``."""
        return self.memory.sync(self._remembered())

    def memory_search(self, query: str, provider: str = "cascade", top_k: int = 10) -> DataFrame:
        """The remembered files nearest to the query, by the vectors of the last synchronisation."""
        self._query(query)
        self._remembered()
        rows = self.memory.search(query, top_k, provider)
        return rows.select("path", F.lit(provider).alias("provider"), "score", "content", "start_line", "end_line")

    def rebuild_memory(self) -> int:
        """Forgets the memory's vectors and makes them anew; how many there are."""
        return self.memory.rebuild(self.memory.files(self._remembered()))["chunks"]

    def memory_list(self, provider: str | None = None) -> DataFrame:
        return memory.listed(self.notes, provider).orderBy("path")

    def memory_read(self, path: str) -> DataFrame:
        return self.notes.where(F.col("path") == posixpath.normpath(path)).select("path", "content")

    def memory_write(self, title: str, content: str, tags: list[str] | None = None, provider: str | None = None) -> str:
        if not title.strip() or not content.strip():
            raise ToolError("missing_argument", "a title and a content are needed")
        provider = provider or self.config.memory_provider
        row = self.spark.createDataFrame([(0, title, content, tags or [], provider)], "note_id bigint, title string, content string, tags array<string>, provider string")
        made = memory.note_files(row.withColumn("written_at", F.current_timestamp())).select("path", "provider", "content")
        written = made.collect()  # one row, whose time is now fixed
        note = self.spark.createDataFrame(written, made.schema)
        self.memory.write(note)
        self.notes = (self.notes if self.notes is not None else note.limit(0)).unionByName(note, allowMissingColumns=True)
        return written[0]["path"]
