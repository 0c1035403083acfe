"""Queries of the engine's own operators, by name, and their SQL.

Each query takes (spark, sf_dir) and reads whole tables.  Vectors come from ``embeddings``: the label is the project,
and path and symbol are made of label and id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bytes as fb
from .functions import text as ft
from .functions import vectors as fv
from .operators import changes, memory, rules, search, stats, symbols
from .operators import files as fs
from .plans.memory import Memory
from .session import shared_folder
from .sources import chunking, scan
from .sources.embedder import HashedEmbedder
from .streaming.watch import debounce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# vectors -----------------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    label = F.col("label").cast("string")
    path = F.concat(F.lit("/vec/p"), label, F.lit("/"), F.col("vec_id").cast("string"))
    return e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("p"), label).alias("project_id"), path.alias("path"), F.concat(F.lit("sym_"), F.col("vec_id").cast("string")).alias("symbol"), "embedding")


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector: that of the lowest id."""
    return list(vectors(spark, d).orderBy("chunk_id").first()["embedding"])


_V = """v AS (SELECT vec_id AS chunk_id, 'p' || label AS project_id, '/vec/p' || label || '/' || vec_id AS path, 'sym_' || vec_id AS symbol, embedding FROM embeddings),
q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT chunk_id, project_id, path, symbol, round(list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS score FROM v, q)"""


@_query(f"WITH {_V} SELECT chunk_id, project_id, score FROM s ORDER BY score DESC, chunk_id LIMIT 10")
def semantic_topk(spark, d):
    """The ten nearest vectors."""
    return search.top_k(search.scored(vectors(spark, d), _first_vector(spark, d))).select("chunk_id", "project_id", "score")


@_query(f"WITH {_V} SELECT chunk_id, project_id, score FROM s WHERE project_id = 'p3' ORDER BY score DESC, chunk_id LIMIT 10")
def semantic_topk_filtered(spark, d):
    return search.search(vectors(spark, d), _first_vector(spark, d), project="p3").select("chunk_id", "project_id", "score")


@_query(f"WITH {_V}, c AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 40) SELECT chunk_id, path, score FROM c WHERE path LIKE '/vec/p3/%' ORDER BY score DESC, chunk_id LIMIT 10")
def semantic_topk_path_compat(spark, d):
    """The path is filtered among the best 4k."""
    return search.search(vectors(spark, d), _first_vector(spark, d), path="/vec/p3").select("chunk_id", "path", "score")


@_query(f"WITH {_V} SELECT chunk_id, path, score FROM s WHERE path LIKE '/vec/p3/%' ORDER BY score DESC, chunk_id LIMIT 10")
def semantic_topk_path_exact(spark, d):
    return search.search(vectors(spark, d), _first_vector(spark, d), path="/vec/p3", exact=True).select("chunk_id", "path", "score")


@_query(
    f"WITH {_V}, c AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 20) SELECT chunk_id, round(score + CASE WHEN contains(symbol, 'm_1') THEN 0.1 WHEN contains(path, 'm_1') THEN 0.05 ELSE 0 END, 6) AS score "
    "FROM c ORDER BY score DESC, chunk_id LIMIT 10"
)
def semantic_rerank_boost(spark, d):
    return search.search(vectors(spark, d), _first_vector(spark, d), text="M_1").select("chunk_id", "score")


@_query(
    f"""WITH {_V.split("q AS")[0].rstrip().rstrip(",")}, p AS (SELECT a.chunk_id AS query_id, b.chunk_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM v a, v b WHERE a.chunk_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p) SELECT query_id, chunk_id, score, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def query_batch_topk(spark, d):
    """The ten nearest of all vectors for every vector whose id is divisible by 100."""
    v = vectors(spark, d)
    asked = v.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.batch_top_k(asked, v, 10)


@_query(
    f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, chunk_id) AS n FROM s) SELECT project_id AS path, chunk_id, score FROM r WHERE n = 1"
)
def best_per_path(spark, d):
    """The best hit of each label, as of each remembered file."""
    hits = search.scored(vectors(spark, d), _first_vector(spark, d)).select(F.col("project_id").alias("path"), "chunk_id", F.col("chunk_id").alias("start_line"), "score")
    return search.best_per_path(hits).select("path", "chunk_id", "score")


@_query(
    f"""WITH {_V}, l AS (SELECT 0 AS o, 'code' AS source, chunk_id, path, score FROM (SELECT * FROM s WHERE project_id < 'p6' ORDER BY score DESC, chunk_id LIMIT 30)
UNION ALL SELECT 1, 'docs', chunk_id, path, score FROM (SELECT * FROM s WHERE project_id > 'p3' ORDER BY score DESC, chunk_id LIMIT 30)),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY o, score DESC) AS n FROM l)
SELECT source, path, score FROM r WHERE n = 1 ORDER BY score DESC, path LIMIT 20"""
)
def unified_search_dedup(spark, d):
    rows = search.scored(vectors(spark, d), _first_vector(spark, d)).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(1)).withColumn("content", F.col("symbol"))
    legs = {"code": search.top_k(rows.where("project_id < 'p6'"), 30), "docs": search.top_k(rows.where("project_id > 'p3'"), 30)}
    return search.unified(legs, 20).select("source", "path", "score")


@_query("SELECT count(*) AS vectors, min(len(embedding))::INT AS least, max(len(embedding))::INT AS most FROM embeddings")
def dim_check(spark, d):
    return changes.dimension(table(spark, d, "embeddings"))


@_query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)
SELECT doc_id, (('0x' || left(md5(word), 8))::BIGINT % 64)::INT AS bucket, count(*) AS n FROM w GROUP BY ALL"""
)
def hashed_word_counts(spark, d):
    """What the hashed embedder counts: words of each document by dimension."""
    w = table(spark, d, "documents").select("doc_id", F.explode(fv.words(F.col("text"))).alias("word"))
    return w.groupBy("doc_id", fv.bucket(F.col("word"), 64).alias("bucket")).agg(F.count("*").alias("n"))


@_query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
c AS (SELECT doc_id, ('0x' || left(md5(word), 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
q AS (SELECT ('0x' || left(md5(word), 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT unnest(['sparse', 'cursor', 'lease', 'window']) AS word) GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM c GROUP BY ALL)
SELECT c.doc_id, round(sum(c.n * q.n) / max(l.len) / (SELECT sqrt(sum(n * n)) FROM q), 6) AS score FROM c JOIN q USING (b) JOIN l USING (doc_id) GROUP BY c.doc_id ORDER BY score DESC, c.doc_id LIMIT 10"""
)
def docs_topk_hashed(spark, d):
    """The ten documents nearest to a text, under the hashed embedder."""
    e = HashedEmbedder()
    rows = e.embed(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
    return search.top_k(search.scored(rows, e.query("sparse cursor lease window"))).select(F.col("chunk_id").alias("doc_id"), "score")


# files, hashes, changes --------------------------------------------------------------------------------------------


@_query("SELECT file_id, path, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seen_at DESC) AS n FROM files) WHERE n = 1")
def latest_files(spark, d):
    return changes.latest(table(spark, d, "files")).select("file_id", "path", "seen_at")


@_query("SELECT DISTINCT file_id, sha256(content) AS hash, coalesce(hash = sha256(content), false) AS stored FROM files WHERE content IS NOT NULL")
def file_hashes(spark, d):
    h = fb.sha256(F.col("content"))
    return table(spark, d, "files").where("content is not null").select("file_id", h.alias("hash"), F.coalesce(F.col("hash") == h, F.lit(False)).alias("stored")).distinct()


@_query("SELECT DISTINCT chunk_id, sha256(path || chr(10) || content) AS made, chunk_id = sha256(path || chr(10) || content) AS same FROM chunks")
def chunk_ids(spark, d):
    made = fb.chunk_id(F.col("path"), F.col("content"))
    return table(spark, d, "chunks").select("chunk_id", made.alias("made"), (F.col("chunk_id") == made).alias("same")).distinct()


@_query(
    """WITH f AS (SELECT DISTINCT path, coalesce(hash, '') AS hash FROM files WHERE content IS NOT NULL), o AS (SELECT path, max(file_hash) AS hash FROM chunks GROUP BY path)
SELECT f.path, f.hash FROM f LEFT JOIN o USING (path) WHERE f.hash IS DISTINCT FROM o.hash"""
)
def changed_files(spark, d):
    """Files whose hash is not the one their chunks were cut from."""
    now = table(spark, d, "files").where("content is not null").select("path", F.coalesce("hash", F.lit("")).alias("hash")).distinct()
    state = table(spark, d, "chunks").groupBy("path").agg(F.max("file_hash").alias("hash"))
    return changes.changed(now, state)


@_query("SELECT DISTINCT path FROM chunks WHERE path NOT IN (SELECT path FROM files WHERE rel_path LIKE 'src/%' AND path IS NOT NULL)")
def deleted_files(spark, d):
    """Indexed paths that are gone when only the files below ``src`` are left."""
    state = table(spark, d, "chunks").select("path").distinct()
    return changes.deleted(table(spark, d, "files").where("rel_path like 'src/%'"), state)


@_query(
    """WITH b AS (SELECT path, max(file_hash) AS h FROM chunks GROUP BY path), a AS (SELECT DISTINCT path, hash AS h FROM files WHERE rel_path NOT LIKE 'docs/%')
SELECT path, CASE WHEN b.path IS NULL THEN 'create' WHEN a.path IS NULL THEN 'remove' ELSE 'write' END AS kind FROM b FULL JOIN a USING (path) WHERE b.path IS NULL OR a.path IS NULL OR b.h IS DISTINCT FROM a.h"""
)
def snapshot_changes(spark, d):
    """From what is indexed to the files outside ``docs``: what a watcher would report."""
    before = table(spark, d, "chunks").groupBy("path").agg(F.max("file_hash").alias("hash"))
    return changes.between(before, table(spark, d, "files").where("rel_path not like 'docs/%'").select("path", "hash").distinct())


@_query("SELECT DISTINCT chunk_id, path FROM chunks WHERE path NOT IN (SELECT path FROM files WHERE rel_path LIKE 'docs/%')")
def delete_paths(spark, d):
    """Chunks left when the files below ``docs`` are taken out."""
    store = table(spark, d, "chunks").select("chunk_id", "path").distinct()
    return changes.delete_paths(store, table(spark, d, "files").where("rel_path like 'docs/%'"))


@_query(
    """WITH c AS (SELECT DISTINCT chunk_id, start_line FROM chunks), n AS (SELECT chunk_id, min(start_line) AS start_line FROM c WHERE start_line > 20 GROUP BY chunk_id)
SELECT chunk_id, start_line FROM n UNION ALL SELECT chunk_id, start_line FROM c WHERE start_line <= 40 AND chunk_id NOT IN (SELECT chunk_id FROM n)"""
)
def upsert_chunks(spark, d):
    """Chunks that begin below line 20 take the place of those with their ids in a store of the others."""
    c = table(spark, d, "chunks").select("chunk_id", "start_line").distinct()
    return changes.upsert(c.where("start_line <= 40"), c.where("start_line > 20"))


@_query("SELECT DISTINCT chunk_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM chunks WHERE start_line > 20) THEN 'known' ELSE 'made' END AS embedding FROM chunks")
def embedding_cache(spark, d):
    """Which chunks' vectors are taken from an index that knows those below line 20, and which are made."""
    c = table(spark, d, "chunks")
    known = c.where("start_line > 20").select("chunk_id", F.lit("known").alias("embedding"))
    return changes.with_embeddings(c.select("chunk_id").distinct(), known, lambda missing: missing.withColumn("embedding", F.lit("made")))


_GLOB = "'^' || replace(replace(replace(replace(replace(replace(p, '.', '\\.'), '/**', '@E'), '**/', '@S'), '*', '[^/]*'), '@E', '(?:/.*)?'), '@S', '(?:[^/]+/)*') || CASE WHEN regexp_matches(p, '[*/?]') THEN '$' ELSE '(?:/.*)?$' END"
_EXCLUDED = "['node_modules/**', '.git/**', 'vendor/**', 'dist/**', 'build/**', '__pycache__/**']"


@_query(
    f"""WITH r AS (SELECT project_id, include, list_concat({_EXCLUDED}, coalesce(exclude, [])) AS exclude, CASE WHEN coalesce(len(extensions), 0) = 0 THEN ['.go', '.py', '.js', '.ts', '.jsx', '.tsx', '.rs', '.md'] ELSE extensions END AS exts, coalesce(max_file_size_mb, 0) AS mb FROM projects),
f AS (SELECT DISTINCT file_id, project_id, rel_path, lower(rel_path) AS low, size FROM files)
SELECT f.file_id, coalesce((coalesce(len(include), 0) = 0 OR list_bool_or(list_transform(include, lambda p: regexp_matches(low, {_GLOB}))))
  AND NOT list_bool_or(list_transform(r.exclude, lambda p: regexp_matches(low, {_GLOB})))
  AND list_contains(exts, lower(regexp_extract(rel_path, '(\\.[^./]*)$', 1))) AND regexp_extract(rel_path, '(\\.[^./]*)$', 1) <> '' AND (mb = 0 OR size <= mb * 1048576), false) AS indexed
FROM f LEFT JOIN r USING (project_id)"""
)
def should_index(spark, d):
    """Every file, judged by the rule of its project."""
    f = table(spark, d, "files").select("file_id", "project_id", "rel_path", "size").distinct()
    return rules.with_rules(f, table(spark, d, "projects")).select("file_id", "indexed")


@_query("SELECT DISTINCT f.path FROM files f, projects p WHERE f.path = p.path OR starts_with(f.path, p.path || '/')")
def path_allowed(spark, d):
    """Paths of files that lie in a project."""
    return rules.allowed_paths(table(spark, d, "files").select("path").distinct(), table(spark, d, "projects"))


@_query(
    """WITH f AS (SELECT DISTINCT path, rel_path, left(path, greatest(len(path) - len(rel_path) - 1, 0)) AS root FROM files WHERE path IS NOT NULL AND rel_path IS NOT NULL)
SELECT path, root IN (SELECT path FROM projects) AND CASE WHEN regexp_matches(rel_path, '^(?:.*/)?tools/') THEN true WHEN regexp_matches(rel_path, '^(?:.*/)?README[^/]*(?:/.*)?$') THEN false ELSE regexp_matches(rel_path, '^(?:.*/)?[^/]*\\.md(?:/.*)?$') END AS ignored FROM f"""
)
def ignored_files(spark, d):
    """Every file, by an ignore file at the root of each project."""
    root = F.expr("left(path, greatest(length(path) - length(rel_path) - 1, 0))")
    f = table(spark, d, "files").where("path is not null and rel_path is not null").select("path", "rel_path", root.alias("root")).distinct()
    files = table(spark, d, "projects").select(F.col("path").alias("root"), F.lit("").alias("dir"), F.lit("# kept out\n*.md\n!README*\ntools/\n").alias("content"))
    return rules.ignored(f, files).select("path", "ignored")


@_query("SELECT DISTINCT path FROM files WHERE NOT (path = '/srv/src/lattice-core' OR starts_with(path, '/srv/src/lattice-core/'))")
def delete_under(spark, d):
    return rules.delete_under(table(spark, d, "files").select("path").distinct(), "/srv/src/lattice-core")


# chunks and symbols ------------------------------------------------------------------------------------------------


@_query(
    """SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS symbol, 1 AS start_line, len(string_split(content, chr(10)))::INT AS end_line, sha256(path || chr(10) || content) AS chunk_id FROM files
WHERE content IS NOT NULL AND NOT regexp_matches(lower(path), '\\.(go|py|js|jsx|mjs|cjs|ts|tsx|rs|md)$')"""
)
def chunk_whole_file(spark, d):
    """Files of no known language, each one chunk."""
    f = table(spark, d, "files").where("content is not null").withColumn("language", ft.language(F.col("path"))).where("language = ''").withColumn("file_hash", F.col("hash"))
    return chunking.whole(f).select("path", "symbol", "start_line", "end_line", fb.chunk_id(F.col("path"), F.col("content")).alias("chunk_id")).distinct()


_HEADER = "^#{1,6}[\\t\\f\\r ]+."


@_query(
    f"""WITH f AS (SELECT DISTINCT path, content FROM files WHERE content IS NOT NULL AND lower(path) LIKE '%.md'),
l AS (SELECT path, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n, len(string_split(content, chr(10))) AS last FROM f),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_HEADER}') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS section FROM l),
s AS (SELECT path, section, min(n) AS first, max(n) AS final, max(last) AS last, arg_min(line, n) AS head, string_agg(line, chr(10) ORDER BY n) AS body FROM g WHERE section > 0 GROUP BY path, section)
SELECT path, regexp_replace(head, '^\\s+|\\s+$', '', 'g') AS symbol, first::INT AS start_line, CASE WHEN final = last THEN final ELSE final + 1 END::INT AS end_line,
  sha256(path || chr(10) || body || CASE WHEN final = last THEN '' ELSE chr(10) END) AS chunk_id FROM s"""
)
def markdown_sections(spark, d):
    """Sections of Markdown files."""
    f = table(spark, d, "files").where("content is not null").withColumn("language", ft.language(F.col("path"))).where("language = 'markdown'")
    f = f.select("path", "content", F.lit("").alias("project_id"), F.lit("").alias("file_hash"), "language").distinct()
    return chunking.sections(f).select("path", "symbol", "start_line", "end_line", fb.chunk_id(F.col("path"), F.col("content")).alias("chunk_id"))


@_query()
def chunk_files(spark, d):
    """All files cut into chunks; the syntax branch has no SQL form and is tested against the given table of chunks."""
    return chunking.chunk(changes.latest(table(spark, d, "files"))).select("chunk_id", "path", "language", "symbol", "signature", "start_line", "end_line")


_SYMBOLS = "c AS (SELECT DISTINCT project_id, path, language, symbol, signature, start_line, end_line FROM chunks WHERE symbol <> '')"


def _symbols(spark, d):
    return symbols.locations(table(spark, d, "chunks")).distinct()


@_query(f"WITH {_SYMBOLS} SELECT lower(symbol) AS symbol_key, count(*) AS places, min(path) AS first_path FROM c GROUP BY ALL")
def symbol_index(spark, d):
    blocks = symbols.symbol_index(_symbols(spark, d))
    return blocks.groupBy("symbol_key").agg(F.sum("places").alias("places"), F.min(F.col("locations")[0]["path"]).alias("first_path"))


@_query(f"WITH {_SYMBOLS} SELECT path, symbol, start_line FROM c WHERE lower(symbol) = 'constructor' OR lower(symbol) = '# plan' OR lower(symbol) = 'license'")
def symbol_exact(spark, d):
    s = _symbols(spark, d)
    found = symbols.exact(s, "Constructor").unionByName(symbols.exact(s, "# Plan")).unionByName(symbols.exact(s, "LICENSE"))
    return found.select("path", "symbol", "start_line")


@_query(f"WITH {_SYMBOLS} SELECT path, symbol, start_line FROM c WHERE contains(lower(symbol), 'cursor')")
def symbol_fuzzy(spark, d):
    return symbols.fuzzy(_symbols(spark, d), "Cursor").select("path", "symbol", "start_line")


@_query(f"WITH {_SYMBOLS} SELECT path, symbol, start_line, 1.0::DOUBLE AS score FROM c WHERE contains(lower(symbol), 'guard') AND lower(language) = 'typescript'")
def find_symbol(spark, d):
    """No symbol is named so: names that contain it, then the language."""
    return symbols.find_symbol(_symbols(spark, d), "Guard", language="TypeScript").select("path", "symbol", "start_line", "score")


# grep and listings -------------------------------------------------------------------------------------------------

_LINES = "l AS (SELECT path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM (SELECT DISTINCT path, content FROM files WHERE content IS NOT NULL))"


def _files(spark, d):
    return table(spark, d, "files").select("path", "rel_path", "content")


@_query(f"WITH {_LINES} SELECT path, line, content FROM l WHERE contains(content, 'retrying')")
def grep_substring(spark, d):
    return fs.grep(_files(spark, d), "retrying", most_bytes=None)


@_query(f"WITH {_LINES} SELECT path, line, content FROM l WHERE contains(content, 'retrying') AND path IN (SELECT path FROM files WHERE strlen(content) <= 2000)")
def grep_small_files(spark, d):
    """Only texts of at most 2,000 bytes are searched."""
    return fs.grep(_files(spark, d), "retrying", most_bytes=2000)


@_query(f"WITH {_LINES} SELECT path, line, content FROM l WHERE regexp_matches(content, 'func [A-Z][a-z]+')")
def grep_regex(spark, d):
    return fs.grep(_files(spark, d), "func [A-Z][a-z]+", regex=True, most_bytes=None)


@_query(f"WITH {_LINES} SELECT path, line, content FROM l WHERE contains(content, 'TODO') ORDER BY path, line LIMIT 20")
def grep_topk(spark, d):
    return fs.grep_top(_files(spark, d), "TODO", most_bytes=None)


@_query("SELECT DISTINCT path, array_to_string(string_split(content, chr(10))[3:8], chr(10)) AS content FROM files WHERE content IS NOT NULL AND len(string_split(content, chr(10))) >= 3")
def line_range(spark, d):
    """Lines 3 to 8 of every file that has a third."""
    return fs.context(_files(spark, d), 3, 8)


@_query("SELECT DISTINCT path, 'file' AS type FROM files WHERE regexp_matches(rel_path, '^docs/(?:[^/]+/)*[^/]*\\.md$')")
def list_glob(spark, d):
    return fs.listing(_files(spark, d), "docs/**/*.md")


@_query(
    """WITH f AS (SELECT DISTINCT left(path, len(path) - len(rel_path) - 1) AS root, path, rel_path, string_split(rel_path, '/') AS s FROM files),
e AS (SELECT path, rel_path, 'file' AS type FROM f UNION SELECT root || '/' || array_to_string(s[1:n], '/'), array_to_string(s[1:n], '/'), 'dir' FROM f, generate_series(1, 30) g(n) WHERE n < len(s))
SELECT path, type FROM e WHERE regexp_matches(rel_path, '^src/[^/]*$')"""
)
def list_glob_directories(spark, d):
    return fs.listing(_files(spark, d), "src/*", directories=True)


@_query(
    """WITH f AS (SELECT DISTINCT left(path, len(path) - len(rel_path) - 1) AS root, rel_path, string_split(rel_path, '/') AS s FROM files),
e AS (SELECT root, rel_path AS path, 'file' AS type FROM f UNION SELECT root, array_to_string(s[1:n], '/'), 'dir' FROM f, generate_series(1, 12) g(n) WHERE n < len(s))
SELECT root, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, len(string_split(path, '/'))::INT AS depth, type FROM e WHERE len(string_split(path, '/')) <= 3"""
)
def dir_tree(spark, d):
    return fs.tree(_files(spark, d))


@_query("SELECT path, strftime(max(mod_time), '%Y-%m-%dT%H:%M:%SZ') AS mod_time FROM files WHERE mod_time > (SELECT max(mod_time) FROM files) - INTERVAL 43200 MINUTE GROUP BY path")
def recent_changes(spark, d):
    """Files changed within thirty days before the newest change."""
    f = table(spark, d, "files")
    newest = f.agg(F.max("mod_time").alias("m")).first()["m"]
    return fs.recent(f, F.lit(newest).cast("timestamp_ntz"), 30 * 24 * 60)


@_query("SELECT file_id, max(CASE WHEN contains(left(content, 512), chr(0)) THEN 0 ELSE 1 END)::BOOLEAN AS text FROM files WHERE content IS NOT NULL GROUP BY file_id")
def text_files(spark, d):
    f = table(spark, d, "files").where("content is not null")
    return f.groupBy("file_id").agg(F.max(fb.is_text(F.encode("content", "UTF-8"))).alias("text"))


_LANGUAGE = "CASE regexp_extract(lower(path), '(\\.[^./]*)$', 1) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.rs' THEN 'rust' WHEN '.md' THEN 'markdown' ELSE '' END"


@_query(f"SELECT {_LANGUAGE} AS language, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT path, size FROM files) GROUP BY ALL")
def files_by_language(spark, d):
    f = table(spark, d, "files").select("path", "size").distinct()
    return f.groupBy(ft.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


# status ------------------------------------------------------------------------------------------------------------


@_query("SELECT project_id, count(*) AS chunks FROM chunks GROUP BY ALL")
def count_by_project(spark, d):
    return stats.by_project(table(spark, d, "chunks"))


@_query("SELECT count(*) AS chunks, count_if(symbol <> '') AS symbols, count(DISTINCT path) AS paths FROM chunks")
def index_totals(spark, d):
    return stats.totals(table(spark, d, "chunks"))


@_query(
    "SELECT p.project_id, p.path, coalesce(c.n, 0) AS chunks, c.t AS last_indexed_at FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n, max(indexed_at) AS t FROM chunks GROUP BY ALL) c USING (project_id)"
)
def index_status(spark, d):
    return stats.project_status(table(spark, d, "projects"), table(spark, d, "chunks"))


@_query(
    """WITH f AS (SELECT project_id, count(DISTINCT path) AS total, count(DISTINCT CASE WHEN hash <> '' THEN path END) AS done FROM files WHERE project_id IS NOT NULL GROUP BY ALL)
SELECT project_id, CASE WHEN done > 0 AND done < total THEN floor((total - done) / (done / 120.0)) ELSE 0 END::BIGINT AS eta_seconds, round(100.0 * done / total)::INT AS percent FROM f"""
)
def index_eta(spark, d):
    """Each project's time left if its hashed files took two minutes."""
    f = table(spark, d, "files").where("project_id is not null").groupBy("project_id").agg(F.count_distinct("path").alias("total"), F.count_distinct(F.when(F.col("hash") != "", F.col("path"))).alias("done"))
    return f.select("project_id", ft.eta_seconds(F.lit("running"), F.col("total"), F.col("done"), F.lit(120.0)).alias("eta_seconds"), ft.percent(F.col("done"), F.col("total")).alias("percent"))


@_query(
    """WITH e AS (SELECT user_id AS key, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT key, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS events, count(DISTINCT event_type) AS paths FROM b GROUP BY key, burst"""
)
def debounce_sessions(spark, d):
    """Bursts of a user's events with pauses of at most ten minutes."""
    b = debounce(table(spark, d, "events"), "10 minutes", key="user_id", path="event_type")
    return b.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events", F.size("paths").cast("bigint").alias("paths"))


# memory ------------------------------------------------------------------------------------------------------------

_TURNS = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY exported_at DESC) AS rn FROM turns) WHERE rn = 1 AND length(content) > 0)"


@_query("SELECT DISTINCT turn_id FROM turns WHERE strlen(content) >= 40 OR role IS DISTINCT FROM 'user'")
def turn_filter(spark, d):
    return memory.long_enough(table(spark, d, "turns"), 40).select("turn_id").distinct()


@_query(f"WITH {_TURNS} SELECT session_id, count(*) AS turns, sum(strlen(content))::BIGINT AS bytes, count(DISTINCT content) AS strings FROM t GROUP BY ALL")
def session_summary(spark, d):
    return memory.session_summary(table(spark, d, "turns"))


@_query(
    f"""WITH {_TURNS}, s AS (SELECT session_id, coalesce(max(provider), '') AS provider, sum(strlen(content)) AS bytes, count(*) AS n, count(DISTINCT content) AS k,
  string_agg('### ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10) || replace(content, '#', '\\#') || chr(10) || chr(10), '' ORDER BY ordinal NULLS FIRST, turn_id) AS body FROM t GROUP BY session_id),
x AS (SELECT session_id, string_agg(replace(content, '#', '\\#') || chr(10) || chr(10), '' ORDER BY o, i) AS strings FROM (SELECT session_id, content, min(coalesce(ordinal, -1)) AS o, arg_min(turn_id, (coalesce(ordinal, -1), turn_id)) AS i FROM t GROUP BY ALL) GROUP BY session_id)
SELECT session_id, sha256('# Chat trajectory: ' || session_id || chr(10) || chr(10) || '- **Provider:** ' || provider || chr(10) || '- **Decrypted size:** ' || bytes || ' bytes' || chr(10) || '- **Dialogue turns:** ' || n || chr(10) || '- **Extracted strings:** ' || k
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Dialogue' || chr(10) || chr(10) || body || '## All extracted strings' || chr(10) || chr(10) || strings) AS hash FROM s JOIN x USING (session_id)"""
)
def session_markdown(spark, d):
    """Each session as one Markdown text, by its hash."""
    return memory.session_markdown(table(spark, d, "turns")).select("session_id", fb.sha256(F.col("content")).alias("hash"))


_SESSIONS = f"""{_TURNS}, s AS (SELECT session_id, coalesce(max(provider), '') AS provider, sum(strlen(content)) AS bytes, count(*) AS n, count(DISTINCT content) AS k,
  string_agg('### ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10) || replace(content, '#', '\\#') || chr(10) || chr(10), '' ORDER BY ordinal NULLS FIRST, turn_id) AS body FROM t GROUP BY session_id),
x AS (SELECT session_id, string_agg(replace(content, '#', '\\#') || chr(10) || chr(10), '' ORDER BY o, i) AS strings FROM (SELECT session_id, content, min(coalesce(ordinal, -1)) AS o, arg_min(turn_id, (coalesce(ordinal, -1), turn_id)) AS i FROM t GROUP BY ALL) GROUP BY session_id),
m AS (SELECT session_id, '/memory/chats/' || session_id || '.md' AS path, '# Chat trajectory: ' || session_id || chr(10) || chr(10) || '- **Provider:** ' || provider || chr(10) || '- **Decrypted size:** ' || bytes || ' bytes' || chr(10) || '- **Dialogue turns:** ' || n || chr(10) || '- **Extracted strings:** ' || k
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Dialogue' || chr(10) || chr(10) || body || '## All extracted strings' || chr(10) || chr(10) || strings AS content FROM s JOIN x USING (session_id))"""
_SECTIONS = f"""lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n, len(string_split(content, chr(10))) AS last FROM m),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_HEADER}') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS section FROM lines),
grouped AS (SELECT path, section, min(n) AS first, max(n) AS final, max(last) AS last, arg_min(line, n) AS head, string_agg(line, chr(10) ORDER BY n) AS body FROM numbered WHERE section > 0 GROUP BY path, section),
sections AS (SELECT path, regexp_replace(head, '^\\s+|\\s+$', '', 'g') AS symbol, first::INT AS start_line, CASE WHEN final = last THEN final ELSE final + 1 END::INT AS end_line, body || CASE WHEN final = last THEN '' ELSE chr(10) END AS content FROM grouped)"""


@_query(f"WITH {_SESSIONS}, {_SECTIONS} SELECT path, symbol, start_line, end_line, sha256(path || chr(10) || content) AS chunk_id FROM sections")
def session_sections(spark, d):
    """The sections of all session texts, as the memory indexes them."""
    m = memory.session_markdown(table(spark, d, "turns"))
    f = m.select(F.lit("memory-cascade").alias("project_id"), "path", F.lit("").alias("file_hash"), F.lit("markdown").alias("language"), "content")
    return chunking.sections(f).select("path", "symbol", "start_line", "end_line", fb.chunk_id(F.col("path"), F.col("content")).alias("chunk_id"))


@_query(
    f"""WITH {_SESSIONS}, {_SECTIONS},
w AS (SELECT path, start_line, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS word FROM sections),
c AS (SELECT path, start_line, ('0x' || left(md5(word), 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
q AS (SELECT ('0x' || left(md5(word), 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT unnest(['stale', 'cursor', 'timeout']) AS word) GROUP BY ALL),
l AS (SELECT path, start_line, sqrt(sum(n * n)) AS len FROM c GROUP BY ALL),
r AS (SELECT path, start_line, round(sum(coalesce(c.n * q.n, 0)) / max(l.len) / (SELECT sqrt(sum(n * n)) FROM q), 6) AS score FROM c LEFT JOIN q USING (b) JOIN l USING (path, start_line) GROUP BY path, start_line),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, start_line) AS rank FROM r)
SELECT path, symbol, start_line, score, CASE WHEN length(content) > 800 THEN left(content, 800) || '...' ELSE content END AS content FROM o JOIN sections USING (path, start_line) WHERE rank = 1 ORDER BY score DESC, path LIMIT 10"""
)
def memory_topk(spark, d):
    """The ten remembered sessions nearest to a text: the best section of each, with a preview."""
    e = HashedEmbedder()
    m = memory.session_markdown(table(spark, d, "turns"))
    f = m.select(F.lit("memory-cascade").alias("project_id"), "path", F.lit("").alias("file_hash"), F.lit("markdown").alias("language"), "content")
    s = chunking.sections(f).withColumn("chunk_id", fb.chunk_id(F.col("path"), F.col("content")))
    return search.memory_search(e.embed(s), e.query("stale cursor timeout"), 10, exact=True).select("path", "symbol", "start_line", "score", "content")


_SLUG = "CASE WHEN s = '' THEN 'note' ELSE s END"


@_query(
    f"""WITH n AS (SELECT DISTINCT note_id, title, content, tags, CASE WHEN coalesce(provider, '') = '' THEN 'cascade' ELSE provider END AS provider, written_at FROM notes),
s AS (SELECT *, left(trim(regexp_replace(lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')), '[^a-z0-9-]', '-', 'g'), '-'), 60) AS s FROM n)
SELECT note_id, '/memory/' || provider || '/' || strftime(written_at, '%Y%m%d-%H%M%S') || '-' || {_SLUG} || '.md' AS path,
sha256('# ' || coalesce(title, '') || chr(10) || chr(10) || '- **Provider:** ' || provider || chr(10) || CASE WHEN coalesce(len(tags), 0) > 0 THEN '- **Tags:** ' || array_to_string(tags, ', ') || chr(10) ELSE '' END
  || '- **Saved:** ' || strftime(written_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || chr(10) || coalesce(content, '') || chr(10)) AS hash FROM s"""
)
def note_files(spark, d):
    """Notes as the files they are written to."""
    return memory.note_files(table(spark, d, "notes")).select("note_id", "path", fb.sha256(F.col("content")).alias("hash"))


@_query(
    f"""WITH n AS (SELECT DISTINCT note_id, title, content, tags, CASE WHEN coalesce(provider, '') = '' THEN 'cascade' ELSE provider END AS provider, written_at FROM notes),
s AS (SELECT *, left(trim(regexp_replace(lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')), '[^a-z0-9-]', '-', 'g'), '-'), 60) AS s FROM n)
SELECT DISTINCT 'memory-' || provider AS project_id, '/memory/' || provider || '/' || strftime(written_at, '%Y%m%d-%H%M%S') || '-' || {_SLUG} || '.md' AS path,
sha256('# ' || coalesce(title, '') || chr(10) || chr(10) || '- **Provider:** ' || provider || chr(10) || CASE WHEN coalesce(len(tags), 0) > 0 THEN '- **Tags:** ' || array_to_string(tags, ', ') || chr(10) ELSE '' END
  || '- **Saved:** ' || strftime(written_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || chr(10) || coalesce(content, '') || chr(10)) AS hash FROM s"""
)
def memory_sync(spark, d):
    """What the memory knows of all notes after it was filled when some had other names and some other texts."""
    made = memory.note_files(table(spark, d, "notes"))
    store = Memory(spark, shared_folder(spark, "memory"))
    store.sync(made.withColumn("path", F.expr("if(provider = 'cascade', path, concat(path, '.old'))")).withColumn("content", F.expr("if(length(content) > 300, content, concat(content, 'old'))")))
    store.sync(made)
    return store.state().select("project_id", "path", "hash")


@_query("SELECT DISTINCT turn_id, content FROM turns WHERE content IS NOT NULL")
def decrypted_turns(spark, d):
    """Turns that were encrypted, read again with the key."""
    key = F.lit(b"0123456789abcdef")
    t = table(spark, d, "turns").where("content is not null").select("turn_id", F.aes_encrypt(F.encode("content", "UTF-8"), key, F.lit("GCM")).alias("secret"), "content").drop("content")
    return t.select("turn_id", F.decode(fb.decrypted(F.col("secret"), key), "UTF-8").alias("content")).distinct()


def _varint(n: Column) -> Column:
    """The hexadecimal digits of a number below 2^21 as seven bits to a byte, the lowest first."""

    def low(x):
        return F.hex(x.bitwiseAND(127).bitwiseOR(128))

    return F.when(n < 128, F.lpad(F.hex(n), 2, "0")).when(n < 1 << 14, F.concat(low(n), F.lpad(F.hex(F.shiftright(n, 7)), 2, "0"))).otherwise(F.concat(low(n), low(F.shiftright(n, 7)), F.lpad(F.hex(F.shiftright(n, 14)), 2, "0")))


@_query("SELECT DISTINCT turn_id::VARCHAR AS path, 0 AS ordinal, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, content FROM turns WHERE length(content) > 0")
def dialogue_turns(spark, d):
    """Each turn written as a session's bytes (step 2 holding field 19 or 20) and read again."""
    t = table(spark, d, "turns").where("length(content) > 0").select("turn_id", F.coalesce(F.col("role") == "user", F.lit(False)).alias("user"), F.hex(F.encode("content", "UTF-8")).alias("text")).distinct()
    field = F.concat(F.when(F.col("user"), "9A01").otherwise("A201"), _varint((F.length("text") / 2).cast("bigint")), "text")
    step = t.select("turn_id", field.alias("field"))
    data = F.unhex(F.concat(F.lit("12"), _varint((F.length("field") / 2).cast("bigint")), "field"))
    return scan.dialogue(step.select(F.col("turn_id").cast("string").alias("path"), data.alias("content")))


@_query("SELECT DISTINCT CASE WHEN coalesce(provider, '') = '' THEN 'cascade' ELSE provider END AS provider, count(DISTINCT note_id) AS notes FROM notes GROUP BY 1")
def notes_by_provider(spark, d):
    """Providers as the headers of the note files name them."""
    return memory.listed(memory.note_files(table(spark, d, "notes"))).groupBy("provider").agg(F.count("*").alias("notes"))


@_query("SELECT DISTINCT chunk_id, CASE WHEN length(content) > 800 THEN left(content, 800) || '...' ELSE content END AS preview FROM chunks")
def previews(spark, d):
    return table(spark, d, "chunks").select("chunk_id", ft.preview(F.col("content")).alias("preview")).distinct()


@_query("SELECT DISTINCT session_id, CASE WHEN regexp_extract(session_id, '^(.+)-[^-]*$', 1) = '' THEN session_id ELSE regexp_extract(session_id, '^(.+)-[^-]*$', 1) END AS prefix FROM turns")
def job_prefix(spark, d):
    return table(spark, d, "turns").select("session_id", ft.job_prefix(F.col("session_id")).alias("prefix")).distinct()


@_query("SELECT turn_id, len(list_filter(regexp_extract_all(content, '[\\t\\n\\r -~]{4,}'), lambda x: true))::INT AS runs FROM (SELECT DISTINCT turn_id, content FROM turns WHERE content IS NOT NULL)")
def printable_runs(spark, d):
    """Runs of printable ASCII in each turn's bytes."""
    t = table(spark, d, "turns").where("content is not null").select("turn_id", "content").distinct()
    return t.select("turn_id", F.size(fb.printable_runs(F.encode("content", "UTF-8"))).alias("runs"))
