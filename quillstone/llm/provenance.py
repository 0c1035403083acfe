"""Problem 2: generated, minified, third-party and bulk-data files.

Patterns decide; what they are mined from are labels:

* repository attribute files (``.gitattributes``) that mark paths ``linguist-generated`` or ``linguist-vendored``; the
  deepest directory wins, within a file the last line.  Below them all stand ``DEFAULT_ATTRIBUTES``, lines of the same
  form with the names that tools and package managers are known to give;
* the content: the public marker of a generator, a notice that names another project, the density of minified code,
  literals without code, and 5-word shingles shared with the published files of a library.

Patterns are mined from the paths (a directory, a pair of directories, a directory over a version, a file-name affix),
from the first words of the comment lines, and from the shape of the text.  A pattern is kept if enough of
its files, in several projects, carry a label.  Kept patterns decide the files of projects that declare nothing; a file
that no pattern meets is decided by its own labels.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few, shared_checkpoint
from .common import map_rows, project_of, rel_of

#: A mined pattern needs this many files with evidence, in this many projects, and this share of all its files.
LEAST_FILES, LEAST_PROJECTS, LEAST_SHARE = 8, 5, 0.4
#: A pair of directories is an exception from a pattern of one of the two if its share is this part of the pattern's or less.
EXCEPTION_FILES, EXCEPTION_PROJECTS, EXCEPTION_SHARE = 5, 3, 0.2
#: The same share for the first words of a comment line: only part of the files that bear them have a label of another kind.
LINE_SHARE = 0.25
#: Words of a shingle, containment from which a file is a copy, shingles below which two texts must agree as a whole.
WORDS, COPY, WHOLE = 5, 0.8, 20
#: Bits of the filter of published shingles, one per size band of published files: its size does not depend on how many there are.
FILTER_BITS = 1 << 22
#: Parts into which a shingle that many files share is split.
SALT = 16
SOURCE = re.compile(r"\.(?:go|py|js|mjs|cjs|jsx|ts|tsx|rs|css|java|c|cc|cpp|h|rb|php|kt|swift)$")

_COMMENT = r"^[ \t]*(?://+!?|#+!?|/\*+!?|\*+|<!--|--|;+|%|\"\"\"|''')?[ \t]*"
#: The public conventions by which generators mark their output, in a comment of its own at the head.
_MARKER = re.compile(
    r"(?im)^[ \t]*(?://+!?|#+|/\*+!?|\*+|<!--|--|;+|\"\"\"|\'\'\')[ \t]*(?:"
    r"code generated by\b|(?:auto-?matically |auto-?|machine[- ])generated\b|auto-?generated\b|@generated\b|<auto-generated>"
    r"|generated by (?:the )?\S+(?: \S+)? (?:compiler|generator|tool|codegen)\b|generated by \S+[^\n]*do not (?:edit|modify)|generated (?:from|file)\b"
    r"|this (?:file|code|is) (?:was |is |has been )?(?:auto-?matically |auto-?)?generated\b|do not (?:edit|modify) this file\b"
    r")"
)
_LEAD = r"^[ \t]*(?://+!?|#+|/?\*+!?|--|;+)[ \t]*"
#: How published files name their project, or a copy its origin, in a comment at the head.
_HOLDER = re.compile(
    rf"(?im){_LEAD}(?:copyright (?:\(c\) )?\d{{4}}(?:-\d{{4}})? (?:the )?([\w.-]+) authors\b|\(c\) (?:\d{{4}} )?(?:the )?([\w.-]+) contributors\b"
    rf"|this file is part of (?:the )?([\w.-]+?)[,. ]|(?:copied|imported|vendored|taken|adapted)(?: unchanged| verbatim)? from (?:the )?([\w.-]+) v?\d"
    rf"|([\w.-]+) v?\d+(?:\.\d+)+ [-|(–] ?(?:https?://|MIT|BSD|Apache|ISC|MPL)|released under the [\w. -]+ license, \(c\) (?:\d{{4}} )?(?:the )?([\w.-]+)|([\w.-]+) is free software\b)"
)
#: Names that tools and package managers are known to give to what they write or fetch, as attribute lines.
DEFAULT_ATTRIBUTES = """
*_pb2.py linguist-generated
*_pb2.pyi linguist-generated
*_pb2_grpc.py linguist-generated
*.pb.go linguist-generated
*.pb.cc linguist-generated
*.pb.h linguist-generated
*.pb.rs linguist-generated
*_pb.js linguist-generated
*_pb.ts linguist-generated
*.min.js linguist-generated
*.min.mjs linguist-generated
*.min.css linguist-generated
*.generated.* linguist-generated
*.gen.* linguist-generated
*.g.dart linguist-generated
*.g.cs linguist-generated
*_generated.go linguist-generated
*_gen.go linguist-generated
zz_generated[_.]* linguist-generated
**/__generated__/** linguist-generated
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/site-packages/** linguist-vendored
**/Godeps/_workspace/** linguist-vendored
**/vendor/*.*/** linguist-vendored
"""
_NOT_CODE = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|^[ \t]*[A-Za-z0-9+/=]{40,}[ \t]*\r?$|[-+]?\b\d[\w.]*|[\s,:;{}\[\]()+=]|\b(?:null|true|false|None|True|False|export|const|var|let|pub|static)\b", re.M)


def dense(text: str) -> bool:
    """Minified: long lines with hardly a blank between the tokens."""
    if len(text) < 200 or len(text) < 110 * (text.count("\n") + 1):
        return False
    return sum(map(text.count, " \t\n\r")) < 0.085 * len(text) and sum(map(text.count, "(){};")) > 0.05 * len(text)


def bulk(text: str) -> bool:
    """Literals with hardly any code."""
    return len(text) > 400 and text.count("(") * 300 < len(text) and len(_NOT_CODE.sub("", text)) < 0.08 * len(text)


def marked(text: str) -> bool:
    return bool(_MARKER.search(text))


#: The head of a file: blank lines and comments before anything else.
_HEAD = re.compile(r"(?:[ \t]*(?:(?://|#|\*|--|;|<!--)[^\n]*|/\*(?:[^*]|\*(?!/))*\*/[^\n]*|(?:\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"))?[ \t\r]*(?:\n|\Z))*+")


def foreign(text: str, project: str | None) -> bool:
    """A notice in the head of the file that names another project as its origin."""
    head = _HEAD.match(text).end()
    return bool(project) and any(next(filter(None, m.groups())).lower() != project.lower() for m in _HOLDER.finditer(text, 0, head))


#: A line that is all comment, its mark taken off.
_COMMENT_LINE = re.compile(r"^[ \t]*(?://+!?|#+!?|/?\*+!?|<!--|--|;+|\"\"\"|\'\'\')[ \t]*([^\n]*)", re.M)
_LINE_WORD = re.compile(r"[@<]?\w+")
_NUMBER = re.compile(r"\d+")


def line_patterns(text: str, project: str | None) -> tuple[list[str], list[int]]:
    """The first two and three words of each comment line at the head, and the hash of the first three of each further one.

    In small letters, numbers made 0 and the project's own name ``own_``.  Patterns are mined at the head, where a file
    says what it is, and hold wherever they stand.
    """
    top: dict[str, None] = {}
    below: dict[str, None] = {}
    own = project.lower() if project else None
    head = _HEAD.match(text).end()
    for m in _COMMENT_LINE.finditer(text):
        line = m[1].lower()
        words = _LINE_WORD.findall(line.replace(own, "own_") if own else line)[:3]
        if len(words) > 1:
            words = [_NUMBER.sub("0", w) for w in words]
            if m.start() < head:
                top["line:" + " ".join(words[:2])] = top["line:" + " ".join(words)] = None
            elif len(words) == 3:
                below["line:" + " ".join(words)] = None
    return list(top), [xxhash.xxh64_intdigest(x, 42) - ((1 << 64) if xxhash.xxh64_intdigest(x, 42) >> 63 else 0) for x in below if x not in top]


_TOKEN = re.compile(r"\w+|[^\w\s]")
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class Shingler:
    """``shingles(text)``: the distinct 64-bit hashes of the text's runs of ``WORDS`` words and marks; a shorter text is one run.

    White space counts for nothing, so neither do indentation and line ends.  The hashes of words are remembered.
    """

    def __init__(self, most: int = 500_000):
        self.most, self.place, self.hashes = most, {}, np.empty(1024, dtype=np.uint64)

    def _learn(self, words: list[str]) -> None:
        new = set(words).difference(self.place)
        if not new:
            return
        n = len(self.place)
        if n + len(new) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty(n + len(new), dtype=np.uint64)])
        self.hashes[n : n + len(new)] = np.fromiter(map(xxhash.xxh64_intdigest, new), dtype=np.uint64, count=len(new))
        self.place.update(zip(new, range(n, n + len(new))))

    def shingles(self, text: str) -> np.ndarray:
        words = _TOKEN.findall(text)
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.place) > self.most:
            self.place.clear()
        self._learn(words)
        h = self.hashes[np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))]
        n = max(1, len(h) - WORDS + 1)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(min(WORDS, len(h))):
            part = h[i : i + n] * _MIX[i]
            out += part ^ (part >> np.uint64(29))
        return np.unique(out)


# copies ------------------------------------------------------------------------------------------------------------


def published(upstream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, shingles): per published file (k, home, m), its number of shingles, and one row (k, m, h, df) per shingle,
    with the number of files that hold it.  Equal files of one home count once; they are written once."""

    def make():
        shingler = Shingler()

        def row(home, text):
            s = shingler.shingles(text)
            if len(s):
                yield xxhash.xxh64_intdigest(s.tobytes() + (home or "").encode()) - (1 << 63), home, len(s), s.view(np.int64).tolist()

        return row

    kept = map_rows(upstream.where(F.length("content") > 0), ["home_project", "content"], "k bigint, home string, m int, hs array<bigint>", make)
    kept = shared_checkpoint(upstream.sparkSession, kept.dropDuplicates(["k"]))
    each = kept.select("k", "m", F.explode("hs").alias("h"))
    return kept.drop("hs"), each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h")


class Filter:
    """Passes over the shingles of texts that cannot hold enough of any published file.

    Published files are put in bands by size (powers of the root of two); each band has the size of its shortest file and
    ``FILTER_BITS`` bits, set at its files' shingles.  A text is near if in some band as many of its shingles are set as
    a copy of the shortest file there would have, so no copy is lost.
    """

    def __init__(self, shingled: DataFrame):
        band = F.floor(2 * F.log2(F.col("m"))).cast("int").alias("band")
        rows = shingled.groupBy(band, F.shiftright(F.pmod("h", F.lit(FILTER_BITS)), 6).alias("w"))
        rows = rows.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) & 63 as int))")).alias("b"), F.min("m").alias("m")).toPandas()
        self.bands: list[tuple[int, np.ndarray]] = []
        for _, part in rows.groupby("band"):
            bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
            bits[part["w"].to_numpy(dtype=np.int64)] = part["b"].to_numpy(dtype=np.int64)
            self.bands.append((int(part["m"].min()), bits.view(np.uint64)))

    def near(self, s: np.ndarray) -> np.ndarray:
        """The shingles that may be those of a published file of which ``s`` may be a copy."""
        at = s & np.uint64(FILTER_BITS - 1)
        word, bit = at >> np.uint64(6), at & np.uint64(63)
        keep = np.zeros(len(s), dtype=bool)
        for m, bits in self.bands:
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            if np.count_nonzero(hit) >= COPY * min(len(s), m):
                keep |= hit
        return s[keep]


def enough(both: Column, n: Column, m: Column) -> Column:
    """Whether a text of ``n`` shingles and a published one of ``m`` that share ``both`` are copies."""
    return F.when(F.least(n, m) < WHOLE, (both == n) & (n == m)).otherwise(both >= COPY * F.least(n, m))


def copies(met: DataFrame, sets: DataFrame, shingled: DataFrame) -> DataFrame:
    """file_id of the copies, from (file_id, project, n, hits) with the shingles that passed the filter.

    One exact plan for any number of published files.  Two texts with four fifths of the smaller one in common share
    three tenths of it within its rarer half, so pairs are formed there only, never on a licence that all files carry,
    and counted in full afterwards.  The rows of a shingle that many files hold are split in ``SALT`` parts.
    """
    parts = F.explode(F.array(*(F.lit(i) for i in range(SALT))))
    salt = F.pmod(F.xxhash64("file_id"), F.lit(SALT)).cast("int")

    def met_by(rows: DataFrame, other: DataFrame) -> DataFrame:
        return rows.withColumn("salt", salt).join(other.withColumn("salt", parts), ["h", "salt"]).drop("salt")

    known = shingled.groupBy("h").agg(F.first("df").alias("df"))
    own = met_by(met.select("file_id", "project", "n", F.explode("hits").alias("h")), known)
    held = own.groupBy("file_id").agg(F.max("n").alias("n"), F.first("project").alias("project"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("all"))
    held = shared_checkpoint(met.sparkSession, held)
    # the rarer half of a published file, and of a text, of whose shingles those that nobody published come first
    theirs = shingled.groupBy("k").agg(F.max("m").alias("m"), F.expr("slice(array_sort(collect_list(struct(df, h))), 1, cast(floor(max(m) / 2) as int) + 1).h").alias("rare"))
    theirs = theirs.select("k", "m", F.explode("rare").alias("h"))
    every = held.select("file_id", "n", F.explode("all.h").alias("h"))
    rare = F.expr("slice(all, 1, greatest(cast(floor(n / 2) as int) + 1 - (n - size(all)), 0)).h")
    small = held.where(F.col("n") >= WHOLE).select("file_id", "n", F.explode(rare).alias("h"))

    def shared_in_half(rows: DataFrame, size: str) -> DataFrame:
        s = F.first(size)
        need = F.when(s < WHOLE, F.floor(s / 2) + 1).otherwise(F.ceil(COPY * s) - (s - F.floor(s / 2) - 1))
        return rows.groupBy("file_id", "k").agg(F.count("*").alias("c"), need.alias("need")).where("c >= need").select("file_id", "k")

    pairs = shared_in_half(met_by(every, theirs).where("m <= n"), "m").unionByName(shared_in_half(met_by(small, shingled.select("k", "m", "h")).where("n < m"), "n"))
    full = pairs.join(held.select("file_id", "project", "n", F.col("all.h").alias("hs")), "file_id")
    wide = shingled.groupBy("k").agg(F.max("m").alias("m"), F.collect_list("h").alias("theirs")).join(sets.select("k", "home"), "k")
    both = full.join(wide, "k").withColumn("both", F.size(F.array_intersect("hs", "theirs")))
    return both.where(enough(F.col("both"), F.col("n"), F.col("m")) & ~F.col("home").eqNullSafe(F.col("project"))).select("file_id").distinct()


# attribute files -------------------------------------------------------------------------------------------------

_ATTRIBUTE = re.compile(r"(?P<sign>[-!]?)linguist-(?P<name>generated|vendored)(?:=(?P<value>\S+))?$")
_RULES = "project string, dir string, line_no int, attribute string, value boolean, pattern string"


def glob_regex(glob: str) -> str:
    """A path pattern of an attribute or ignore file, as a regular expression on the path below the file's directory."""
    body, i = "", 0
    anchored = "/" in glob.rstrip("/")[:-1] or glob.startswith("/")
    g = glob.strip("/")
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            body, i = body + ".*", i + 2
        elif c == "*":
            body, i = body + "[^/]*", i + 1
        elif c == "?":
            body, i = body + "[^/]", i + 1
        elif c == "[" and "]" in g[i + 2 :]:
            j = g.index("]", i + 2)
            inner = g[i + 1 : j]
            body, i = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", j + 1
        else:
            body, i = body + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if glob.endswith("/") else "$")


@cache
def by_default() -> str:
    """The default attribute lines as one regular expression on the path."""
    return "|".join(f"(?:{glob_regex(line.split()[0])})" for line in DEFAULT_ATTRIBUTES.strip().split("\n"))


def attribute_rules(files: DataFrame, layout: str | None = None) -> DataFrame:
    """One row per linguist attribute of each line of the ``.gitattributes`` files in ``files``."""

    def make():
        def row(project, rel, content):
            directory = rel.rpartition("/")[0]
            for n, line in enumerate((content or "").split("\n"), 1):
                words = line.strip().split()
                if len(words) < 2 or words[0].startswith("#"):
                    continue
                for w in words[1:]:
                    if m := _ATTRIBUTE.match(w):
                        value = not m["sign"] and (m["value"] or "true").lower() not in ("false", "unset", "0")
                        yield project, directory, n, m["name"], value, glob_regex(words[0])

        return row

    source = files.where(F.col("rel_path").rlike(r"(^|/)\.gitattributes$"))
    return map_rows(source, [project_of(layout).alias("project"), "rel_path", "content"], _RULES, make).distinct()


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, excluded): what the attribute files say, for the files they speak of.

    A file meets the rules of each directory above it; per attribute the deepest directory's last matching line wins.
    """
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = F.expr("if(dir = '', rel_path, substring(rel_path, length(dir) + 2))")
    met = paths.select("file_id", "project", "rel_path", F.explode(above).alias("dir")).join(rules, ["project", "dir"]).where(F.rlike(below, F.col("pattern")))
    said = met.groupBy("file_id", "attribute").agg(F.max_by("value", F.struct(F.length("dir"), "line_no")).alias("value"))
    return said.groupBy("file_id").agg(F.max("value").alias("excluded"))


# patterns --------------------------------------------------------------------------------------------------------


def _candidates(rel: Column) -> Column:
    """Patterns of a path: directories and pairs of them with versions made ``V``, and affixes of the file name."""
    segments = F.transform(F.split(rel, "/"), lambda s: F.regexp_replace(F.regexp_replace(s, r"^v?\d+(\.\d+)+$", "V"), r"-v?\d+(\.\d+)+$", "-V"))
    dirs = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    name = F.element_at(segments, -1)
    single = F.transform(dirs, lambda s: F.concat(F.lit("dir:"), s))
    pairs = F.transform(F.slice(F.arrays_zip(dirs.alias("a"), F.slice(dirs, 2, 1000).alias("b")), 1, F.greatest(F.size(dirs) - 1, F.lit(0))), lambda p: F.concat(F.lit("pair:"), p["a"], F.lit("/"), F.regexp_replace(p["b"], r"^.*-V$", "*-V")))
    over = F.transform(F.slice(F.arrays_zip(dirs.alias("a"), F.slice(dirs, 3, 1000).alias("b")), 1, F.greatest(F.size(dirs) - 2, F.lit(0))), lambda p: F.when(p["b"] == "V", F.concat(F.lit("over:"), p["a"], F.lit("/*/V"))))
    suffixes = F.array(
        F.concat(F.lit("end:"), F.nullif(F.regexp_extract(name, r"(\.[A-Za-z]\w*\.\w+)$", 1), F.lit(""))),
        F.concat(F.lit("end:"), F.nullif(F.regexp_extract(name, r"(_[A-Za-z0-9]+\.\w+)$", 1), F.lit(""))),
        F.concat(F.lit("end:"), F.nullif(F.regexp_extract(name, r"(_[A-Za-z0-9]+_[A-Za-z]+\.\w+)$", 1), F.lit(""))),
        F.concat(F.lit("begin:"), F.nullif(F.regexp_extract(name, r"^([A-Za-z]+_[A-Za-z]+_)\w+\.\w+$", 1), F.lit(""))),
        F.concat(F.lit("affix:"), F.nullif(F.regexp_replace(name, r"^([A-Za-z]+_)\w+(_[A-Za-z]+\.\w+)$", "$1*$2"), name)),
    )
    return F.array_distinct(F.array_compact(F.concat(single, pairs, over, suffixes)))


def _all_candidates() -> Column:
    """Patterns of a file: of its path, of its comment lines, of its shape."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(_candidates(F.col("rel_path")), none), F.coalesce("lines", none), F.when(F.col("minified"), F.array(F.lit("shape:dense"))).otherwise(none))


def mine(paths: DataFrame) -> DataFrame:
    """(pattern, files, evident, projects, except_for) of the patterns that hold, from (file_id, project, rel_path, lines, minified, evident, named).

    A shape is held against the labels that do not rest on it (``named``).  ``except_for`` has the narrower patterns
    in which one does not hold: pairs of directories (``geo/dist`` for ``dist``), lines that go on otherwise.
    """
    each = paths.select("project", "evident", "named", F.explode(_all_candidates()).alias("pattern"))
    each = each.withColumn("evident", F.when(F.col("pattern").startswith("shape:"), F.col("named")).otherwise(F.col("evident")))
    # first per project, so that a project with a third of all files is one row in the second step
    per = each.groupBy("pattern", "project").agg(F.count("*").alias("files"), F.count_if("evident").alias("evident"))
    all_ = per.groupBy("pattern").agg(F.sum("files").alias("files"), F.sum("evident").alias("evident"), F.count_if(F.col("evident") > 0).alias("projects"), F.count("*").alias("everywhere"))
    kept = all_.where((F.col("evident") >= LEAST_FILES) & (F.col("projects") >= LEAST_PROJECTS) & (F.col("evident") >= F.when(F.col("pattern").startswith("line:"), LINE_SHARE).otherwise(LEAST_SHARE) * F.col("files")))
    narrow = F.col("pattern").startswith("pair:") | F.col("pattern").rlike("^line:[^ ]+ [^ ]+ [^ ]+$")
    pairs = all_.where(narrow & (F.col("files") >= EXCEPTION_FILES) & (F.col("everywhere") >= EXCEPTION_PROJECTS))
    share = (F.col("evident") / F.col("files")).alias("pair_share")
    dirs = F.transform(F.split(F.expr("substring(pattern, 6)"), "/"), lambda d: F.concat(F.lit("dir:"), d))
    wider = F.when(F.col("pattern").startswith("pair:"), dirs).otherwise(F.array(F.regexp_replace("pattern", " [^ ]*$", "")))
    ends = pairs.select(F.col("pattern").alias("pair"), share, F.explode(wider).alias("pattern"))
    exceptions = (
        kept.join(ends, "pattern")
        .where(F.col("pair_share") <= EXCEPTION_SHARE * F.col("evident") / F.col("files"))
        .groupBy("pattern")
        .agg(F.collect_set("pair").alias("except_for"))
    )
    return kept.join(exceptions, "pattern", "left").withColumn("except_for", F.coalesce("except_for", F.array().cast("array<string>")))


EVIDENCE = "file_id bigint, project string, rel_path string, generated boolean, minified boolean, data boolean, foreign boolean, convention boolean, lines array<string>, below array<bigint>, n int, hits array<bigint>"


def evidence(files: DataFrame, upstream: DataFrame, layout: str | None = None) -> DataFrame:
    """What the content of each file shows; one row per file_id, written once.  Null content shows nothing, a null path gives no row.

    ``hits`` holds the shingles that may be those of a published file; they leave the task only if they are enough.
    """
    spark = files.sparkSession
    sets, shingled = published(upstream)
    shared = spark.sparkContext.broadcast(Filter(shingled))

    def make():
        passing, shingler = shared.value, Shingler()

        def row(file_id, project, path, rel, text):
            default = bool(rel and re.search(by_default(), rel))
            if text is None:
                yield file_id, project, rel, False, False, False, False, default, [], [], 0, []
                return
            s = shingler.shingles(text) if passing.bands else np.empty(0, dtype=np.uint64)
            code = bool(SOURCE.search(path))
            yield file_id, project, rel, marked(text), code and dense(text), code and bulk(text), foreign(text, project), default, *line_patterns(text, project), len(s), passing.near(s).view(np.int64).tolist()

        return row

    found = map_rows(files.where(F.col("path").isNotNull()), ["file_id", project_of(layout).alias("project"), "path", rel_of(layout).alias("rel_path"), "content"], EVIDENCE, make)
    # re-sent files: the narrow rows meet, the texts do not
    once = found.groupBy("file_id").agg(*(F.max(c).alias(c) for c in ("project", "rel_path", "generated", "minified", "data", "foreign", "convention", "lines", "below", "n", "hits")))
    seen = shared_checkpoint(spark, once)
    copied = shared_checkpoint(spark, copies(seen.where(F.size("hits") > 0).select("file_id", "project", "n", "hits"), sets, shingled).withColumn("copied", F.lit(True)))
    return seen.drop("n", "hits").join(copied, "file_id", "left").fillna(False, ["copied"])


def provenance(files: DataFrame, upstream: DataFrame, layout: str | None = None) -> DataFrame:
    """(file_id, project, rel_path, hand_written, reason): one row per file with a path; content is no part of it.

    ``layout`` is an expression whose group finds the project in a path, for rows without one.  A project with
    attribute files is decided by them and by the content; the other projects first by mined patterns.
    """
    spark = files.sparkSession
    seen = evidence(files, upstream, layout)
    rules = shared_checkpoint(spark, attribute_rules(files, layout))
    said = declared(seen.select("file_id", "project", "rel_path"), rules)
    known = seen.join(said, "file_id", "left")
    named = F.coalesce("excluded", F.col("convention") | F.col("generated") | F.col("foreign") | F.col("copied"))
    known = known.withColumn("named", named).withColumn("evident", F.coalesce("excluded", named | F.col("minified") | F.col("data")))
    # few patterns hold, and they are written once: they are sent to the files, which then need not be shuffled to them
    patterns = shared_checkpoint(spark, mine(known))
    declaring = rules.select("project").distinct().withColumn("declares", F.lit(True))
    candidates = known.select("file_id", _all_candidates().alias("all"))
    each = candidates.select("file_id", F.filter("all", lambda c: c.startswith("pair:") | c.startswith("line:")).alias("pairs"), F.explode("all").alias("pattern"))
    met = each.join(few(patterns), "pattern").where(~F.arrays_overlap("pairs", "except_for")).drop("pairs", "except_for")
    lines = patterns.where(F.col("pattern").startswith("line:")).drop("except_for").withColumn("h", F.xxhash64("pattern"))
    met = met.unionByName(known.select("file_id", F.explode("below").alias("h")).join(few(lines), "h").select(*met.columns))
    by_path = met.groupBy("file_id").agg(F.max_by("pattern", F.struct(F.col("evident") / F.col("files"), "evident", "pattern")).alias("by_pattern"))
    out = known.join(by_path, "file_id", "left").join(declaring, "project", "left")
    reason = F.expr(
        "case when excluded then 'declared' when excluded = false then null when declares is null and by_pattern is not null then concat('pattern ', by_pattern) "
        "when generated then 'generated' when minified then 'minified' when data then 'data' when copied then 'copy' when foreign then 'third_party' when declares is null and convention then 'convention' end"
    )
    return out.select("file_id", "project", "rel_path", reason.isNull().alias("hand_written"), reason.alias("reason"))


def provenance_found(files: DataFrame, upstream: DataFrame, layout: str | None = None) -> DataFrame:
    """Files that are not hand-written; a file without content is no case."""
    found = provenance(files.where(F.col("content").isNotNull()), upstream, layout)
    return found.where(~F.col("hand_written")).select("file_id")
