"""Text expressions: everything here is a Column of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".md": "markdown",
}

#: White space of the search pattern language, which unlike Java's ``\s`` has no vertical tab.
SPACE = "[\\t\\n\\f\\r ]"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the last element, in small letters; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """Language by extension; '' for any other."""
    by_ext = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(by_ext[extension(path)], F.lit(""))


def lines(text: Column) -> Column:
    """Lines split at "\\n"; a carriage return stays, a final line end gives a last empty line."""
    return F.split(text, "\n")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def trimmed(text: Column) -> Column:
    """Without white space at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, 1-based and inclusive: a start below 1 is 1, an end below 1 or past the text is the last line.

    A start past the end gives null.
    """
    all_ = lines(text)
    first = F.greatest(start, F.lit(1))
    last = F.when((end <= 0) | (end > F.size(all_)), F.size(all_)).otherwise(end)
    return F.when(first <= last, F.array_join(F.slice(all_, first, F.greatest(last - first + 1, F.lit(0))), "\n"))


def preview(text: Column, limit: int = 800) -> Column:
    """The first ``limit`` characters and "..." of a longer text."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def slug(title: Column) -> Column:
    """A file-name part: small letters, digits and hyphens, at most 60 long; "note" if nothing is left.

    Every other character becomes a hyphen of its own; the cut comes after the trim and may leave a hyphen last.
    """
    body = F.regexp_replace(F.lower(trimmed(F.coalesce(title, F.lit("")))), "[^a-z0-9-]", "-")
    cut = F.left(F.regexp_replace(body, "^-+|-+$", ""), F.lit(60))
    return F.when(cut == "", "note").otherwise(cut)


def escaped_headers(text: Column) -> Column:
    return F.replace(text, F.lit("#"), F.lit("\\#"))


def job_prefix(job_id: Column) -> Column:
    """What stands before the last hyphen; the whole id if there is none."""
    prefix = F.regexp_extract(job_id, r"^(.+)-[^-]*$", 1)
    return F.when(prefix == "", job_id).otherwise(prefix)


def note_provider(markdown: Column, default: str = "cascade") -> Column:
    """The provider a note's header names."""
    named = trimmed(F.regexp_extract(markdown, r"(?m)^- \*\*Provider:\*\*[ \t]*([^\r\n]*)", 1))
    return F.when(F.coalesce(named, F.lit("")) == "", default).otherwise(named)


def note_markdown(title: Column, content: Column, tags: Column, provider: Column, saved: Column) -> Column:
    """A note as Markdown: title, provider, tags if any, time, content."""
    tag_line = F.when(F.size(tags) > 0, F.concat(F.lit("- **Tags:** "), F.array_join(tags, ", "), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n- **Provider:** "), F.coalesce(provider, F.lit("")), F.lit("\n"), F.coalesce(tag_line, F.lit("")),
        F.lit("- **Saved:** "), F.date_format(saved, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\n\n"), F.coalesce(content, F.lit("")), F.lit("\n"),
    )


def eta_seconds(status: Column, total: Column, done: Column, elapsed: Column) -> Column:
    """Whole seconds left at the rate so far; 0 unless running with something, but not all, done."""
    open_ = (status == "running") & (done > 0) & (total > 0) & (done < total) & (elapsed > 0)
    return F.when(open_, F.floor((total - done) / (done / elapsed))).otherwise(0).cast("bigint")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * done / total)).otherwise(0).cast("int")


def int_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def equal_fold(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def under(path: Column, root: Column) -> Column:
    """Whether ``path`` is ``root`` or lies below it; '/' and '' are above every non-empty path."""
    return F.when(root.isin("", "/"), path != "").otherwise((path == root) | path.startswith(F.concat(root, F.lit("/"))))
