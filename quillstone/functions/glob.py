"""Path globs (``*``, ``?``, ``[a-z]``, ``{a,b}``, ``**``) as regular expressions for ``rlike``."""

from __future__ import annotations

import re


class GlobError(ValueError):
    """A pattern that is not well-formed."""


def glob_regex(pattern: str) -> str:
    """An anchored expression of the paths that ``pattern`` matches; ``*`` and ``?`` do not cross a slash."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i) and i + 2 == len(pattern) and (i == 0 or pattern[i - 1] == "/"):
            # "a/**" also matches "a" itself
            if out and out[-1] == "/":
                out[-1] = "(?:/.*)?"
            else:
                out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise GlobError(f"no closing bracket in {pattern!r}")
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
            i += 1
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c) if c != "/" else "/")
            i += 1
    if depth:
        raise GlobError(f"no closing brace in {pattern!r}")
    return "^" + "".join(out) + "$"


def rule_regex(pattern: str) -> str:
    """An expression of the paths that a rule's pattern selects: a pattern without wildcards also takes what lies below it.

    A pattern that is not well-formed selects nothing.
    """
    try:
        whole = glob_regex(pattern)
    except GlobError:
        return "(?!)"
    if any(c in pattern for c in "*/?"):
        return whole
    return f"(?:{whole})|(?:^{re.escape(pattern)}/)"
