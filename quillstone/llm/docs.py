"""Problem 5: functions with their documentation.

A state machine that knows strings and comments (one pattern per language) blanks both out of a text, keeping every
offset.  On what is left declarations are found, braces (Python: indentation) delimit the functions, and the comment
that immediately precedes a declaration (Python: the first string of the body) is its documentation.  A description
counts if it says something beyond the words of the name; see ``description``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexers as L
from .common import map_rows, project_of
from .syntax import SOURCE_PATH, has_jsx, language_of, parses

# blanking --------------------------------------------------------------------------------------------------------

_LINE = r"(?P<line>//[^\n]*)"
#: Each pattern steps over what begins nothing in one go and ends at a mark; ``none`` is a mark that begins nothing either.
_STATES = {
    "go": re.compile(rf"[^/\"'`]*+(?:{_LINE}|(?P<block>{L.BLOCK})|(?P<string>{L.STRING_D}|`[^`]*`|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)')|(?P<none>.))", re.S),
    "rust": re.compile(
        rf"(?:[^/\"'br]++|b(?!r?[\"'\#])|r(?![\"\#]))*+(?:{_LINE}|(?P<block>{L._BLOCK3})|(?P<string>(?<!\w)(?:{L._RAW})|b?\"(?:[^\"\\]|\\.)*+\"|b?'(?:[^'\\\n]|\\(?:u\{{[0-9a-fA-F_]+\}}|x[0-9a-fA-F]{{2}}|.))')|(?P<open>/\*|(?<!\w)b?r\#+\")|(?P<none>.))", re.S
    ),
    "javascript": re.compile(rf"[^/\"'`]*+(?:{_LINE}|(?P<block>{L.BLOCK})|(?P<string>{L.STRING_D}|{L.STRING_S}|{L._TEMPLATE})|(?P<open>`)|(?P<none>.))", re.S),
    "python": re.compile(rf"[^\#\"']*+(?:(?P<line>#[^\n]*)|(?P<string>{L._PY_STRING})|(?P<none>.))", re.S),
}
_STATES["typescript"] = _STATES["javascript"]
#: Language -> the end of what its pattern only opens.
_ENDS = {"rust": L.rust_end, "javascript": L.template_end, "typescript": L.template_end}
#: Language -> what begins with a slash where an operand may stand.
_REGEX = dict.fromkeys(("javascript", "typescript"), re.compile(L._RE_LITERAL).match)
_PREFIX = re.compile(L._PY_PREFIX)


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def _states(language: str, text: str):
    """(start, end, kind) of each string, comment and regular expression."""
    at, match = 0, _STATES[language].match
    while m := match(text, at):
        kind = m.lastgroup
        a, end = m.span(kind)
        if kind == "none" and text[a] == "/" and language in _REGEX and _operand(text, at, a) and (r := _REGEX[language](text, a)):
            kind, end = "regex", r.end()
        elif kind == "string" and language == "python" and a > at and _wordy(text[a - 1]):
            begin = _prefixed(text, at, a)
            if begin < 0:
                at = a + 1
                continue
            a = begin
        elif kind == "open":
            if (close := _ENDS[language](text, a)) < 0:
                at = end
                continue
            kind, end = "block" if text.startswith("/*", a) else "string", close
        at = end
        if kind != "none":
            yield a, end, kind


def _operand(text: str, low: int, at: int) -> bool:
    """Whether an operand, and so a regular expression, may begin at ``at``: an operator or such a word stands before it, from ``low`` on."""
    while at > low and text[at - 1].isspace():
        at -= 1
    if at <= low:
        return False
    if text[at - 1] in "=(,:[!&|?{;+-*%~^" or text.endswith("=>", low, at):
        return True
    for word in ("return", "typeof", "case"):
        if text.endswith(word, low, at):
            begin = at - len(word)
            return begin == 0 or not _wordy(text[begin - 1])
    return False


def _prefixed(text: str, low: int, quote: int) -> int:
    """Where the string prefix right before ``quote`` begins, or -1 if a longer word or none stands there."""
    begin = quote
    while begin > low and quote - begin < 3 and _wordy(text[begin - 1]):
        begin -= 1
    return begin if _PREFIX.fullmatch(text, begin, quote) else -1


def _blank(s: str) -> str:
    return " " * len(s) if "\n" not in s else "\n".join(" " * len(x) for x in s.split("\n"))


def blank(language: str, text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with strings and comments as blanks, the spans blanked with their kind: line, block, string, regex)."""
    out, spans, at = [], [], 0
    for a, b, kind in _states(language, text):
        out += [text[at:a], _blank(text[a:b]) if kind not in ("string", "regex") else _filled(text[a:b])]
        spans.append((a, b, kind))
        at = b
    return "".join(out) + text[at:], spans


def _filled(s: str) -> str:
    """A string stays an operand: its blanks keep their place between two quotes."""
    return '"' + _blank(s[1:-1]) + '"' if len(s) > 1 else s


_CLOSES = {")": "(", "]": "[", "}": "{"}
_BRACKET = re.compile(r"[()\[\]{}]")


_SPACE = re.compile(r"\s*")
_WORD = re.compile(r"[\w$]+")
_OPEN = re.compile(r"\s*\{")
_HEADER_END = re.compile(r"[{(;]")
_HEADER_MARK = re.compile(r"[(\[{:]")
_BODY_MARK = re.compile(r"[{;]")
_ANGLE = re.compile(r"[<>]")
_MEMBER_MARK = re.compile(r"[()\[\]{};]")
_FUNCTION_HEAD = re.compile(r"function\s*\*?\s*[\w$]*\s*")


def _before(code: str, at: int) -> int:
    """The end of the code before ``at``, blanks passed over."""
    while at > 0:
        begin = max(0, at - 256)
        if part := code[begin:at].rstrip():
            return begin + len(part)
        at = begin
    return 0


def _lead(code: str, at: int, words: frozenset[str]) -> int:
    """Where the ``words`` right before ``at`` begin."""
    while True:
        end = _before(code, at)
        begin = end
        while begin > 0 and code[begin - 1].isalpha():
            begin -= 1
        if end == at or code[begin:end] not in words or begin > 0 and (code[begin - 1].isalnum() or code[begin - 1] in "_$."):
            return at
        at = begin


def closing(code: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; -1 if none does."""
    depth = 0
    for m in _BRACKET.finditer(code, at):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.end()
    return -1


# declarations: (start, name start, name, body start or -1) ---------------------------------------------------------

_GO_FUNC = re.compile(r"^func\b[ \t]*(?P<receiver>\()?", re.M)
_GO_NAME = re.compile(r"[ \t]*(?P<name>[^\W\d]\w*)[ \t]*(?=[\[(])")
_RUST_FN = re.compile(r"fn\s+(?:r#)?(?P<name>[^\W\d]\w*)\s*(?=[<(])")
_RUST_LEADS = frozenset(("pub", "default", "const", "async", "unsafe", "extern"))
_PY_DEF = re.compile(r"def[ \t]+(?P<name>[^\W\d]\w*)")
_PY_LEAD = re.compile(r"[ \t]*(?:async[ \t]+)?")
_JS_FUNCTION = re.compile(r"function\b\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?=[<(])")
_JS_LEADS = frozenset(("export", "default", "declare", "async"))
_JS_CONST = re.compile(r"const\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::(?:[^=;{}]|=>)*?)?=(?!=)\s*(?P<value>async\b\s*(?=function\b|\(|<|[A-Za-z_$])|(?=function\b|\(|<|[A-Za-z_$]))")
_JS_ARROW_AFTER = re.compile(r"\s*(?::[^=;{}]*?(?:\{[^{}]*\}[^=;{}]*)?)?=>")
_JS_CLASS = re.compile(r"class\b(?<![\w$.]class)(?=[\s{])")
_JS_DECORATOR = re.compile(r"@[\w$.]+")
_JS_METHOD = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|async|override|abstract|declare|readonly|get|set)\s+(?=[\w$#*\[]))*)\*?\s*#?(?P<name>[A-Za-z_$][\w$]*)\s*\??\s*(?=[<(])")


def _angle(code: str, at: int) -> int:
    """The place after the ``<...>`` at ``at``."""
    depth = 0
    for m in _ANGLE.finditer(code, at):
        depth += 1 if m[0] == "<" else (0 if code[m.start() - 1] in "=-" else -1)
        if depth == 0:
            return m.end()
    return -1


def _after_params(code: str, at: int) -> int:
    """The place after type parameters and the parameter list that begin at ``at``; -1 if there is no list."""
    if at >= 0 and code[at : at + 1] == "<":
        at = _angle(code, at)
        at = _SPACE.match(code, at).end() if at >= 0 else -1
    elif at >= 0 and code[at : at + 1] == "[":
        at = closing(code, at)
    return closing(code, at) if at >= 0 and code[at : at + 1] == "(" else -1


def _body(code: str, at: int) -> int:
    """The ``{`` of the body whose header has its parameters before ``at``; -1 for a declaration without one."""
    while at >= 0:
        m = _BODY_MARK.search(code, at)
        if not m or m[0] == ";":
            return -1
        before = code[at : m.start()].rstrip()
        # an object type in the result is no body
        if before.endswith((":", "|", "&", "<", ",", "interface", "struct")):
            at = closing(code, m.start())
            continue
        return m.start()
    return -1


def _go(code):
    for f in _GO_FUNC.finditer(code):
        at = closing(code, f.start("receiver")) if f["receiver"] else f.end()
        if at >= 0 and (m := _GO_NAME.match(code, at)):
            yield f.start(), m.start("name"), m["name"], _body(code, _after_params(code, m.end()))


def _rust(code):
    for m in _RUST_FN.finditer(code):
        if m.start() > 0 and (_wordy(code[m.start() - 1]) or code[m.start() - 1] == "."):
            continue
        yield _rust_start(code, m.start()), m.start("name"), m["name"], _body(code, _after_params(code, m.end()))


def _rust_start(code: str, at: int) -> int:
    """Where the visibility and qualifiers before the ``fn`` at ``at`` begin."""
    while True:
        end = stop = _before(code, at)
        if end in (0, at):
            return at
        last, words = code[end - 1], _RUST_LEADS
        if last == ")":
            begin = code.rfind("(", 0, end)
            if begin < 0 or code.find(")", begin) < end - 1:
                return at
            stop, words = _before(code, begin), ("pub",)
        elif last == '"':
            begin = code.rfind('"', 0, end - 1)
            if begin < 0:
                return at
            stop, words = _before(code, begin), ("extern",)
        begin = stop
        while begin > 0 and _wordy(code[begin - 1]):
            begin -= 1
        if code[begin:stop] not in words or begin > 0 and code[begin - 1] == ".":
            return at
        at = begin


def _class_members(code):
    """(begin, ``{``) of the header before each block that stands directly in a class body."""
    for m in _JS_CLASS.finditer(code):
        at = m.end()
        while at >= 0:
            n = _HEADER_END.search(code, at)
            if not n or n[0] == ";":
                at = -1
            elif n[0] == "(":
                at = closing(code, n.start())
            else:
                break
        if at < 0:
            continue
        depth, begin = 0, n.start() + 1
        for x in _MEMBER_MARK.finditer(code, n.start()):
            c = x[0]
            if c == ";":
                if depth == 1:
                    begin = x.end()
            elif c in "([{":
                if c == "{" and depth == 1:
                    yield begin, x.start()
                depth += 1
            else:
                depth -= 1
                if depth == 1 and c == "}":
                    begin = x.end()
                if depth == 0:
                    break


def _joined(code: str, at: int) -> bool:
    """Whether what begins at ``at`` is the end of a longer name, or a member."""
    return at > 0 and (code[at - 1].isalnum() or code[at - 1] in "_$.")


def _script(code):
    for m in _JS_FUNCTION.finditer(code):
        if _joined(code, m.start()):
            continue
        start = _lead(code, m.start(), _JS_LEADS)
        end = _before(code, start)
        before = code[end - 1 : end] if not code.startswith("export", start) else ""
        if before in ("", ";", "{", "}", ")", '"') or "\n" in code[end:start] and before not in tuple("=(,:?&|[+"):
            yield start, m.start("name"), m["name"], _body(code, _after_params(code, m.end()))
    depth = at = 0
    for m in _JS_CONST.finditer(code):
        if _joined(code, m.start()):
            continue
        start = _lead(code, m.start(), frozenset(("export",)))
        depth += code.count("{", at, m.start()) - code.count("}", at, m.start())
        at = m.start()
        if depth > 0:
            continue
        p = m.end()
        if code.startswith("function", p):
            head = _FUNCTION_HEAD.match(code, p).end()
            yield start, m.start("name"), m["name"], _body(code, _after_params(code, head))
            continue
        end = _after_params(code, p) if code[p : p + 1] in "(<" else _WORD.match(code, p).end()
        arrow = _JS_ARROW_AFTER.match(code, end) if end >= 0 else None
        if arrow:
            rest = _OPEN.match(code, arrow.end())
            yield start, m.start("name"), m["name"], rest.end() - 1 if rest else -1
    for a, b in _class_members(code):
        # the member may follow fields that no semicolon ends: it begins on one of the lines of the header
        for start in _line_starts(code, a, b):
            m = _JS_METHOD.match(code, _after_decorators(code, start), b)
            if not m or m["name"] in ("if", "for", "while", "switch", "catch", "function", "return", "class", "new"):
                continue
            end = _after_params(code, m.end())
            # the block right after the parameters and a type is the body, an initialiser's block is none
            if 0 <= end <= b and "=" not in code[end:b].replace("=>", "") and not _FIELD_AFTER.search(code, end, b):
                yield start, m.start("name"), m["name"], b
                break


_LINE_MARK = re.compile(r"[()\[\]{}]|\n\s*(?=[^\s)\]}])")
#: A line after the parameters that begins a member of its own.
_FIELD_AFTER = re.compile(r"[^\s:|&,<(=]\s*\n\s*[\w$#@]")


def _line_starts(code: str, a: int, b: int):
    """The first character of the header between ``a`` and ``b``, and of each of its lines outside brackets."""
    yield _SPACE.match(code, a, b).end()
    depth = 0
    for m in _LINE_MARK.finditer(code, a, b):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
        elif depth == 0:
            yield m.end()


def _after_decorators(code: str, at: int) -> int:
    while m := _JS_DECORATOR.match(code, at):
        at = m.end()
        if code[at : at + 1] == "(":
            end = closing(code, at)
            at = end if end >= 0 else at
        at = _SPACE.match(code, at).end()
    return at


def _python(code):
    for m in _PY_DEF.finditer(code):
        line, at = code.rfind("\n", 0, m.start()) + 1, m.end()
        if not _PY_LEAD.fullmatch(code, line, m.start()):
            continue
        while at >= 0:
            n = _HEADER_MARK.search(code, at)
            if not n:
                at = -1
            elif n[0] == ":":
                yield line, m.start("name"), m["name"], n.end()
                break
            else:
                at = closing(code, n.start())


_FIND = {"go": _go, "rust": _rust, "python": _python, "javascript": _script, "typescript": _script}


# documentation ---------------------------------------------------------------------------------------------------

_PLAIN_STRING = re.compile(r"(?i)(r|u)?(\"\"\"|'''|\"|')(.*)\2$", re.S)
_DIRECTIVE = re.compile(r"^//(?:go:|nolint|lint:|line |export |\+build)")
_DOC_ATTR = re.compile(r'#\[doc\s*=\s*(?:r#*)?"((?:[^"\\]|\\.)*)"#*\s*\]', re.S)


def _python_doc(text, code, spans, starts, body):
    """The docstring's text: the string that opens the body, if it is a plain one."""
    at = _SPACE.match(code, body).end()
    k = bisect_left(starts, at)
    if k < len(spans) and spans[k][0] == at and spans[k][2] == "string":
        m = _PLAIN_STRING.match(text[at : spans[k][1]])
        return m[3] if m else None
    return None


def _leading(text, code, at, rust):
    """(end of the code before ``at``, attributes that stand between): decorators and attributes are stepped over."""
    attributes = []
    while True:
        end = _before(code, at)
        last = code[end - 1 : end]
        if last and last == ("]" if rust else ")"):
            p = _opening(code, end - 1)
        else:
            p = end
        if rust:
            if p < end and p > 0 and code[p - 1] == "#":
                attributes.append((p - 1, text[p - 1 : end]))
                at = p - 1
                continue
        elif p >= 0:
            q = p
            while q > 0 and (code[q - 1].isalnum() or code[q - 1] in "_$."):
                q -= 1
            if 0 < q < p and code[q - 1] == "@":
                at = q - 1
                continue
        return end, attributes


def _opening(code: str, at: int) -> int:
    """The place of the bracket that the one at ``at`` closes; -1 if there is none."""
    depth = 0
    while at >= 0:
        c = code[at]
        depth += (c in ")]}") - (c in "([{")
        if depth == 0:
            return at
        at -= 1
    return -1


def documentation(language: str, text: str, code: str, spans, starts, start: int, body: int, name: int) -> str | None:
    """The raw documentation of the declaration at ``start`` with its name at ``name``, comment marks taken off; None if it has none."""
    if language == "python":
        return _python_doc(text, code, spans, starts, body) if body >= 0 else None
    if language == "go":
        # comment lines right above, without a blank line between
        out, line = [], text.rfind("\n", 0, start) + 1
        while line > 0:
            above = text.rfind("\n", 0, line - 1) + 1
            s = text[above : line - 1].strip()
            k = bisect_right(starts, line - 2) - 1
            if s.endswith("*/") and k >= 0 and spans[k][2] == "block" and spans[k][1] >= line - 1 - (len(text[above : line - 1]) - len(text[above : line - 1].rstrip())):
                out.append(_inside(text[spans[k][0] : spans[k][1]]))
                break
            if not s.startswith("//") or k < 0 or spans[k][2] != "line":
                break
            if not _DIRECTIVE.match(s):
                out.append(s[2:].strip())
            line = above
        return "\n".join(reversed(out)) if out else None
    first, attributes = _leading(text, code, start, rust=language == "rust")
    k = bisect_left(starts, first)
    comments = []
    # a comment may also stand between decorators and the name
    while k < len(spans) and spans[k][0] < (start if language == "rust" else name):
        if spans[k][2] in ("line", "block"):
            comments.append((spans[k][0], text[spans[k][0] : spans[k][1]]))
        k += 1
    if language == "rust":
        docs = [(p, c[3:].strip()) for p, c in comments if c.startswith("///") and not c.startswith("////")]
        docs += [(p, _inside(c)) for p, c in comments if c.startswith("/**") and not c.startswith(("/***", "/**/"))]
        docs += [(p, m[1]) for p, a in attributes for m in [_DOC_ATTR.match(a)] if m]
        return "\n".join(d for _, d in sorted(docs)) if docs else None
    blocks = [c for _, c in comments if c.startswith("/**") and not c.startswith("/**/")]
    return _inside(blocks[-1]) if blocks else None


def _inside(block: str) -> str:
    return "\n".join(re.sub(r"^[ \t]*\*?[ \t]?", "", x).rstrip() for x in re.sub(r"^/\*+!?|\*+/$", "", block).split("\n")).strip()


#: What stands where a description is missing, and what only points elsewhere.
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:(?:todo|fixme|xxx|tbd|tba|wip|hack|n/?a|none|null|docs?|description|documentation|comment|missing|empty|placeholder|fill (?:me |this )?in|\?+|\.+|-+|_+)\b\W*(?:\([^)]*\))?\W*(?:doc(?:s|ument(?:ation|ed|\w* this)?)?|description|later|soon|here|me|this|it|write|add|needed|required|missing)?\W*"
    r"|(?:todo|fixme|xxx)\b[^\n]*|(?:documentation|description|docs?|details?) (?:to follow|pending|missing|needed|tbd|todo|goes here|coming soon|will follow|follows?)\W*|\(?no (?:description|documentation|docs?|comment)(?: yet| available| provided)?\)?\W*"
    r"|(?:undocumented|not documented|no docs)(?: yet| for now| so far)?\W*(?:sorry)?\W*|lorem ipsum[^\n]*|auto-?generated (?:stub|method stub|doc\w*)\W*|add (?:a )?(?:description|documentation|docs?)[^\n]*)$"
)
_POINTER = re.compile(
    r"(?i)^\W*(?:(?:see|cf\.?|refer to|look at|consult|as (?:in|per)|documented (?:in|at|on)|described (?:in|at)|same as|like|ditto|as|for (?:details|more|documentation),? see) (?:also )?(?:the |its |our |https?://)?[^\n.;:]{0,60}(?:\.(?!\s*\w{3,})[\w/#-]*)*(?: for (?:more |further )?(?:details|information|info|documentation))?|(?:same|as) (?:as )?(?:above|below|before)|ditto|(?:\{?@inheritdoc\}?|@inherit(?:s|ed)?|inherited|\(inherited\))[^\n]{0,40}|@see\b[^\n]*|@link\b[^\n]*|siehe (?:oben|unten|\w+)|voir (?:ci-dessus|\w+))\W*$"
)
_TAG = re.compile(r"^\s*(?:@\w+\b|:(?:param|type|returns?|rtype|raises?|arg|var|ivar|keyword|yields?)\b[^:]*:|\\(?:param|return)\b)")
_SECTION = re.compile(r"(?i)^\s*(?:#+\s*)?(?:args?|arguments|parameters|params|returns?|yields?|raises?|throws|attributes|keyword args|examples?|usage|panics|errors|safety|see also|notes?|references|todo)\s*:{0,2}\s*$")
#: Code that was commented out describes nothing.
_CODE_LINE = re.compile(r"^(?:(?:func|fn|def|function|class|const|let|var|pub|async|export|import|return|if|for|while|switch|case)\b[^.]*[({;=]|[})\];]+;?$|[\w.]+\([^)]*\);?$|[\w.]+ :?= [^ ]+;?$)")
_CODE_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_FILLER = set(
    "a an the this that these those it its of to for from in on at by with and or as is are be do does function func method fn procedure routine helper def class constructor getter setter "
    "given which will can may just simply new our your my".split()
)


_AFTER_NAME = re.compile(r"\s*(?:\(\))?\s*(?::|-|–|—|is|are)?\s*")
_WORDY = re.compile(r"\w")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[_\W]+")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _HUMP.split(text) if w]


@lru_cache(maxsize=50_000)
def _stem(w: str) -> str:
    """A word without its ending: applies, applied, applying and apply are one."""
    for suffix, rest in (("izes", "ize"), ("ises", "ise"), ("ies", "y"), ("ied", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(suffix) and len(w) - len(suffix) >= 3:
            w = w[: -len(suffix)] + rest
            break
    if w.endswith("e") and len(w) > 3:
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def description(name: str, doc: str | None) -> str | None:
    """The part of a documentation that describes, or None.

    Tags, parameter sections, examples and code are no description; nor are placeholders, pointers elsewhere, and
    sentences that hold nothing but the words of the name (in any form) and words that carry no meaning.
    """
    if not doc or not doc.strip():
        return None
    kept, section = [], False
    for line in _CODE_FENCE.sub("", doc.replace("\r", "")).split("\n"):
        if _TAG.match(line):
            section = True
            if m := re.match(r"\s*@(?:desc|description|summary|brief|remarks|details)\s+(.*)", line):
                kept.append(m[1])
                section = False
            continue
        if _SECTION.match(line):
            section = True
            continue
        if section and (not line.strip() or line[:1] in " \t"):
            continue
        if section and not kept and not line.strip():
            continue
        section = section and bool(line.strip()) and line[:1] in " \t"
        kept.append(line.strip())
    text = re.sub(r"\n{2,}", "\n\n", "\n".join(kept)).strip()
    if not text or not re.search(r"\w", text):
        return None
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    own = {_stem(w) for w in _words(name)}
    if name in ("__init__", "constructor"):
        own |= {_stem(w) for w in ("init", "initialize", "construct", "build", "create", "make", "instance", "object", "new")}
    for s in sentences:
        bare = s[_AFTER_NAME.match(s, len(name)).end() :] if s.startswith(name) else s
        if not _WORDY.search(bare) or _CODE_LINE.match(s) or _PLACEHOLDER.match(bare.strip()) or _PLACEHOLDER.match(s) or _POINTER.match(bare.strip()) or _POINTER.match(s):
            continue
        if [w for w in _words(bare) if _stem(w) not in own and w not in _FILLER and w != "init"]:
            return text
    return None


# operator ----------------------------------------------------------------------------------------------------------


def functions(language: str, text: str) -> list[tuple[int, int, str, str | None, int, int]]:
    """(start, name start, name, raw documentation, body start, end) of each function of a text, in order."""
    code, spans = blank(language, text)
    starts = [a for a, _, _ in spans]
    out = []
    for start, at, name, body in _FIND[language](code):
        doc = documentation(language, text, code, spans, starts, start, body, at)
        out.append((start, at, name, doc, body, _end(language, code, start, body)))
    return sorted(out)


def _end(language: str, code: str, start: int, body: int) -> int:
    if body < 0:
        stop = code.find("\n", start)
        return len(code) if stop < 0 else stop
    if language != "python":
        end = closing(code, body)
        return end if end >= 0 else len(code)
    line = code.rfind("\n", 0, start) + 1
    m = _dedent(_PAD.match(code, start).end() - line).search(code, body)
    return m.start() if m else len(code)


_PAD = re.compile(r"[ \t]*")


@lru_cache(maxsize=1_000)
def _dedent(indent: int) -> re.Pattern:
    """The line end before a line that is not blank and stands ``indent`` blanks from the left or less."""
    return re.compile(rf"\n[ \t]{{0,{indent}}}+(?![ \t])(?=[^\S\n]*+\S)")


PAIRS = "file_id bigint, project string, language string, line_no int, symbol string, signature string, description string, code string"


def _make():
    def row(file_id, path, project, text):
        language = language_of(path)
        if language is None or not text:
            return
        found = [(*f, told) for f in functions(language, text) if (told := description(f[2], f[3])) is not None]
        # most costly, so last: a file without descriptions need not be parsed
        if not found or not parses(language, text, not path.endswith(".cjs"), has_jsx(path)):
            return
        line, at = 1, 0
        for start, name_at, name, _, body, end, told in found:
            line += text.count("\n", at, name_at) if name_at >= at else -text.count("\n", name_at, at)
            at = name_at
            signature = " ".join(text[start : body if body > start else end].split())
            yield file_id, project, language, line, name, signature, told, text[start:end]

    return row


def pairs(files: DataFrame, layout: str | None = None) -> DataFrame:
    """One row per documented function of each delivered row of ``files`` (file_id, project_id, path, content).

    Null content or path, other extensions and files that do not parse give no row; repeated rows give repeated rows;
    further columns are ignored.
    """
    source = files.where(F.col("path").rlike(SOURCE_PATH) & (F.length("content") > 0))
    return map_rows(source, ["file_id", "path", project_of(layout).alias("project"), "content"], PAIRS, _make)


def pairs_found(files: DataFrame) -> DataFrame:
    return pairs(files).select("file_id", "line_no", "symbol").distinct()


def pairs_once(files: DataFrame, layout: str | None = None) -> DataFrame:
    """The pairs with re-sent files counted once."""
    return pairs(files, layout).dropDuplicates(["file_id", "line_no", "symbol"])
