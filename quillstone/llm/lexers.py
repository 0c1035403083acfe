"""Source text to token kinds: one character per token, for the grammars of ``languages``.

Each language has one pattern that covers every character of a text; ``findall`` does the scanning and a dictionary
that remembers seen tokens does the naming.  What nests without limit (templates, Rust's block comments) or ends in as
many marks as it begins with (Rust's raw strings) is matched in its plain forms by the pattern and counted otherwise.  Comments and blanks get no kind.  Line ends become a virtual semicolon
``VSEMI`` where the language's own rule (Go, ECMAScript) would end a statement, and Python gets NEWLINE/INDENT/DEDENT.
"""

from __future__ import annotations

import re

BAD, VSEMI, NEWLINE, INDENT, DEDENT, SUB, ENDSUB = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06", "\x07"
VIRTUAL = VSEMI + NEWLINE + INDENT + DEDENT
REMEMBERED = 200_000


class Kinds(dict):
    """Token text -> kind, computed once per distinct token; bounded."""

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, token):
        kind = self.classify(token)
        if len(token) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = kind
        return kind


def alphabet(words: str, operators: str, classes: dict[str, str]) -> dict[str, str]:
    """Grammar names -> characters: single punctuation stands for itself, words and long operators get private ones."""
    kinds = dict(classes)
    code = 0xE000
    for w in words.split() + operators.split():
        if len(w) == 1 and not w.isalnum() and w != "_":
            kinds[w] = w
        else:
            kinds[w] = chr(code)
            code += 1
    return kinds


class Lexer:
    """``blanks`` (characters) and ``comment`` match what has no kind: the pattern matches it too, but ``kinds`` passes over it.

    ``opener`` matches a token that only opens what the pattern cannot match, and is BAD by itself; ``close`` (text, start)
    gives its end or -1.
    """

    def __init__(self, pattern: str, classify, blanks: str, comment: str, finish=None, opener: str | None = None, close=None):
        self.pattern = re.compile(pattern, re.S)
        self.findall = self.pattern.findall
        self.words = re.compile(rf"[{blanks}]*+(?:{comment}|({pattern})|\Z)", re.S).findall
        self.names = Kinds(lambda t: classify(t) if t else "")
        self.finish = finish
        self.opens = re.compile(opener).fullmatch if opener else None
        self.close = close

    def tokens(self, text: str) -> list[str]:
        found = self.findall(text)
        if not self.opens or not any(map(self.opens, set(found))):
            return found
        out, at = [], 0
        while at < len(text):
            for m in self.pattern.finditer(text, at):
                if self.opens(m[0]):
                    break
                out.append(m[0])
            else:
                break
            at = self.close(text, m.start())
            if at < 0:  # never closed: the token is bad, and so is the text
                return out + self.findall(text, m.start())
            out.append(text[m.start() : at])
        return out

    def kinds(self, text: str) -> str:
        found = self.words(text)
        raw = "".join(map(self.names.__getitem__, found))
        if self.opens and BAD in raw and any(map(self.opens, set(found))):
            raw = "".join(map(self.names.__getitem__, self.tokens(text)))
        return self.finish(raw) if self.finish else raw

    def offset(self, text: str, kinds: str, at: int) -> int:
        """Where in ``text`` the token at position ``at`` of ``kinds`` begins."""
        real = at - sum(kinds.count(v, 0, at) for v in VIRTUAL)
        place = 0
        for t in self.tokens(text):
            n = 0 if t[0] == "\n" else sum(c not in VIRTUAL and c != "\n" for c in self.names[t])
            if n > real:
                break
            real -= n
            place += len(t)
        return min(place, len(text))


STRING_D, STRING_S = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'"
BLOCK = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"


# Go ------------------------------------------------------------------------------------------------------------

#: The keywords and operators of the Go specification.
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO_OPS = "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... ( ) [ ] { } , . ; :"
GO = alphabet(GO_WORDS, GO_OPS, {"ID": "i", "NUM": "n", "STR": "s", "CHAR": "c", "EOF": "\0", "VSEMI": VSEMI})
GO["SEMI"] = ";" + VSEMI
_GO_CLASSES = {"ID", "NUM", "STR", "CHAR", "EOF", "VSEMI", "SEMI"}
_GO_NUMBER = r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)"
_GO_PATTERN = rf"""[^\W\d]\w*|[ \t\r]+|\n|//[^\n]*|{BLOCK}|{_GO_NUMBER}|{STRING_D}|`[^`]*`|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)'|&\^=|<<=|>>=|\.\.\.|&\^|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|."""


def _go_kind(t: str) -> str:
    if t in GO and t not in _GO_CLASSES:
        return GO[t]
    c = t[0]
    if c in " \t\r":
        return ""
    if c == "\n":
        return "\n"
    if t[:2] == "//" or t[:2] == "/*" and len(t) > 3:
        return "\n" if "\n" in t else ""
    if len(t) > 1 and c in '"`':
        return "s"
    if len(t) > 2 and c == "'":
        return "c"
    if c == "." or c.isdigit():
        return "n" if t[-1] != "." or len(t) > 1 else BAD
    return "i" if c == "_" or c.isalpha() else BAD


_GO_END = re.compile("(?<=[insc)\\]}" + "".join(GO[w] for w in ("break", "continue", "fallthrough", "return", "++", "--")) + "])\n+")
GO_LEXER = Lexer(_GO_PATTERN, _go_kind, r" \t\r", r"//[^\n]*+", lambda raw: _GO_END.sub(VSEMI, raw + "\n").replace("\n", ""))


# Rust ----------------------------------------------------------------------------------------------------------

#: The strict keywords of Rust 2021 and its punctuation.
RUST_WORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules auto default safe"
RUST_OPS = "+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= = == != > < <= @ . .. ... ..= , ; : :: -> => # $ ? ~ ( ) [ ] { } _"
RUST = alphabet(RUST_WORDS, RUST_OPS, {"NUM": "n", "STR": "s", "CHAR": "c", "LIFE": "l", "DOC": "d", "EOF": "\0"})
RUST["_"] = "_"
RUST["ID"] = "i" + RUST["union"] + RUST["macro_rules"] + RUST["auto"] + RUST["default"] + RUST["safe"]
_RAW = "|".join(rf'b?r{h}"(?:[^"]{"|\"(?!" + h + ")" if h else ""})*+"{h}' for h in ("####", "###", "##", "#", ""))
_BLOCK1 = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
_BLOCK2 = rf"/\*(?:[^*/]|\*(?!/)|{_BLOCK1}|/(?!\*))*+\*/"
_BLOCK3 = rf"/\*(?:[^*/]|\*(?!/)|{_BLOCK2}|/(?!\*))*+\*/"
_RUST_OPENER = r"/\*|b?r\#+\""
_RUST_PATTERN = rf"""[^\W\d]\w*+(?![\"'\#])|[ \t\r\n]+|//[^\n]*|{_BLOCK3}|{_RAW}|{_RUST_OPENER}|b?"(?:[^"\\]|\\.)*+"|b?'(?:[^'\\\n]|\\(?:u\{{[0-9a-fA-F_]+\}}|x[0-9a-fA-F]{{2}}|.))'|'[^\W\d]\w*|r\#[^\W\d]\w*|[^\W\d]\w*|(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)|<<=|\.\.\.|\.\.=|<<|->|=>|::|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|==|!=|<=|\.\.|."""


_COMMENT_MARK = re.compile(r"/\*|\*/")
_RAW_HEAD = re.compile(r'b?r(#+)"')


def rust_end(text: str, at: int) -> int:
    """The place after the nested comment or the raw string that begins at ``at``, or -1."""
    if m := _RAW_HEAD.match(text, at):
        end = text.find('"' + m[1], m.end())
        return end + 1 + len(m[1]) if end >= 0 else -1
    depth = 0
    for m in _COMMENT_MARK.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return -1


def _rust_kind(t: str) -> str:
    if t in RUST and t not in ("ID", "NUM", "STR", "CHAR", "LIFE", "DOC", "EOF"):
        return RUST[t]
    c = t[0]
    if c in " \t\r\n":
        return ""
    if t[:2] == "//" or t[:2] == "/*" and len(t) > 3:
        outer = t[:3] == "///" and t[3:4] != "/" or t[:3] == "/**" and t[3:4] not in ("*", "/") and len(t) > 4
        return "d" if outer else ""
    if len(t) > 1 and t[-1] in '"#' and '"' in t:
        return BAD if _RAW_HEAD.fullmatch(t) else "s"
    if len(t) > 2 and t[-1] == "'":
        return "c"
    if c == "'":
        return "l" if len(t) > 1 else BAD
    if c.isdigit():
        return "n"
    return "i" if c == "_" or c.isalpha() else BAD


RUST_LEXER = Lexer(_RUST_PATTERN, _rust_kind, r" \t\r\n", r"//(?!/(?!/))[^\n]*+", opener=_RUST_OPENER, close=rust_end)


# JavaScript and TypeScript -------------------------------------------------------------------------------------

#: Reserved words of ECMAScript, then words that are names except in certain places.
JS_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
JS_SOFT = "async await of get set static let yield from as accessor type interface declare namespace module abstract readonly is keyof infer implements private public protected override unique asserts satisfies constructor global require"
JS_OPS = "{ } ( ) [ ] . ... ; , < > <= == != === !== + - * % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= %= **= <<= &= |= ^= &&= ||= ??= => / /= @ #"
JS = alphabet(JS_WORDS + " " + JS_SOFT, JS_OPS, {"NUM": "n", "STR": "s", "TPL": "t", "RE": "r", "EOF": "\0", "VSEMI": VSEMI, "SUB": SUB, "ENDSUB": ENDSUB, "NAME": "i"})
JS["ID"] = "i" + "".join(JS[w] for w in JS_SOFT.split())
JS["WORD"] = JS["ID"] + "".join(JS[w] for w in JS_WORDS.split())
JS["SEMI"] = ";" + VSEMI
_JS_CLASSES = {"NUM", "STR", "TPL", "RE", "EOF", "VSEMI", "SUB", "ENDSUB", "NAME", "ID", "WORD", "SEMI"}


#: Templates whose holes hold no braces, templates, comments or regular expressions.
_TEMPLATE = rf"`(?:[^`\\$]|\\.|\$(?!\{{)|\$\{{(?:[^{{}}`\"'/]|{STRING_D}|{STRING_S})*+\}})*+`"
_RE_LITERAL = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*"
_JS_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
_JS_PATTERN = rf"""[abd-qsu-zA-Z_$][\w$]*+|[ \t\r\f\v\xa0\ufeff]+|\n|//[^\n]*|{BLOCK}|(?:=>|&&|\|\||\?\?|===?|!==?|[=(,:\[!&|?{{;+\-*%~^]|return\b|typeof\b|case\b)\s*{_RE_LITERAL}|(?:[^\W\d]|\$)[\w$]*|{_JS_NUMBER}|{STRING_D}|{STRING_S}|{_TEMPLATE}|=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|===?|!==?|\*\*=?|<<=?|[+\-*/%&|^]=|\+\+|--|<=|."""


_TEMPLATE_MARK = re.compile(r"\\.|`|\$\{", re.S)


def template_end(text: str, at: int, holes: list[str] | None = None) -> int:
    """The place after the template that begins at ``at``, or -1; the expressions in its own ``${}`` go to ``holes``."""
    depths: list[int] = []  # open braces of each hole that is open
    code, i, begin = False, at + 1, 0
    while True:
        m = JS_LEXER.pattern.match(text, i) if code else _TEMPLATE_MARK.search(text, i)
        if not m:
            return -1
        t, i = m[0], m.end()
        if t == "`":
            if not code and not depths:
                return i
            code = not code
        elif not code:
            if t == "${":
                i -= 1  # the brace may be one token with the regular expression after it
                if not depths:
                    begin = i + 1
                depths.append(0)
                code = True
        elif t[0] == "{":
            depths[-1] += 1
        elif t == "}":
            depths[-1] -= 1
            if not depths[-1]:
                depths.pop()
                code = False
                if not depths and holes is not None:
                    holes.append(text[begin : m.start()])


def _holes(t: str) -> list[str]:
    """The expressions inside ``${}`` of a template."""
    out: list[str] = []
    template_end(t, 0, out)
    return out


def _js_kind(t: str) -> str:
    if t in JS and t not in _JS_CLASSES:
        return JS[t]
    c = t[0]
    if c in " \t\r\f\v\xa0\ufeff":
        return ""
    if c == "\n":
        return "\n"
    if t[:2] == "//" or t[:2] == "/*" and len(t) > 3:
        return "\n" if "\n" in t else ""
    if len(t) > 1 and c in "\"'":
        return "s"
    if len(t) > 1 and c == "`":
        inner = "".join(SUB + "".join(map(_js_kind, JS_LEXER.tokens(h))).replace("\n", "") + ENDSUB for h in _holes(t)) if "${" in t else ""
        return "t" + inner
    if c.isdigit() or c == "." and len(t) > 1:
        return "n"
    if c in "_$" or c.isalpha():
        return "i"
    if "/" in t and len(t) > 1:  # an operator or word and the regular expression after it
        head = t[: t.index("/")].strip()
        return JS[head] + "r"
    return BAD


_soft = "".join(JS[w] for w in JS_SOFT.split() if w not in ("of", "from", "as", "is", "implements", "satisfies"))
_hard = "".join(JS[w] for w in "break case class const continue debugger default delete do else enum export for function if import new return super switch this throw try typeof var void while with null true false".split())
_enders = "instr)\\]}" + ENDSUB + "".join(JS[w] for w in "++ -- this super null true false break continue return debugger".split()) + "".join(JS[w] for w in JS_SOFT.split())
_JS_END = re.compile(f"(?:(?<=[{_enders}])|(?<={JS['as']}{JS['const']}))\n+(?=[in@s#!~" + "".join(JS[w] for w in ("++", "--")) + f"{_soft}{_hard}])")
_JS_RETURN = re.compile(f"(?<=[{JS['return']}{JS['break']}{JS['continue']}])\n+(?!}})")


#: A signature without a body ends with a type: after ``void``, and after ``>`` before a word that begins a declaration.
_JS_SIGNATURE = re.compile(
    f"(?<=:{JS['void']})\n+(?=[i@#{_soft}{_hard}\\[])|(?<=>)\n+(?=[" + "".join(JS[w] for w in "export function class interface abstract declare import const enum public private protected static readonly override".split()) + "])"
)


def _js_finish(raw: str) -> str:
    return _JS_RETURN.sub(VSEMI, _JS_SIGNATURE.sub(VSEMI, _JS_END.sub(VSEMI, raw))).replace("\n", "")


JS_LEXER = Lexer(_JS_PATTERN, _js_kind, r" \t\r\f\v\xa0\ufeff", r"//[^\n]*+", _js_finish, "`", template_end)


_JSX_HINT = re.compile(r"</[A-Za-z>]|/>")
_JSX_OPEN = re.compile(r"(?:[(,=?:{\[;]|=>|&&|\|\||return|default)\s*(?=<(?:[A-Za-z>]))")
_JSX_NAME = re.compile(r"[A-Za-z][\w.:-]*")
_JSX_ATTR = re.compile(r"""\s*([A-Za-z_][\w:-]*)\s*(?:=\s*("[^"]*"|'[^']*'|(?=[{<])))?""")


def _braced(text: str, at: int) -> int:
    """The place after the ``}`` that closes the ``{`` at ``at``, or -1."""
    depth = 0
    for m in re.compile(rf"{STRING_D}|{STRING_S}|`(?:[^`\\]|\\.)*`|{BLOCK}|[{{}}]", re.S).finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return m.end()
    return -1


def _element(text: str, at: int, exprs: list[str]) -> int:
    """Reads the JSX element at ``at``; gathers its expressions; returns the place after it, or -1."""
    i, name = at + 1, ""
    if m := _JSX_NAME.match(text, i):
        name, i = m[0], m.end()
    while name:
        m = re.compile(r"\s*(/?>|\{)").match(text, i)
        if m and m[1] == "/>":
            return m.end()
        if m and m[1] == ">":
            i = m.end() - 1
            break
        if m:
            end = _braced(text, m.end() - 1)
            if end < 0:
                return -1
            exprs.append(text[m.end() : end - 1].strip().removeprefix("..."))
            i = end
            continue
        m = _JSX_ATTR.match(text, i)
        if not m:
            return -1
        i = m.end()
        if m[2] is None and m[0].rstrip().endswith("=") and text[i : i + 1] == "{":
            end = _braced(text, i)
            if end < 0:
                return -1
            exprs.append(text[i + 1 : end - 1])
            i = end
    if text[i : i + 1] != ">":
        return -1
    i += 1
    while True:
        m = re.compile(r"[{<]").search(text, i)
        if not m:
            return -1
        i = m.start()
        if m[0] == "{":
            end = _braced(text, i)
            if end < 0:
                return -1
            inner = re.sub(BLOCK, "", text[i + 1 : end - 1]).strip().removeprefix("...")
            if inner:
                exprs.append(inner)
            i = end
        elif text[i + 1 : i + 2] == "/":
            m = re.compile(rf"</\s*{re.escape(name)}\s*>").match(text, i)
            return m.end() if m else -1
        else:
            i = _element(text, i, exprs)
            if i < 0:
                return -1


def without_jsx(text: str) -> str:
    """``text`` with each JSX element replaced by a call on the expressions it holds; line count is kept."""
    if not _JSX_HINT.search(text):
        return text
    out, at = [], 0
    while m := _JSX_OPEN.search(text, at):
        exprs: list[str] = []
        end = _element(text, m.end(), exprs)
        if end < 0:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        call = "jsx(" + ",".join(without_jsx(" (" + e + ")") for e in exprs) + ")"
        lines = text.count("\n", m.end(), end) - call.count("\n")
        out.append(text[at : m.end()] + call + "\n" * max(0, lines))
        at = end
    return "".join(out) + text[at:]


# Python --------------------------------------------------------------------------------------------------------

#: The keywords of Python 3, the soft ones, and its operators.
PY_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
PY_SOFT = "match case type _"
PY_OPS = "( ) [ ] { } , : . ; @ = -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= := + - * / // % ** << >> & | ^ ~ < > <= >= == != ..."
PY = alphabet(PY_WORDS + " " + PY_SOFT, PY_OPS, {"NUM": "n", "STR": "s", "EOF": "\0", "NL": NEWLINE, "IN": INDENT, "OUT": DEDENT, "SUB": SUB, "ENDSUB": ENDSUB, "FMT": "f", "CONV": "!"})
PY["_"] = "_"
PY["ID"] = "i" + "".join(PY[w] for w in PY_SOFT.split())
_PY_CLASSES = {"NUM", "STR", "EOF", "NL", "IN", "OUT", "SUB", "ENDSUB", "FMT", "CONV", "ID"}
_PY_PREFIX = r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?"
_PY_STRING = rf'''{_PY_PREFIX}(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')'''
_PY_NUMBER = r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?![\d.eEjJ_])|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)[jJ]?|\d(?:_?\d)*\.[jJ]?|\d(?:_?\d)*[jJ]))(?!\w)"
_PY_PATTERN = rf"""[^\W\d]\w*+(?![\"'])|\n[ \t\f]*|[ \t\f\r]+|\\\r?\n|\#[^\n]*|{_PY_STRING}|[^\W\d]\w*|{_PY_NUMBER}|\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|<=|>=|==|!=|."""


def _fstring(t: str) -> str | None:
    """Kinds of an f-string's replacement fields; None if a brace is wrong."""
    body = re.compile(r"^\w*(\"\"\"|'''|\"|')(.*)\1$", re.S).match(t)
    out, text, i = [], body[2], 0
    while i < len(text):
        c = text[i]
        if c in "{}" and text[i : i + 2] == c * 2:
            i += 2
        elif c == "}":
            return None
        elif c != "{":
            i += 1
        else:
            depth, j, colon, quote = 0, i + 1, -1, ""
            while j < len(text):
                d = text[j]
                if quote:
                    quote = "" if d == quote else quote
                elif d in "'\"" and colon < 0:
                    quote = d
                elif d in "([{":
                    depth += 1
                elif d in ")]}" and depth:
                    depth -= 1
                elif d == "}":
                    break
                elif d == ":" and not depth and colon < 0:
                    colon = j
                j += 1
            if j >= len(text):
                return None
            stop = colon if colon >= 0 else j
            expr = text[i + 1 : stop]
            m = re.search(r"(?<![=!<>])=\s*$", re.sub(r"![rsa]\s*$", "", expr)) if "=" in expr else None
            expr = re.sub(r"![rsa]\s*$", "", expr)
            expr = expr[: m.start()] if m else expr
            out.append(SUB + re.sub(r"\n[^\0]*\0", "", "".join(map(_py_kind, PY_LEXER.findall(expr)))) + ENDSUB)
            i = j + 1
    return "".join(out)


def _py_kind(t: str) -> str:
    if t in PY and t not in _PY_CLASSES:
        return PY[t]
    c = t[0]
    if c in " \t\f\r#" or c == "\\" and len(t) > 1:
        return ""
    if c == "\n":
        return t + "\0"
    if len(t) > 1 and t[-1] in "\"'":
        prefix = t[: min(x for x in (t.find('"'), t.find("'")) if x >= 0)].lower()
        if "f" in prefix and "{" in t or "f" in prefix and "}" in t:
            inner = _fstring(t)
            return BAD if inner is None else "f" + inner
        return BAD if "b" in prefix and not t.isascii() else "s"
    if c.isdigit() or c == "." and len(t) > 1:
        return "n"
    return "i" if c == "_" or c.isidentifier() else BAD


_F_OPEN = re.compile(r"(?i)(?<!\w)(?:f|t|rf|fr|rt|tr)(\"\"\"|'''|\"|')")


def _f_end(text: str, at: int, quote: str, fields: list[tuple[int, int]]) -> int:
    """The place after the f-string whose body begins at ``at``, or -1; strings inside its replacement fields go to ``fields``.

    A field may use the quotes of the string around it, to any depth.
    """
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if depth and (m := _PY_STRINGS.match(text, i)):
            end = m.end()
            if f := _F_OPEN.match(text, i):
                end = _f_end(text, f.end(), f[1], [])
                if end < 0:
                    return -1
            fields.append((i, end))
            i = end
        elif depth:
            depth += (c in "([{") - (c in ")]}")
            if c == "\n" and len(quote) == 1 and not depth:
                return -1
            i += 1
        elif text.startswith(quote, i):
            return i + len(quote)
        elif c == "\n" and len(quote) == 1:
            return -1
        elif c == "\\":
            i += 2
        elif c == "{":
            if text[i : i + 2] == "{{":
                i += 2
            else:
                depth, i = 1, i + 1
        else:
            i += 1
    return -1


def without_nested_quotes(text: str) -> str:
    """``text`` with the strings inside the replacement fields of f-strings as names of the same length."""
    out, at = [], 0
    pattern = PY_LEXER.pattern
    i = 0
    while i < len(text):
        if m := _F_OPEN.match(text, i):
            fields: list[tuple[int, int]] = []
            end = _f_end(text, m.end(), m[1], fields)
            if end > 0:
                for a, b in fields:
                    out += [text[at:a], "_" * (b - a)]
                    at = b
                i = end
                continue
        i = max(i + 1, pattern.match(text, i).end())
    return "".join(out) + text[at:]


def _width(blank: str) -> int:
    n = 0
    for c in blank:
        n = (n // 8 + 1) * 8 if c == "\t" else 0 if c in "\f\n\ufeff" else n + 1
    return n


def _depth(kinds: str) -> int:
    """How many brackets the line opens (or, below zero, closes)."""
    return sum(map(kinds.count, "([{")) - sum(map(kinds.count, ")]}"))


def _line(raw: str) -> tuple[int, str, int]:
    """(width of the indentation, kinds, ``_depth``) of a line: blanks, "\\0", kinds."""
    pad, _, kinds = raw.partition("\0")
    return _width(pad), kinds, _depth(kinds)


class PythonLexer(Lexer):
    """Adds NEWLINE, INDENT and DEDENT from the blanks at the start of each logical line."""

    def __init__(self, pattern, classify, blanks, comment):
        super().__init__(pattern, classify, blanks, comment)
        self.lines = Kinds(_line)

    def kinds(self, text: str) -> str:
        out = self._kinds(text)
        if BAD in out and (plain := without_nested_quotes(text)) != text:
            return self._kinds(plain)
        return out

    def _kinds(self, text: str) -> str:
        names, lines = self.names, self.lines
        at = re.match(r"\ufeff?[ \t\f]*", text).end()
        raw = "".join(map(names.__getitem__, self.words(text, at))).split("\n")
        # a line break's kind is "\n", the line's blanks and "\0", so that each line brings its indentation
        raw[0] = text[:at] + "\0" + raw[0]
        out: list[str] = []
        stack, top, depth, line = [0], 0, 0, ""
        for x in raw:
            n, k, opened = lines[x]
            if depth > 0:
                line += k
            elif not k:
                continue
            else:
                if n != top:
                    if n > top:
                        stack.append(n)
                        out.append(INDENT)
                    else:
                        while n < stack[-1]:
                            stack.pop()
                            out.append(DEDENT)
                        if n != stack[-1]:
                            out.append(BAD)
                    top = stack[-1]
                line = k
            depth += opened
            if depth <= 0:
                depth = 0
                out.append(line)
                out.append(NEWLINE)
                line = ""
        if depth > 0:
            out.append(line)
            out.append(NEWLINE)
        out.append(DEDENT * (len(stack) - 1))
        return "".join(out)


_PY_STRINGS = re.compile(_PY_STRING, re.S)
PY_LEXER = PythonLexer(_PY_PATTERN, _py_kind, r" \t\f\r", r"\#[^\n]*+")
