"""Parsing expression grammars, compiled to Python.

A grammar is text in the usual PEG notation (``/`` ordered choice, ``* + ?``, ``& !``).  It describes a string in
which every character stands for one token, so a terminal is one character.  Two properties carry the speed:

* a sub-expression that reaches no recursive rule is regular, and a PEG without recursion means exactly the same as a
  regular expression with atomic choices and possessive repeats, so it becomes one compiled pattern;
* every other rule becomes a function, which is entered only where the token at hand can begin it.  A rule that several
  places call keeps its ends per input (packrat), and a rule marked ``%`` also keeps a table of whole statements seen
  before, across inputs (see ``span``).

``Peg.trace`` is a second compilation without patterns which records the furthest token any terminal failed at.
"""

from __future__ import annotations

import re
from collections import Counter

END = "\0"
_TOKEN = re.compile(r"\s+|#[^\n]*|(?P<name>%?[A-Za-z_]\w*)|(?P<lit>'[^']*')|(?P<arrow><-)|(?P<op>[/*+?&!()])")


class GrammarError(ValueError):
    pass


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GrammarError(f"cannot read the grammar at {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


def parse_grammar(text: str, kinds: dict[str, str]) -> dict[str, tuple]:
    """Rules by name.  Nodes: ('set', chars), ('seq', ..), ('alt', ..), ('star'|'plus'|'opt'|'and'|'not', x), ('call', name)."""
    toks = _lex(text)
    starts = [i for i, t in enumerate(toks) if t[0] == "arrow"]
    rules: dict[str, tuple] = {}
    for n, i in enumerate(starts):
        body = toks[i + 1 : (starts[n + 1] - 1 if n + 1 < len(starts) else len(toks))]
        name = toks[i - 1][1]
        node, rest = _alt(body, 0, kinds)
        if rest != len(body):
            raise GrammarError(f"rule {name}: cannot read {body[rest:][:3]}")
        rules[name] = node
    plain = {r.lstrip("%") for r in rules}
    for r in rules.values():
        for c in _calls(r):
            if c not in plain:
                raise GrammarError(f"no rule {c}")
    return rules


def _alt(toks, i, kinds):
    parts = []
    while True:
        node, i = _seq(toks, i, kinds)
        parts.append(node)
        if i < len(toks) and toks[i] == ("op", "/"):
            i += 1
            continue
        break
    if all(p[0] == "set" for p in parts):
        return ("set", "".join(dict.fromkeys("".join(p[1] for p in parts)))), i
    return (parts[0] if len(parts) == 1 else ("alt", *parts)), i


def _seq(toks, i, kinds):
    parts = []
    while i < len(toks) and toks[i] not in (("op", "/"), ("op", ")")):
        pre = None
        if toks[i] in (("op", "&"), ("op", "!")):
            pre, i = ("and" if toks[i][1] == "&" else "not"), i + 1
        kind, text = toks[i]
        if kind == "lit":
            if text[1:-1] not in kinds:
                raise GrammarError(f"no token {text}")
            node, i = ("set", kinds[text[1:-1]]), i + 1
        elif kind == "name":
            node, i = (("set", kinds[text]) if text in kinds else ("call", text.lstrip("%"))), i + 1
        elif (kind, text) == ("op", "("):
            node, i = _alt(toks, i + 1, kinds)
            if i >= len(toks) or toks[i] != ("op", ")"):
                raise GrammarError("unbalanced parenthesis")
            i += 1
        else:
            raise GrammarError(f"unexpected {text}")
        while i < len(toks) and toks[i][0] == "op" and toks[i][1] in "*+?":
            node, i = ({"*": "star", "+": "plus", "?": "opt"}[toks[i][1]], node), i + 1
        parts.append((pre, node) if pre else node)
    return (parts[0] if len(parts) == 1 else ("seq", *parts)), i


def _calls(node) -> list[str]:
    if node[0] == "call":
        return [node[1]]
    return [] if node[0] == "set" else [c for x in node[1:] for c in _calls(x)]


def _charset(chars: str) -> str:
    return re.escape(chars) if len(chars) == 1 else "[" + "".join(re.escape(c) for c in chars) + "]"


def _pattern(node, rules) -> str:
    op = node[0]
    if op == "set":
        return _charset(node[1])
    if op == "call":
        return _pattern(rules[node[1]], rules)
    if op == "seq":
        return "".join(_pattern(x, rules) for x in node[1:])
    if op == "alt":
        return "(?>" + "|".join(_pattern(x, rules) for x in node[1:]) + ")"
    inner = _pattern(node[1], rules)
    return {"star": f"(?:{inner})*+", "plus": f"(?:{inner})++", "opt": f"(?:{inner})?+", "and": f"(?={inner})", "not": f"(?!{inner})"}[op]


class Peg:
    """``parse(kinds)`` -> the end of what the start rule consumed, or -1; ``furthest(kinds)`` -> furthest failure."""

    def __init__(self, text: str, kinds: dict[str, str], start: str, span: str | None = None, cache: int = 200_000):
        marked = parse_grammar(text, kinds)
        self.spans = {r[1:] for r in marked if r[0] == "%"}
        self.rules = {r.lstrip("%"): x for r, x in marked.items()}
        self.start, self.span, self.cache = start, span and re.compile(span).match, cache
        uses = Counter(c for r in self.rules.values() for c in _calls(r))
        reach = {r: self._reach(r) for r in self.rules}
        self.recursive = {r for r in self.rules if any(x in reach[x] for x in reach[r] | {r})}
        self.memo = {r: n for n, r in enumerate(sorted(r for r in self.recursive if uses[r] > 1))}
        self.first = self._firsts()
        self.parse_from = self._compile(trace=False)
        self._traced = None

    def _reach(self, name):
        seen, todo = set(), [name]
        while todo:
            for c in _calls(self.rules[todo.pop()]):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    def _begins(self, node, first) -> tuple[frozenset[str], bool]:
        """(tokens that ``node`` can begin with, whether it can match without consuming one)."""
        op = node[0]
        if op == "set":
            return frozenset(node[1]), False
        if op == "call":
            return first[node[1]]
        if op in ("and", "not"):
            return frozenset(), True
        if op in ("seq", "alt"):
            chars: frozenset[str] = frozenset()
            empty = op == "seq"
            for x in node[1:]:
                more, nothing = self._begins(x, first)
                chars |= more
                if op == "alt":
                    empty = empty or nothing
                elif not nothing:
                    return chars, False
            return chars, empty
        chars, empty = self._begins(node[1], first)
        return chars, empty or op != "plus"

    def _firsts(self) -> dict[str, tuple[frozenset[str], bool]]:
        first = {r: (frozenset(), False) for r in self.rules}
        while (more := {r: self._begins(x, first) for r, x in self.rules.items()}) != first:
            first = more
        return first

    def parse(self, kinds: str) -> int:
        return self.parse_from(kinds + END, 0, {})

    def furthest(self, kinds: str) -> int:
        if self._traced is None:
            self._traced = self._compile(trace=True)
        f = [0]
        self._traced(kinds + END, 0, {"": f})
        return f[0]

    # code generation -------------------------------------------------------------------------------------------

    def _regular(self, node) -> bool:
        return not any(c in self.recursive for c in _calls(node))

    def _compile(self, trace: bool):
        env: dict = {"SPAN": self.span, "END": END}
        code: list[str] = []
        count = [0]

        def fresh(prefix):
            count[0] += 1
            return f"{prefix}{count[0]}"

        def line(depth, s):
            code.append("  " * depth + s)

        def can_begin(node):
            """A test that fails only where ``node`` does, or None."""
            chars, empty = self._begins(node, self.first)
            if trace or empty or not chars:
                return None
            return f"s[p] == {min(chars)!r}" if len(chars) == 1 else f"s[p] in {''.join(sorted(chars))!r}"

        def emit(node, d, quiet=False, tested=False):
            op = node[0]
            if not trace and op != "set" and self._regular(node):
                rx = fresh("rx")
                env[rx] = re.compile(_pattern(node, self.rules), re.S).match
                line(d, f"m = {rx}(s, p)")
                line(d, "p = m.end() if m else -1")
            elif op == "set":
                test = f"s[p] == {node[1]!r}" if len(node[1]) == 1 else f"s[p] in {node[1]!r}"
                if trace and not quiet:
                    line(d, f"if {test}: p += 1")
                    line(d, "else:")
                    line(d + 1, "if p > F[0]: F[0] = p")
                    line(d + 1, "p = -1")
                else:
                    line(d, f"p = p + 1 if {test} else -1")
            elif op == "call":
                if trace and quiet:  # a predicate's own failures say nothing about the input
                    line(d, f"keep = F[0]; p = r_{node[1]}(s, p, M); F[0] = keep")
                else:
                    test = None if tested else can_begin(node)
                    line(d, f"p = r_{node[1]}(s, p, M)" + (f" if {test} else -1" if test else ""))
            elif op == "seq":
                parts, run = [], []
                for x in node[1:]:
                    if not trace and self._regular(x):
                        run.append(x)
                    else:
                        if run:
                            parts.append(run[0] if len(run) == 1 else ("seq", *run))
                        run = []
                        parts.append(x)
                if run:
                    parts.append(run[0] if len(run) == 1 else ("seq", *run))
                for k, x in enumerate(parts):
                    if k:
                        line(d, "if p >= 0:")
                        d += 1
                    emit(x, d, quiet, tested and not k)
            elif op == "alt":
                q = fresh("q")
                line(d, f"{q} = p")
                for k, x in enumerate(node[1:]):
                    if k:
                        line(d, "if p < 0:")
                        d += 1
                        line(d, f"p = {q}")
                    if x[0] not in ("set", "call") and (test := can_begin(x)):
                        line(d, f"if {test}:")
                        emit(x, d + 1, quiet, True)
                        line(d, "else: p = -1")
                    else:
                        emit(x, d, quiet)
            elif op in ("star", "plus"):
                q = fresh("q")
                if op == "plus":
                    emit(node[1], d, quiet)
                    line(d, "if p >= 0:")
                    d += 1
                test = can_begin(node[1])
                line(d, f"while {test or True}:")
                line(d + 1, f"{q} = p")
                emit(node[1], d + 1, quiet, bool(test))
                line(d + 1, f"if p <= {q}:")
                line(d + 2, f"p = {q}")
                line(d + 2, "break")
            elif op == "opt":
                q = fresh("q")
                if test := can_begin(node[1]):
                    line(d, f"if {test}:")
                    d += 1
                line(d, f"{q} = p")
                emit(node[1], d, quiet, bool(test))
                line(d, f"if p < 0: p = {q}")
            else:
                q = fresh("q")
                line(d, f"{q} = p")
                emit(node[1], d, True)
                line(d, f"p = {q} if p {'>=' if op == 'and' else '<'} 0 else -1")

        for name, node in self.rules.items():
            if not trace and name not in self.recursive and name != self.start:
                continue
            spans = not trace and name in self.spans and self.span is not None
            line(0, f"def r_{name}(s, p, M):")
            if trace:
                line(1, "F = M['']")
            if spans:
                env[f"C_{name}"] = {}
                line(1, "m = SPAN(s, p)")
                line(1, "if m:")
                line(2, "t = m[0]")
                line(2, f"v = C_{name}.get(t)")
                line(2, "if v is None:")
                line(3, f"if len(C_{name}) > {self.cache}: C_{name}.clear()")
                line(3, f"v = C_{name}[t] = b_{name}(t + END, 0, {{}}) == len(t)")
                line(2, "if v: return m.end()")
                line(1, f"return b_{name}(s, p, M)")
                line(0, f"def b_{name}(s, p, M):")
            memo = name in self.memo
            if memo:
                line(1, f"k = p * {len(self.memo)} + {self.memo[name]}")
                line(1, "v = M.get(k)")
                line(1, "if v is not None: return v")
            emit(node, 1)
            if memo:
                line(1, "M[k] = p")
            line(1, "return p")
        exec("\n".join(code), env)  # noqa: S102 - the source is generated from the grammar above
        return env[f"r_{self.start}"]
