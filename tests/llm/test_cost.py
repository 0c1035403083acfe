"""What a text costs to read: counted, and the fast scans against the plain patterns they stand for."""

from __future__ import annotations

import random
import re
import sys
from time import thread_time

import pytest

from quillstone.llm import docs as D
from quillstone.llm import lexers as L
from quillstone.llm.languages import LEXERS, grammar

GO = "package a\n\nfunc f(x int) error {\n" + "\tfor i := range xs {\n\t\tif a.b(i, x) != nil {\n\t\t\treturn g(func() int { return 1 })\n\t\t}\n\t}\n" * 20 + "}\n"
RUST = "fn f(x: &str) -> u8 {\n" + "    for i in xs {\n        if a.b(i, x) != 1 { return g(|y| y + 1); }\n    }\n" * 20 + "    0\n}\n"
PYTHON = "def f(x):\n" + "    for i in xs:\n        if a.b(i, x) != 1:\n            return g(lambda y: y + 1)\n" * 20
TS = "function f(x: string): number {\n" + "  for (const i of xs) {\n    if (a.b(i, x) !== 1) { return g((y) => y + 1); }\n  }\n" * 20 + "  return 0;\n}\n"
TEXTS = {"go": GO, "rust": RUST, "python": PYTHON, "typescript": TS, "javascript": TS.replace(": string", "").replace(": number", "")}


@pytest.mark.parametrize(("language", "most"), [("go", 2.5), ("rust", 1.0), ("python", 1.0), ("typescript", 0.75), ("javascript", 0.75)])
def test_rules_are_entered_only_where_they_can_begin(language, most):
    kinds, peg, calls = LEXERS[language].kinds(TEXTS[language]), grammar(language), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        end = peg.parse(kinds)
    finally:
        sys.setprofile(before)
    assert end == len(kinds) + 1
    assert calls < most * len(kinds)


@pytest.mark.parametrize("language", ["go", "rust", "typescript"])
def test_blanking_is_cheaper_than_cutting_into_tokens(language):
    text = TEXTS[language] * 20

    def least(f):
        took = []
        for _ in range(7):
            began = thread_time()
            f(text)
            took.append(thread_time() - began)
        return min(took)

    assert least(lambda t: D.blank(language, t)) < 0.4 * least(LEXERS[language].findall)


def test_comments_and_blanks_are_no_tokens():
    for language, text in (("go", "a  // b\n\tc"), ("javascript", "a  // b\n\tc"), ("rust", "a  // b\n\tc"), ("python", "a  # b\n\tc")):
        assert [t.strip() for t in LEXERS[language].words(text) if t.strip()] == ["a", "c"]


LINE = r"(?P<line>//[^\n]*)"
PLAIN = {
    "go": rf"{LINE}|(?P<block>{L.BLOCK})|(?P<string>{L.STRING_D}|`[^`]*`|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)')",
    "rust": rf"{LINE}|(?P<block>{L._BLOCK3})|(?P<string>(?<!\w)(?:{L._RAW})|b?\"(?:[^\"\\]|\\.)*+\"|b?'(?:[^'\\\n]|\\(?:u\{{[0-9a-fA-F_]+\}}|x[0-9a-fA-F]{{2}}|.))')",
    "javascript": rf"{LINE}|(?P<block>{L.BLOCK})|(?:=>|&&|\|\||\?\?|===?|!==?|[=(,:\[!&|?{{;+\-*%~^]|\breturn\b|\btypeof\b|\bcase\b)\s*(?P<regex>{L._RE_LITERAL})|(?P<string>{L.STRING_D}|{L.STRING_S}|{L._TEMPLATE})",
    "python": rf"(?P<line>#[^\n]*)|(?P<string>(?<!\w){L._PY_STRING})",
}
PIECES = ["//", "/*", "*/", '"', "'", "\\", "\n", " ", "#", "=", "=>", ">", "(", ")", "/", "[", "]", "return", "typeof ", "case", "x", "b", "r", "br", "f", "rb", "u", "_", "é", "0", "'a", 'r#"', '"#', '"""', "'''", "${", "}", "++", ";", "."]


@pytest.mark.parametrize("language", PLAIN)
def test_states_are_those_of_the_plain_pattern(language):
    pattern, seen = re.compile(PLAIN[language], re.S), set()
    for seed in range(4_000):
        draw = random.Random(seed)
        text = "".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 24)))
        if language == "rust" and ("/*" in text or "#" in text):  # what only opens is counted, not matched
            continue
        plain = [(*m.span(m.lastgroup), m.lastgroup) for m in pattern.finditer(text)]
        assert list(D._states(language, text)) == plain, text
        seen |= {kind for _, _, kind in plain}
    assert seen >= {"line", "string"}


def test_the_qualifiers_of_a_rust_function_belong_to_it():
    leads = ["", "pub ", "pub(crate)\n", "pub ( in a::b ) ", "const async unsafe ", 'extern "C" ', 'pub unsafe extern  "C" ', "default\tconst "]
    for before in ("", "} ", "x.", "a! ( ) ", "#[x]\n", "mypub ", ") ", '"s" '):
        for lead in leads:
            code = f"{before}{lead}fn name<T>(a: u8) {{ }}"
            m = re.search(r"(?<![\w.])(?:(?:pub(?:\s*\([^()]*\))?|default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*fn\s+name", code)
            assert [f[0] for f in D._rust(code)] == ([m.start()] if m else []), code
