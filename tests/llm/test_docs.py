from __future__ import annotations

import ast
import warnings

import pytest
from pyspark.sql import functions as F

from quillstone.llm import docs as D

GO = """package a

// Load reads the whole file into memory,
// and never blocks.
//nolint:gocyclo
func Load(x int) error {
	s := "func Fake() {"
	return nil
}

// Detached keeps at most five.

func Detached() {}

/* Block says more than its name does. */
func (r *R[T]) Block() (string, error) { return "}", nil }

// func commented() {}
func Bare() {}
"""
JS = """/** Overview of the file. */
import x from 'y';

/**
 * Keeps at most five rows.
 * @param {string} a - the row
 */
export async function keep(a = {}, b = "function no() {") {
  const r = /[{("]+/g.test(a);
  return r;
}

/** Falls back to the cache when nothing matches. */
export const fall = async (a) => {
  /** Inner is documented too, and nested. */
  function inner() {}
  const notTop = () => 1;
};

// plain comment that describes things
function plain() {}

/* block comment that describes things */
const blocky = function () {};

/** @param {string} q */
function tags(q) {}

class A extends B {
  /** Starts everything from the beginning again. */
  constructor(a) { super(a); }
  /** Gives up after three attempts. */
  static async tryHard({ a, b }) { if (a) { b(); } }
  /** A field is no function at all. */
  field = () => {};
  get x() { return 1; }
}
"""
RUST = '''/// Sorts the rows by their oldest member.
#[must_use]
pub(crate) async fn sort<'a, T: Clone>(x: &'a str) -> Result<Vec<T>, Box<dyn Error>>
where
    T: Copy,
{
    let s = r#"fn fake() {"#; /* { */
    let c = '{';
    x
}

#[doc = "Described by an attribute, not a comment."]
fn attr() {}

//! inner text is not for this one
fn inner_only() {}

impl A {
    /** Block documentation in an impl. */
    fn method(&self) {}
    /// Declared without a body in here.
    fn declared(&self);
}
'''


def told(language, text):
    return {(text.count("\n", 0, at) + 1, name) for _, at, name, doc, *_ in D.functions(language, text) if D.description(name, doc)}


def test_go():
    assert told("go", GO) == {(6, "Load"), (16, "Block")}
    assert [n for _, _, n, *_ in D.functions("go", GO)] == ["Load", "Detached", "Block", "Bare"]
    start, *_, body, end = D.functions("go", GO)[0]
    assert GO[start:end].startswith("func Load") and GO[start:end].endswith("return nil\n}")


def test_script():
    assert told("javascript", JS) == {(8, "keep"), (14, "fall"), (16, "inner"), (31, "constructor"), (33, "tryHard")}
    names = [n for _, _, n, *_ in D.functions("javascript", JS)]
    assert "no" not in names and "notTop" not in names and "field" not in names and "if" not in names
    assert "blocky" in names and "x" in names


def test_typescript():
    text = "/** Turns a row into its text, oldest first. */\nexport function f<T extends A>(a: { x: number }, b?: string[]): Promise<{ y: T }> {\n  return a;\n}\n\nabstract class C {\n  /** Waits until the other side is done. */\n  private async run(a: Map<string, number>): Promise<void> {}\n  /** Needs a body in the subclass below. */\n  abstract go(): void;\n}\n"
    assert (2, "f") in told("typescript", text)
    assert (8, "run") in told("typescript", text)


def test_rust():
    assert told("rust", RUST) == {(3, "sort"), (13, "attr"), (20, "method"), (22, "declared")}


def test_python():
    text = 'def f(a="def no():", b={"x": 1}):\n    # note\n    """Keeps what is old and drops the rest."""\n    def g(): \'Single line of useful text.\'\n\n\nclass A:\n    async def h(\n        self,\n    ) -> "dict[str, int]":\n        r"""Raw text that tells more."""\n\n    def i(self):\n        x = """not a docstring at all"""\n\n    def j(self):\n        f"""{no} docstring either here"""\n'
    assert told("python", text) == {(1, "f"), (4, "g"), (8, "h")}


@pytest.mark.parametrize(
    ("name", "doc", "kept"),
    [
        ("trimColumn", "Trims the column.", False), ("trimColumn", "This function trims the column.", False), ("trimColumn", "trimColumn() trims column", False), ("trim_column", "trim_column.", False), ("applyNote", "Applies the note.", False), ("TrimColumn", "TrimColumn keeps at most five.", True),
        ("f", "TODO", False), ("f", "todo(docs)", False), ("f", "FIXME doc", False), ("f", "XXX", False), ("f", "tbd", False), ("f", "n/a", False), ("f", "...", False), ("f", "(no description)", False), ("f", "Documentation to follow.", False), ("f", "Undocumented for now, sorry", False), ("f", "TODO: write documentation for this one before the next release", False),
        ("f", "See README.", False), ("f", "See the wiki for details.", False), ("f", "Same as above.", False), ("f", "See the base class.", False), ("f", "{@inheritDoc}", False), ("f", "@param {string} a\n@returns {number}", False), ("f", ":param a:\n:returns: list", False), ("f", "Args:\n    a: the row to use", False), ("f", "", False), ("f", None, False), ("f", "\n \n", False),
        ("loadIndex", "Loads index. Keeps at most five rows.", True), ("f", "Wie oben, aber der alte Index bleibt.", True), ("f", "See how the rows are sorted before use; the order is stable.", True), ("__init__", "init_init function", False), ("constructor", "Builds the constructor.", False), ("f", "Keeps five.\n\n:param a: row", True),
    ],
)
def test_description(name, doc, kept):
    assert bool(D.description(name, doc)) == kept


def test_python_docstrings_agree_with_the_interpreter(spark, sf):
    warnings.simplefilter("ignore")
    for r in spark.read.parquet(f"{sf}/files.parquet").where("path like '%.py' and content is not null").select("content").distinct().collect():
        try:
            tree = ast.parse(r.content)
        except (SyntaxError, ValueError):
            continue
        want = {(n.lineno, n.name, (ast.get_docstring(n, clean=False) or "").strip()) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        got = {(r.content.count("\n", 0, at) + 1, name, (doc or "").replace("\r\n", "\n").strip()) for _, at, name, doc, *_ in D.functions("python", r.content)}
        assert {w for w in want if "\\" not in w[2]} <= got
        assert {w[:2] for w in want} == {g[:2] for g in got}


def test_operator(spark):
    rows = [(1, "p", "/srv/src/p/a.go", GO), (1, "p", "/srv/src/p/a.go", GO), (2, "p", "/srv/src/p/b.go", GO + "<<<<<<< HEAD\n"), (3, None, "/srv/src/q/c.js", None), (4, "p", "/srv/src/p/d.js", ""), (5, "p", None, GO), (6, None, "/srv/src/q/e.rs", "".join(f"/// Keeps at most {i} of the rows.\nfn f{i}() {{}}\n" for i in range(3000)))]
    df = spark.createDataFrame(rows, "file_id bigint, project_id string, path string, content string").withColumn("symbol", F.lit("clash")).withColumn("line_no", F.lit("clash"))
    got = {tuple(r) for r in D.pairs_found(df).collect()}
    assert {g for g in got if g[0] != 6} == {(1, 6, "Load"), (1, 16, "Block")}
    assert len([g for g in got if g[0] == 6]) == 3000
    pair = D.pairs_once(df.where("file_id = 1")).where("symbol = 'Load'").first()
    assert pair.signature == "func Load(x int) error"
    assert "never blocks" in pair.description
    assert D.pairs_found(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("javascript", "class A {\n  x = 1\n  y = foo(2)\n\n  /** Runs the whole plan. */\n  run(a) {\n    return a\n  }\n}\n", ["run"]),
        ("typescript", "class A {\n  @dec(f(x), { y: [1] })\n  /** Drops what nobody reads. */\n  run(a: Map<string, number>): void {\n  }\n}\n", ["run"]),
        ("typescript", "class A {\n  private x: string\n  /** Keeps the last answer. */\n  @dec(f(x))\n  static async load<T>(a: T): Promise<T> {\n  }\n  handler = (e) => {\n  }\n}\n", ["load"]),
        ("go", "package a\n\n// Add puts one more element in.\nfunc (s *Set[func(int) bool]) Add(v int) {\n}\n", ["Add"]),
        ("typescript", "class A {\n  /** Finds the next free place. */\n" + "  @dec(" + '"x", ' * 120 + '"y")\n' + "  next(a: number) {\n  }\n}\n", ["next"]),
    ],
)
def test_members_without_semicolons_and_nested_decorators(language, text, want):
    got = [(name, D.description(name, doc)) for _, _, name, doc, _, _ in D.functions(language, text)]
    assert [n for n, told in got if told] == want
