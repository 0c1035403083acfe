from __future__ import annotations

import ast
import warnings

import pytest
from pyspark.sql import functions as F

from quillstone.llm import syntax
from quillstone.llm.peg import GrammarError, Peg
from quillstone.llm.queries import LAYOUT

VALID = {
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"x\"\n\t_ \"y/z\"\n)\n\nfunc F[T any, U ~int | string](a, b T, c ...U) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x == 0 {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue\n\t}\n\tfor k, v := range m {\n\t}\n\tfor range ch {\n\t}\n\tswitch y := z.(type) {\n\tcase []int, map[string]int:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tgo func() { defer wg.Done() }()\n\tp := &T{A: 1, B: []int{1, 2}, C: map[string]P{\"a\": {1, 2}}}\n\tq := [...]int{1: 2}\n\tr := a[1:2:3]\n\tl := func(a int) int { return a }\n\tlabel:\n\tfor {\n\t\tbreak label\n\t}\n\treturn\n}\n",
        "package a\ntype (\n\tA = B\n\tC struct {\n\t\tD, E int `json:\"d\"`\n\t\t*F\n\t\tg.H\n\t}\n\tI interface {\n\t\tM(int) string\n\t\tJ\n\t\t~int | ~string\n\t}\n\tK func(a int, b ...string) (int, error)\n\tL chan<- int\n\tM <-chan []*N\n)\nvar x, y = 1, 2\nconst (\n\tP = iota\n\tQ\n)\nvar r = '\\n'\nvar s = `raw\n\"`\n", "package a\nfunc (r *R[T]) M() { x.y(z...) }",
    ],
    "python": [
        "", "\n# only a comment\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> None: pass\n", "async def g():\n    async with a as b, c:\n        await d\n    async for x in y: yield x\n    return [i async for i in z if i]\n", "match x:\n    case [1, *_] | {'a': b, **rest} if b: pass\n    case P(a=1, b=_) as q: ...\n    case -1 | None: pass\n",
        "x: int\ny = z = 1\nx, *y = 1, 2\nx[0].y += f'{a!r:>{w}} {b=}'\ndel x, y[0]\nlambda *a, **k: (yield)\nprint(*a, **b)\nif (n := 1) and not n in a is not b: pass\nelif x: pass\nelse: pass\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "@d(1)\nclass A[T](B, m=c):\n    x = {**a, 'b': 1}\n    y = {1, *z}\n    global q\n", "type X[T: int] = list[T]\nwith (open(a) as b, c):\n    pass\n", "x = (1\n  + 2) \\\n  + 3; y = a if b else c\n", "x = 0xFF + 1_000 + 1e5j + .5\n",
    ],
    "javascript": [
        "", "'use strict'\nconst a = /[/\"]+/g.test(b) ? `x${y}:{${z}}` : c ?? d?.e?.[0]?.(1)\nlet { f, ...g } = h\nfor (const i of j) { continue }\nfor await (const x of y) z()\nfor (var k = 0, l; k < 1; k++) ;\nfor (m in n) o()\n", "export default async function* f(a = 1, [b, , c], { d: e = 2 }, ...g) { yield* h; await i }\nimport * as x from 'y'\nimport z, { a as b } from \"c\"\nexport { b as d }\nexport * from 'e'\n",
        "class A extends (B, C) { static #p = 1; get x() { return this.#p } static { f() } async *[g]() {} 'q'() {} constructor(...a) { super(...a) } }\n", "a = b => c => ({ d, [e]: 1, f() {}, get g() { return 1 }, async *h() {}, ...i })\nnew X.Y(1).z`t`\nx = async (a) => { }\ndo { } while (x)\nswitch (a) { case 1: b(); break; default: }\ntry { } catch { } finally { }\nlabel: for (;;) { break label }\nif (a) b()\nelse c()\nreturn_ = a++ + --b ** 2\n", "const e = <div a=\"1\" {...p}>it's {x && <b/>} </div>;\nf(() => <></>);\n",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D, E { f?: T[]; readonly [k: string]: any; (a: number): string; new (x: T): A<T>; m<U>(this: A<U>): void }\ntype X = { [K in keyof Y as `a${K}`]?: Y[K] } | (A & B) | typeof z.w | [a: string, b?: number, ...c: D[]]\ntype G = A extends infer B ? B : never\ntype H = (a: number, ...b: string[]) => a is string\n", "enum E { A = 1, B, 'C' = 2 }\ndeclare module 'x' { export const a: number }\nnamespace N.M { export function f(): void { } }\nabstract class P<T> implements Q, R { private readonly a: number = 1; constructor(private b: string, public c?: number) { super() } abstract f(): void; get g(): T { return this.h! } static async i<U>(j: U): Promise<Map<string, number[]>> { return k as unknown as any } declare l: string }\n",
        "const f = <T,>(a: T): T => a satisfies T\nlet x = y as const\nfunction g(a?: number): asserts a is number\nfunction g(a: any) { }\nlet z = new Map<string, Array<Array<number>>>()\nexport type { T } from './t'\nimport type U from 'u'\nlet v = a < b && c > d\n",
    ],
    "rust": [
        "", "#![allow(x)]\n//! doc\nuse a::{b, c::{self, d as e}, f::*};\npub(crate) mod m { pub fn f() {} }\n/// doc\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a, const N: usize = 3>(pub &'a [T; N]) where T: Copy;\nenum E { A, B(u8), C { x: i32 } = 3 }\nimpl<'a, T> Tr for S<'a, T> where T: ?Sized { type X = u8; const Y: u8 = 1; fn f(&mut self, _: impl Fn(u8) -> u8) -> Box<dyn Tr + 'a> { todo!() } }\ntrait Tr: A + B { fn g(self: Box<Self>) -> Self; }\n",
        "fn f<T>(x: T) -> Result<Vec<Vec<u8>>, ()> {\n    let v: Vec<_> = (0..=3).map(|x: u8| -> u8 { x + 1 }).collect::<Vec<u8>>();\n    let S { a, ref b, .. } = s else { return Err(()) };\n    match x { 1 | 2 => {}, 3..=9 if y => z(), n @ 4.. => {} Some(&(ref mut q, _)) => (), _ => unreachable!(\"{}\", 1) }\n    if let Some(x) = y && z { } else if a < b { }\n    'l: loop { break 'l; }\n    while let Some(x) = q.pop() { *x += 1 as usize; }\n    for (i, x) in y.iter().enumerate() { continue }\n    let c = move || async move { a?.await };\n    let d = S { x: 1, ..Default::default() };\n    let e = &mut a[0].b.0 as *const u8;\n    unsafe { f::<u8>(1, 2) };\n    r#\"raw \" {\"#; '\\''; b'x'; 1.0e3_f64; <A as B>::c();\n    macro_rules! m { ($x:expr) => { $x }; }\n    if x == (S { y: 1 }) { }\n    Ok(v)\n}\n",
    ],
}
INVALID = {
    "go": ["", "func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f() { x := [1, 2, 3; }\n", "package a\nvar x = “a”\n", "package a\n<<<<<<< HEAD\n", "package a\nfunc f() { if x { } else }\n", "package a\nfunc f() { for i on x { } }\n", "package a\nvar s = \"open\n", "package a\nfunc f() { retrun x }\n"],
    "python": ["def f(:\n  pass\n", "x = (1,\n", "for a on b:\n    pass\n", "if x:\npass\n", "  x = 1\n", "x = 'open\n", "print 'x'\n", "<<<<<<< HEAD\nx = 1\n", "def f():\n    x = 1\n   y = 2\n", "x = 1 +\n", "f'{a'\n", "x = 12ab\n", "class\n", "else:\n    pass\n"],
    "javascript": ["function f( {\n", "const = 1;\n", "if (a === ) { }\n", "x = [1, 2;\n", "const a = “b”;\n", "f(a, (b);\n", "retrun x;\n", "function function f() {}\n", "a.map(x => { return x);\n", "let x: number = 1;\n", "interface A { b: string }\n", "use std::io;\n", "`open ${a\n", "class A { f() { }\n"],
    "typescript": ["let x: = 1;\n", "interface A { b: string\n", "package a\n", "function f(a: number { }\n", "@@ -1,2 +3,4 @@\n"],
    "rust": ["fn f( {}\n", "fn f() { let x = vec![1; }\n", "fn f() { x.y(); \n", "let x = 1;\n", "fn f() -> { }\n", "fn f() { let = 1; }\n", "struct S { a: u8 b: u8 }\n", "import x from 'y';\n", "fn f() { call(x, (8); }\n", "/// nothing follows\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    far = syntax.diagnose(language, text) if not syntax.parses(language, text) else None
    assert far is None, text[far[1] - 20 : far[1] + 30]


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in INVALID.items() for t in ts])
def test_invalid(language, text):
    assert not syntax.parses(language, text)


def test_modules_and_scripts():
    assert not syntax.parses("javascript", "import a from 'b';\n", module=False)
    assert syntax.parses("javascript", "const a = require('b');\n", module=False)


@pytest.mark.parametrize(
    ("language", "text", "line", "cause"),
    [
        ("go", "package a\n\nfunc f() {\n<<<<<<< HEAD\n\tx()\n=======\n}\n", 4, "merge_conflict"), ("python", "x = 1\n@@ -1,2 +1,3 @@\n+y\n", 2, "patch_hunk"), ("rust", "fn f() {\n    x();\n", 3, "truncated"),
        ("python", "package a\n\nfunc f() {\n}\n", 1, "wrong_extension"), ("javascript", "let a = “b”;\n", 1, "bad_token"), ("typescript", "let a = 1;\nif (a === ) { }\n", 2, "syntax_error"),
    ],
)
def test_causes(language, text, line, cause):
    got = syntax.diagnose(language, text)
    assert (got[0], got[2]) == (line, cause)


def test_deep_nesting_does_not_crash():
    deep = "x = " + "(" * 3000 + "1" + ")" * 3000 + "\n"
    assert syntax.parses("python", deep) in (True, False)
    assert syntax.parses("javascript", "[" * 2000 + "]" * 2000)


def test_grammar_is_atomic_and_greedy():
    kinds = {"A": "a", "B": "b", "C": "c", "EOF": "\0"}
    assert Peg("S <- A* A EOF", kinds, "S").parse("aaa") == -1
    assert Peg("S <- (A / A B) C EOF", kinds, "S").parse("abc") == -1
    assert Peg("S <- (A B / A) C EOF", kinds, "S").parse("ac") == 3
    nested = Peg("S <- P EOF\nP <- A P B / C", kinds, "S")
    assert nested.parse("aacbb") == 6
    assert nested.parse("aacb") == -1
    assert nested.furthest("aacb") == 4
    with pytest.raises(GrammarError):
        Peg("S <- A X", kinds, "S")


def test_python_agrees_with_the_interpreter(spark, sf):
    rows = spark.read.parquet(f"{sf}/files.parquet".replace("sf0.001", "sf0.01")).where("path like '%.py' and content is not null").select("content").distinct().collect()
    warnings.simplefilter("ignore")
    for r in rows:
        try:
            ast.parse(r.content)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        assert syntax.parses("python", r.content) == ok


def test_operator(spark):
    rows = [(1, "p", "/srv/src/p/a.go", "package a\n"), (1, "p", "/srv/src/p/a.go", "package a\n"), (2, None, "/srv/src/q/b.py", "x = (\n"), (3, "p", "/srv/src/p/c.js", None), (4, "p", None, "x"), (5, "p", "/srv/src/p/d.md", "# x"), (6, "p", "/srv/src/p/e.py", ""), (7, "p", "/srv/src/p/f.cjs", "import a from 'b'"), (8, "p", "/x/g.rs", "fn f() {" + "a();" * 50_000)]
    df = spark.createDataFrame(rows, "file_id bigint, project_id string, path string, content string").withColumn("language", F.lit("clash")).withColumn("valid", F.lit("clash"))
    assert {r.file_id for r in syntax.syntax_found(df).collect()} == {2, 7, 8}
    rates = {(r.project, r.language): (r.files, r.invalid) for r in syntax.syntax_rates(df, LAYOUT).collect()}
    assert rates["p", "go"] == (1, 0)
    assert rates["q", "python"] == (1, 1)
    assert syntax.syntax_found(df.limit(0)).count() == 0


NESTED = [
    ("javascript", "let a = `${f({a: {b: 1}})}`;"), ("javascript", "let a = `${a.map(x => { return { y: x } })}`;"), ("typescript", "let a = `${list.map((i) => { return `<li>${i}</li>` }).join('')}`;"),
    ("javascript", "let a = `${`${`${`${`${`${1}`}`}`}`}`}` + 1;"), ("javascript", "let a = `${x /* } */ + 1}`;"), ("javascript", 'let a = `${s.replace(/["`}]/g, "}")}`;'),
    ("rust", "/* 1 /* 2 /* 3 /* 4 /* 5 */ */ */ */ */ fn f() {}"), ("rust", 'fn f() { let a = r#####"x"####y"#####; }'),
]


@pytest.mark.parametrize(("language", "text"), NESTED)
def test_nesting_has_no_limit(language, text):
    from quillstone.llm import docs

    assert syntax.parses(language, text)
    assert "y" not in docs.blank(language, text)[0]
    assert len(docs.blank(language, text)[0]) == len(text)


@pytest.mark.parametrize(("language", "text"), [("javascript", "let a = `${f({a: 1}`;"), ("javascript", "let a = `${a`;"), ("rust", "/* /* */ fn f() {}"), ("rust", 'fn f() { let a = r#####"x"####; }')])
def test_what_never_closes_is_invalid(language, text):
    assert not syntax.parses(language, text)


@pytest.mark.parametrize(
    ("language", "text", "valid"),
    [
        ("python", 'x = f"{a["x"]}"\n', True), ("python", 'x = f"{a["x"]!r:>{w}} {f"{b["y"]}"}"\n', True), ("python", "x = f'{a['x']}'\n", True), ("python", 'x = f"{a[}"\n', False), ("python", 'x = f"{a"\n', False),
        ("python", "f(a=1, 2)\n", False), ("python", "f(1, *a, b=2, *c, **d, e=3)\n", True), ("python", "f(**a, *b)\n", False), ("python", "f(x for x in y)\n", True), ("python", "f(x for x in y, 1)\n", False), ("python", "class A(B, metaclass=C):\n    pass\n", True),
        ("python", "def f(x=1, y): pass\n", False), ("python", "def f(a, b=1, /, c=2, *d, e, g=3, **h): pass\n", True), ("python", "def f(*): pass\n", False), ("python", "def f(*, a): pass\n", True), ("python", "def f(**a, b): pass\n", False), ("python", "g = lambda a=1, b: 0\n", False), ("python", "g = lambda *, a, **k: 0\n", True),
        ("python", "x = b'é'\n", False), ("python", "x = b'e'\n", True),
        ("typescript", "export function f(a: string): string\nexport function f(a: number): number\nexport function f(a: any): any { return a }\n", True), ("typescript", "function f(a: string): void\nfunction f(a: number): void\nfunction f(a: any) {}\n", True),
        ("typescript", "class A {\n  run(a: string): void\n  run(a: number): void\n  run(a: any) {}\n}\n", True), ("typescript", "class A {\n  run(a: string): string\n  run(a: number): number\n  run(a: any) { return a }\n}\n", True), ("typescript", "declare const x: number;\n", True),
        ("javascript", "const x;\n", False), ("javascript", "let let = 1;\n", False), ("javascript", "for (const x of y) {}\nconst a = 1, b = 2;\nlet z;\n", True),
        ("rust", "fn f<'a>(x: &'a str) -> impl Iterator<Item = u8> + use<'a> { x.bytes() }\n", True), ("rust", 'unsafe extern "C" { safe fn f(x: i32) -> i32; unsafe fn g(); pub safe static X: i32; }\n', True), ("rust", "fn safe() { let safe = 1; safe + 1; }\n", True),
    ],
)
def test_rules_of_the_languages(language, text, valid):
    assert syntax.parses(language, text) is valid


def test_elements_stand_only_where_the_extension_has_them(spark):
    text = "const a = <b>{c}</b>;\n"
    rows = [(i, "p", f"/x/{name}", text) for i, name in enumerate(["a.ts", "a.tsx", "a.js", "a.jsx"])]
    df = spark.createDataFrame(rows, "file_id bigint, project_id string, path string, content string")
    assert {r.file_id for r in syntax.syntax_found(df).collect()} == {0}


@pytest.mark.parametrize(("language", "text"), [("javascript", "x = " + "[" * 20_000 + "]" * 20_000 + ";\n"), ("go", "package a\n\nvar x = " + "(" * 5_000 + "1" + ")" * 5_000 + "\n")])
def test_deep_nesting_is_judged(language, text):
    assert syntax.verdict(language, text) is True
    assert syntax.verdict(language, text[:-3]) is False


def test_python_agrees_with_the_interpreter_on_mutated_files(sf):
    """Files with a token taken out, doubled or exchanged: the grammar says what ``ast.parse`` says, but for what is no matter of grammar."""
    import ast
    import random
    import re
    import warnings

    import duckdb

    r = random.Random(11)
    texts = [t for (t,) in duckdb.sql(f"select content from '{sf}/files.parquet' where path like '%.py' and content is not null order by file_id limit 40").fetchall()]
    checked = wrong = 0
    for text in texts:
        tokens = re.findall(r"\s+|\w+|.", text, re.S)
        for _ in range(40):
            t = list(tokens)
            i, j = r.randrange(len(t)), r.randrange(len(t))
            kind = r.randrange(3)
            if kind == 0:
                del t[i]
            elif kind == 1:
                t.insert(i, t[i])
            else:
                t[i], t[j] = t[j], t[i]
            mutated = "".join(t)
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(mutated)
                want = True
            except (SyntaxError, ValueError):
                want = False
            checked += 1
            wrong += syntax.parses("python", mutated) is not want
    assert checked >= 500
    assert wrong <= 0.01 * checked, (wrong, checked)
