import ast
import glob

import pytest

from kestrel.syntax import parse_text

VALID = {
    "python": [
        "def f(a, /, b: int = 1, *c, d, **e) -> int:\n    return [x async for x in y if x]\n", "x = lambda *a, b=1: (yield)\n", "with (open('a') as f, g()):\n    pass\n",
        "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': b, **c} | Foo(x=1):\n        pass\n", "a, *b = c = 1, 2\n", "@d\nasync def f():\n    await x\n", "if x:\n  pass\nelif y: pass\nelse:\n  pass\n",
        "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    del a[0], b.c\n", "x: int = 1\nx += yield_ if a else b\n", "print(f'{a}' 'b', r\"c\", b'' or 1)\n", "f(a for a in b)[1:2, ::3].c\n", "",
    ],
    "javascript": [
        "const {a, b: [c = 1], ...d} = x ?? y?.z[0];\n", "async function* f(a, {b} = {}, ...c) { for await (const x of y) yield* x }\n", "class A extends B { static #p = 1; get x() { return this.#p } static { f() } async *g() {} }\n",
        "export default async (a) => ({ a, [b]: 1, c() {}, get d() { return 1 } })\n", "label: for (let i = 0, n = 1; i < n; i++) { if (a) continue label; else break }\n", "const r = /[/\"']+/gi, t = `a ${b + `c`} d`\n",
        "return_ = a ? b : c, d\nfoo\n(bar)\n", "const e = <div className=\"x\" {...p}>it's {a ? <b/> : null}</div>;\n", "switch (a) { case 1: f(); break; default: g() }\n", "import a, { b as c } from 'd'; export * as e from 'f'\n",
    ],
    "typescript": [
        "export abstract class A<T extends B = C> implements D { private readonly x?: Map<string, number[]>; constructor(public a: string) { super() } abstract f(): void }\n",
        "type X<T> = { readonly [K in keyof T]?: T[K] } | ((a: number, ...b: string[]) => void) | [a: string, b?: number];\n", "function f<T>(this: Foo, a?: T): a is string { return a as unknown as string }\n",
        "enum E { A = 1, B }\ndeclare module 'm' { export function g(): Promise<void> }\n", "const g = async <T>(x: T): Promise<T> => x!;\nlet h = <any>y;\n", "interface I extends J<K> { (a: string): void; new (b: number): I; c(): void }\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tb \"c/d\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range 10 {\n\t\t_ = i\n\t}\n\tif v, ok := m[a]; !ok {\n\t\treturn 0, nil\n\t} else if v > 1 {\n\t\tgoto end\n\t}\nend:\n\tswitch y := z.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tselect {\n\tcase <-ch:\n\tcase ch <- 1:\n\t}\n\tgo func() { defer f() }()\n\treturn m2[T[int, string]{A: 1}.A](x), nil\n}\n",
        "package b\n\nvar x = map[string][]int{\"a\": {1, 2}}\nconst (\n\tA = iota\n\tB\n)\n\nfunc main() {\n\tx := 1\n\t*p = x\n}\n",
    ],
    "rust": [
        "use a::{b as c, d::*};\n#[derive(Debug)]\npub struct A<'a, T: B + 'a>(pub &'a mut T) where T: C;\nimpl<'a, T> D for A<'a, T> where T: B {\n    type X = Vec<Option<T>>;\n    fn f(&mut self, x: impl Fn(u8) -> u8) -> Result<(), Box<dyn E>> {\n        let Some(y) = x.g::<Vec<_>>()? else { return Err(e.into()) };\n        if let Ok(z) = w && z > 1 { z += 1; }\n        match a { B::C { d, .. } | E(1..=5, _) if d => f!(d), x @ 'a'..='z' => {} _ => () }\n        for (i, v) in (0..10).rev().enumerate() {}\n        let c = move |a, b: u8| -> u8 { a + b as u8 };\n        S { a: 1, ..Default::default() };\n        'l: loop { break 'l 5 }\n    }\n}\nmacro_rules! m { ($x:expr) => { $x } }\n",
    ],
    "java": [
        "package a.b;\nimport static c.D.*;\n@A(b = {1, 2}, c = \"x\")\npublic sealed abstract class X<T extends Y & Z> extends W<T[]> implements V permits U {\n  enum E { A(1) { int f() { return 1; } }, B; E(int... x) {} }\n  record R(int a, List<? super T> b) { R { if (a < 0) throw new F(); } }\n  static { x = 1; }\n  <K> Map<K, int[]> m(final K k) throws G {\n    for (var e : x.entrySet()) { int[] y = {1, 2}; y[0] >>>= 2; }\n    String s = switch (k) { case A, B -> \"a\"; case Circle(var r) when r > 1 -> { yield \"b\"; } default -> throw new H(); };\n    Runnable q = () -> {}; Function<A, B> g = (a) -> (B) a.c(); Supplier<int[]> h = int[]::new;\n    try (var r = f(); s2) { } catch (I | J e) { } finally { }\n    if (o instanceof String t && t.length() > 1) return (int) -1;\n    return new HashMap<>() {{ put(1, 2); }};\n  }\n}\n",
    ],
}
BROKEN = {
    "python": ["def f(:\n  pass\n", "x = (1,\n", "<<<<<<< HEAD\nx = 1\n=======\n", " x = 1\ny\n", "f() = 1\n", "if x:\n", "else:\n  pass\n", "'abc\n", "const x = 1;\n", "@a\nx = 1\n", "try:\n    pass\nx = 1\n"],
    "javascript": ["function f( {", "const x;", "<<<<<<< HEAD\n", "let a = ;", "f(a: string)", "class A { x = }", "}", "if (a { }", "interface A { b: c }", "'abc\n'", "import { a from 'b'"],
    "typescript": ["type X = ;", "let x: = 1", "<<<<<<< a\n", "class { ", "def f():\n  pass"],
    "go": ["func f() {}", "package a\nfunc f( {\n}\n", "package a\nx := 1\n", "package a\nfunc f() {\n\ta b\n}\n", "package a\n<<<<<<< HEAD\n", "package a\nfunc f() {\n"],
    "rust": ["fn f() { let x = ; }", "fn f( {}", "<<<<<<< HEAD\nfn f() {}\n", "x = 1;", "fn f() { a b }", "struct A { b }", "fn f() {"],
    "java": ["class A { void f() { int = 1; } }", "x = 1;", "class A {", "<<<<<<< ours\nclass A {}\n", "class A { void f( { } }", "package a; def f():"],
}


@pytest.mark.parametrize("language", VALID)
def test_accepts(language):
    for text in VALID[language]:
        assert parse_text(text, language).errors == [], text


@pytest.mark.parametrize("language", BROKEN)
def test_rejects(language):
    for text in BROKEN[language]:
        assert parse_text(text, language).errors, text


def test_python_parser_agrees_with_the_interpreter():
    import os

    import kestrel

    root = os.path.dirname(os.path.dirname(kestrel.__file__))
    texts = [open(f, encoding="utf-8").read() for f in glob.glob(f"{root}/kestrel/**/*.py", recursive=True)] + [open(ast.__file__, encoding="utf-8").read()]
    for t in texts:
        assert parse_text(t, "python").errors == []


def test_every_error_is_kept_and_recovery_goes_on():
    x = parse_text("let a = ;\nfunction ok() { return 1 }\nlet b = );\n", "javascript")
    assert len(x.errors) >= 2 and [n.name for n in x.top] == ["ok"]


def test_deep_nesting_is_no_error():
    assert parse_text("x = " + "(" * 3000 + "1" + ")" * 3000 + "\n", "python").errors == []
    assert parse_text("x = " + "[" * 3000 + "]" * 3000 + ";", "javascript").errors == []


def test_exact_ranges():
    t = "x = 1\n\n@d\ndef café(a):\n    return a\n"
    n = parse_text(t, "python")
    f = n.top[0]
    assert f.name == "café" and t[n.src.offset(f.start) : n.src.end_offset(f.end)] == "def café(a):\n    return a"
