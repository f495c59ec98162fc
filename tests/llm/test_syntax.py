import ast
import json
import random
import warnings

import pytest

from sievewright.llm.parsing import errors_of, parse_files, rates

GOOD = {
    "java": [
        "", "package a.b; import static x.Y.*; import z.Q;\nclass A<T extends B & C> extends D implements E {}",
        "class A { int[] a = {1, 2}, b[] = new int[3][]; static { x(); } A() { this(1); } <T> T f(final T... t) throws E { return (T) t[0]; } abstract void g(); }",
        "enum E { A(1) { void f() {} }, B; int x; } interface I { default int f() { return 1; } } @interface N { int v() default 1; } record R(int a) { R { } }",
        "class A { void f() { for (var x : xs) { if (a < b && c > d) continue; } List<Map<String, int[]>> l = new ArrayList<>() {{ add(null); }}; Runnable r = () -> {}; f(x -> x + 1, A::new, int[]::clone); i >>>= 2; a = b ? c : d; } }",
        "class A { int f(Object o) { return switch (o) { case String s -> 1; case Integer i when i > 2 -> { yield 3; } default -> throw new X(); }; } }",
        "class A { void f() { try (var a = b(); c) { } catch (X | Y e) { } finally { } label: do { break label; } while (true); synchronized (this) { } assert a : b; int x = (int) -1; y = (x) + 1; String t = \"\"\"\n a \"b\" \\n\n\"\"\"; char c = '\\''; } }",
    ],
    "cs": [
        "", "using System; using static A.B; using X = Y<int>; namespace N; [A(1, B = 2)] public sealed class C<T> : D, E where T : class, new() { }",
        "namespace N { class C { private readonly int _x = 1; public int P { get; private set; } = 2; public int Q => _x; event Action E; C(int a) : base(a) { } ~C() { } public static C operator +(C a, C b) => a; int this[int i] { get { return i; } } } }",
        "class C { async Task<int> F(int? a = null, params string[] b) { await foreach (var x in y) { } using var z = W(); if (o is string { Length: > 2 } s && s is not null) return 1; var q = from a in b where a > 1 orderby a descending select new { a, B = 2 }; lock (this) { } return x switch { 1 => 2, _ => throw new E() }; } }",
        "class C { void F() { var s = $\"{a:0.00} {{}} {b ?? \\\"\\\"}\"; }".replace('\\"\\"', "c") + " void G() { var v = @\"a\"\"b\\\"; var l = new List<int> { 1, 2 }; var d = new() { [1] = 2 }; (int a, var b) = (1, 2); x?.y?[0]?.Z(); a ??= b; F(out var o, ref p, name: 1); Func<int, int> f = static x => x * 2; int[] r = [1, ..q]; var k = a[^1..]; } }",
        "#region r\nclass C { }\n#endregion\n#pragma warning disable",
    ],
    "js": [
        "", "import a, { b as c } from './x.js';\nimport * as d from \"y\"\nexport default class extends A { #p = 1; static x; get y() { return this.#p } async *z() { yield* q } static { } }",
        "const { a, b: [c = 1, ...d], ...e } = f\nlet g = async (x) => { await y; }\nfor (const [k, v] of Object.entries(o)) if (k) continue\nlabel: while (1) { break label }",
        "var r = /[/\\]]+\\/x/gi.test(s) ? a / b / c : `t ${x + `n ${y}`} u`; x ??= y?.[z]?.(w) ?? 2 ** -1; delete o.p, void 0; new (f())(1); if (a) b; else c\nfunction* g() { const x = yield; return }",
        "!function(e){var t,n=e.x;for(var i in n)t=n[i];switch(t){case 1:break;default:throw new Error(\"x\")}try{a()}catch{b()}finally{c()}}(window||{});",
        "#!/usr/bin/env node\nexport const f = (a, { b } = {}, ...c) => ({ a, b, [c]: 1, get d() { return 1 }, async e() {} })",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "[]", "1", ' "x" '],
    "py": ["", "import a.b as c, d\nfrom . import (x, y as z,)\n", "@d\nasync def f(a, /, b: int = 1, *, c, **k) -> int:\n    async with x as y, z:\n        await q\n    return [i async for i in r if i]\n", "match x:\n    case [1, *_] | {'a': b} if b:\n        pass\n    case C(d=1): pass\n", "x = f'{a!r:>{w}} {{}}' f\"{b['c']}\"\nif (n := 1) > 0: y[1:2, ...] = lambda *a: a\nelse:\n\tz += 1\n", "type A[T] = list[T]\ntry:\n    pass\nexcept* E as e:\n    raise X from e\n"],
}
BAD = {
    "java": ["class A {", "class A { int f() { return 1 } }", "class A { void f() { 1 + 2; } }", "class A { void f() { foreach (int x in y) { } } }", "class A { void f() { try { } } }", "class A { int = 3; }", "<<<<<<< HEAD\nclass A { }", "class A { char c = 'ab'; }", "class A { String s = \"x; }", "def f(): pass", "class A { g() { } }"],
    "cs": ["class C {", "class C { int F() { return 1 } }", "package a.b;\nclass C { }", "class C { void F() { final var x = 1; } }", "class C { void F() { a b c; } }", "#region x\nclass C { }", "class C { void F() { if x { } } }", "class C { string s = \"a; }"],
    "js": ["function f( {", "let x = ;", "const a", "a b", "import x from y", "return 1", "if (a) else", "f() = 1", "{ \"a\": 1, \"b\": 2 }", "var s = 'x\n'", "class A { f( }", "def f():\n  pass", "`${a`"],
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", "[1 2]", "01", '{"a" 1}', "true false", '"\t"', "// c\n1", "NaN"],
    "py": ["def f(:\n  pass", "if x\n  y", "  x = 1", "if x:\ny", "x = (1", "f() = 1", "a b", "try:\n    pass\n", "def f():\n    x\n  y\n", "'abc", "x = 01", "f(a=1, b)", "class A:\n", "f'{a'", "else:\n    pass\n", "@d\nx = 1\n", "x = b'a' 'b'"],
}


@pytest.mark.parametrize("extension", sorted(GOOD))
def test_valid(extension):
    for text in GOOD[extension]:
        assert errors_of(text, extension) == [], text
        assert errors_of("\ufeff" + text.replace("\n", "\r\n"), extension) == [] or "'\\u" in text


@pytest.mark.parametrize("extension", sorted(BAD))
def test_invalid(extension):
    for text in BAD[extension]:
        assert errors_of(text, extension), text


def test_against_the_standard_parsers():
    import pathlib

    from sievewright.llm.python_syntax import Python

    random.seed(5)
    sources = [p.read_text() for p in sorted(pathlib.Path(__file__).parents[2].rglob("*.py")) if "llm" in str(p)]
    for text in sources:
        assert not Python(text).check()
    for text in sources * 12:
        i = random.randrange(len(text))
        broken = text[:i] + random.choice(["", "(", "}", ":", "'", "\n", " ", "="]) + text[i + random.randint(0, 3) :]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(broken)
                ok = True
            except SyntaxError:
                ok = False
        assert bool(Python(broken).check()) != ok, broken[max(0, i - 60) : i + 60]
    for text in ['{"a": [1, {"b": null}], "c": "d"}'] * 300:
        i = random.randrange(len(text))
        broken = text[:i] + random.choice(['"', "{", "]", ",", "", "1", "x"]) + text[i + random.randint(0, 2) :]
        try:
            json.loads(broken)
            ok = True
        except ValueError:
            ok = False
        assert (not errors_of(broken, "json")) == ok


def test_all_errors_and_first_cause():
    found = errors_of("class A {\n  void f() { int x = ; }\n  void g() { y( ; }\n  int z;\n}\n", "java")
    assert [line for line, _ in found] == [2, 3] and "unexpected ;" in found[0][1]


def test_errors_beyond_the_first_many():
    lines = list(range(2, 62))
    assert [a for a, _ in errors_of("class A {\n" + "  void f() { int x = ; }\n" * 60 + "}\n", "java")] == lines
    assert [a for a, _ in errors_of("class A {\n" + "  void F() { int x = ; }\n" * 60 + "}\n", "cs")] == lines
    assert [a for a, _ in errors_of("{\n" + "  let x = ;\n" * 60 + "}\n", "js")] == lines
    assert [a for a, _ in errors_of("if 1:\n" + "    x = = 1\n" * 60, "py")] == lines
    assert [a for a, _ in errors_of("[\n" + '  {"a" 1, "b": 2},\n' * 60 + "  3\n]\n", "json")] == lines
    deep = "class A { void f() " + "{ " * 130 + "} " * 130 + "\n"
    assert [a for a, _ in errors_of(deep + "  void g() { int x = 1; { int y = ; } }\n}\n", "java")] == [2]


def test_bare_assignment_expression():
    assert errors_of("x := 1\n", "py") and not errors_of("(x := 1)\nwhile a := b:\n    f(y := 2)\n", "py")


def test_recovery_of_json():
    for text, n in (('{"a": 1,}', 1), ("[1 2, 3 4]", 2), ('{"a": [1, 2}', 1), ('{"a": [1, 2, "b" 3}', 1), ('{"a": 1}, {"b": 2}', 1), ('[{"a" 1}, {"b": }, [,], {c: 1}]', 5), ('[1 {"a" 2}]', 2), ('{"a" 1', 2), ("[" * 50_000 + "}" * 50_000, 2), ("]", 1)):
        assert len(errors_of(text, "json")) == n, (text[:60], errors_of(text, "json")[:9])


def test_deep_nesting_ends():
    for ext, text in (("java", "class A { int x = " + "(" * 3000 + ")" * 3000 + "; }"), ("js", "[" * 4000), ("py", "(" * 500 + ")" * 500), ("json", "[" * 100_000 + "]" * 100_000)):
        errors_of(text, ext)


def test_table(spark, empty):
    schema = "file_id long, file_path string, text string, repo string, language string, errors int"
    rows = [(1, "a/x.JAVA", "class A {", "r", None, 1), (2, "a/y.py", "", "r", None, 1), (3, "a/z.json", "", None, None, 1), (4, "a/w.md", "{", "r", None, 1), (5, None, "x", "r", None, 1), (6, "v.py", None, "r", None, 1), (1, "a/x.JAVA", "class A {", "r", None, 1), (7, "u.js", "x = 1;\n" * 20_000, "r", None, 1)]
    df = spark.createDataFrame(rows, schema)
    got = parse_files(df).collect()
    assert sorted((r["file_id"], r["accepted"]) for r in got) == [(1, False), (1, False), (2, True), (3, False), (7, True)]
    assert all(r["n_errors"] == len(r["errors"]) for r in got)
    by = {(r["repo"], r["language"]): (r["n_files"], r["n_rejected"], r["share"]) for r in rates(df).collect()}
    assert by["r", "Java"] == (2, 2, 1.0) and by[None, "JSON"] == (1, 1, 1.0)
    assert parse_files(empty(schema)).count() == 0 and rates(empty(schema)).count() == 0
