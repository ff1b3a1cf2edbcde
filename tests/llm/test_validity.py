import ast
import json
import random
import warnings

import pytest

from codeseam.llm import validity as V
from codeseam.llm.parse.py import Python

GOOD = {
    "js": "import a, { b as c } from './x.js';\nexport default async function* f({ a = 1, ...r }, [b]) { for await (const x of y) yield x?.[0] ?? `t${a + `n${b}`}`; }\nlabel: for (;;) { continue label }\nconst r = /a[/]b/g, d = a / b / c, o = { get x() { return 1 }, async *g() {}, [k]: 2, 'q': 3 };\nclass A extends B { #p = 1; static { } get v() { return this.#p } }\n({ a, b } = o); x ||= 1; a = b\n++c",
    "jsx": "const a = <div className='x' {...p}>it's {ok ? <b>1</b> : null} <></> text</div>;",
    "ts": "interface A<T extends object = {}> extends B { readonly x: number; [k: string]: any; m<U>(a: U): void }\ntype M = { readonly [K in keyof T]?: T[K] };\nabstract class K<T> implements I { constructor(private x: string, public y?: number) { super() } abstract f(): void; }\nconst g = <T,>(x: T): x is string => f<string>(x as unknown) satisfies B;\nenum E { A = 1 }\ndeclare module 'x' { export const y: number; }\nlet t = a < b && c > d, n = x! >> 2;",
    "tsx": "const g = <T,>(x: T) => <p>{x}</p>;",
    "py": "from .a import (b, c as d,)\n@dec\nasync def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    async with x as y, z:\n        return [i async for i in a if (n := i) > 1]\nmatch p:\n    case {'a': [1, *r], **k} | A(b=2) if r:\n        pass\nx = f'{a!r:>{w}} {b[\"k\"]} {{}}'\nlambda *a, k=1: (yield)\n",
    "go": "package main\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\ntype T[K comparable, V any] struct {\n\tsync.Mutex\n\ta, b int `j:\"a\"`\n}\nfunc (t *T[K, V]) M(k K) (v V, ok bool) {\n\tif x, ok := m[k]; ok && !v {\n\t\treturn\n\t} else {\n\t\tswitch y := z.(type) {\n\t\tcase int, *T:\n\t\tdefault:\n\t\t}\n\t}\n\tp := []P{{1, 2}, {X: 3}}\n\tgo func() { ch <- <-in }()\n\tfor i := range 10 {\n\t}\n\treturn G[int](1, p...)\n}\n",
    "java": "package a.b;\nimport static c.D.*;\n@An(x = {1, 2}) public sealed abstract class A<T extends B & C> extends D implements E permits F {\n  static { int[] a = {1, 2}; }\n  enum K { X(1) { void f() {} }, Y; K(int... a) {} }\n  record R(int x, String... y) { R { } }\n  <U> List<? super U> m(final int a, Map<String, List<int[]>> b) throws X {\n    for (var e : b.entrySet()) if (e instanceof Map.Entry<?, ?> z && z != null) continue;\n    var s = switch (a) { case 1, 2 -> \"\"\"\n      t\"\"\"; default -> { yield (String) o; } };\n    Runnable r = () -> this.<U>m(a, (x, y) -> x >>> 2, A::new);\n    try (var q = f(); g) { } catch (X | Y e) { } finally { }\n    return new int[3][];\n  }\n}\n",
    "c": '#include <a.h>\n#define X(a) \\\n  (a)\ntypedef struct node { int x : 3; struct node *next; } node_t;\nstatic const char *names[] = { [0] = "a" "b", };\nint (*fp)(int, const char *, ...);\nstatic int f(size_t n, node_t *p) {\n  node_t *q = (node_t *)p->next, r = { .x = 1 };\n  for (int i = 0; i < (int)sizeof(node_t); i++) { if (!q) goto out; else q->x += (n & 1) ? 2 : *fp(1, "x"); }\n  switch (n) { case 1: default: break; }\nout:\n  return n;\n}\n',
    "json": '{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}',
}
BAD = {
    "js": ["let x = ;", "foo(1,,2)", "function f( { }", "`abc", "x = 'abc", "return 1", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "let a: number = 1;", "import x from y", "if x {}", "a b", "1 = 2", "const x", "x = “a”", "with (a) {}", "{ export let a }", "let a = 08"],
    "jsx": ["const a = <div><b></div>;", "const a = <div;"],
    "ts": ["let x: = 1", "class A { foo( }", "interface { }", "type X =", "def f():\n  pass", "let a = <div></div>;"],
    "py": ["def f(:\n  pass", "if x\n  y", "x = (1", "def f():\nreturn 1", "a b", "'abc", '"""abc', "x = 1\n  y = 2", "f(a=1, b)", "1 = x", "f'{a b}'", "x = 0777", "print 'a'", "import { a } from 'b'", "x = 1\0"],
    "go": ["package a\nx := 1", "func f() {}", "package a\nfunc f() { x = = 1 }", "package a\nfunc f() {\n if x\n {\n }\n}", "package a\nfunc f(a int b int) {}", "package a\nvar x = \"abc", "package a\nfunc f() { foo(1,,2) }", "package a\nfunc f() { for i := 0; i < 3 { } }"],
    "java": ["class A { void f( { } }", "class A { int x = 1 }", "class A { void f() { int x = ; } }", "int x;", "class A {", "class A { void f() { x + 1; } }", "class A { String s = \"a; }", "func f() {}"],
    "c": ["int f( { }", "int x = ;", "int f() { return 1 }", "#if X\nint y;", "int f() { foo(1,,2); }", "char *s = \"abc;", "def f():\n  pass", "class A { public: int x; };", "int f() {"],
    "json": ["{'a': 1}", '{"a": 1,}', "[1 2]", '{"a" 1}', "// c\n{}", '"a\nb"', "[01]", "NaN", "{} {}", "\f{}"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_good(ext):
    assert V.faults(GOOD[ext], ext) == []
    assert V.faults("﻿" + GOOD[ext].replace("\n", "\r\n"), ext) == []


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_bad(ext, text):
    assert V.faults(text, ext)


def test_python_agrees_with_the_interpreter():
    def accepts(text):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text)
            except (SyntaxError, ValueError):
                return False
        return True

    random.seed(4)
    for source in (GOOD["py"], open(V.__file__).read(), open(ast.__file__).read()[:6000].rpartition("\ndef ")[0]):
        assert not Python(source).check()
        for _ in range(150):
            i = random.randrange(len(source))
            text = random.choice([source[:i] + source[i + 1 :], source[:i], source[:i] + random.choice("()[]{}:,\"'=") + source[i:]])
            assert accepts(text) == (not Python(text).check()), text[max(0, i - 40) : i + 40]


def test_json_agrees_with_the_library():
    random.seed(6)
    source = json.dumps({"a": [1, 2.5, None, {"b": "c\n"}], "d": True, "e": -1e9}, indent=1)
    for _ in range(500):
        i = random.randrange(len(source))
        text = random.choice([source[:i] + source[i + 1 :], source[:i] + random.choice('{}[],:"1 ') + source[i:]])
        try:
            json.loads(text)
            good = True
        except ValueError:
            good = False
        assert good == (V.faults(text, "json") == []), text


def test_recovery_stores_later_faults():
    text = "function a() {\n  let x = ;\n}\nfunction b() {\n  foo(;\n}\nlet ok = 1;\n"
    found = V.faults(text, "js")
    assert [f.line for f in found][0] == 2 and any(f.line == 5 for f in found)


@pytest.mark.parametrize(("ext", "text"), [("py", "(" * 5000), ("js", "x=" + "(" * 20000), ("go", "package a\nvar x = " + "(" * 60 + "+" + ")" * 60), ("java", "class A { int x = " + "(a)(" * 60 + "; }"), ("json", "[" * 100_000)])
def test_deep_nesting_ends(ext, text):
    assert V.faults(text, ext)


def test_operator(spark):
    ddl = "file_id string, index_id string, path string, content string, faults string, language string"
    rows = [("1", "i", "a.PY", "x = (", None, None), ("1", "i", "a.PY", "x = (", None, None), ("2", "i", "a.py", "x = 1\n", None, None), ("3", "j", "b.go", "", None, None), ("4", None, "c.json", None, None, None), ("5", "i", None, "x", None, None), ("6", "i", "x.md", "(", None, None), ("7", "i", "d.h", "int x", None, None)]
    out = V.check_syntax(spark.createDataFrame(rows, ddl))
    by = {r["file_id"]: r for r in out.collect()}
    assert set(by) == {"1", "2", "3", "4", "7"} and out.count() == 5
    assert by["1"]["language"] == "python" and by["1"]["first_line"] == 1 and by["1"]["n_faults"] == len(by["1"]["faults"]) > 0
    assert by["2"]["n_faults"] == by["3"]["n_faults"] == by["4"]["n_faults"] == 0 and by["7"]["first_cause"]
    idx = spark.createDataFrame([("i", "/r"), ("i", "/r"), ("j", "/s")], "id string, repo_root string")
    rates = {(r["repo_root"], r["language"]): r for r in V.broken_rates(out, idx).collect()}
    assert rates["/r", "python"]["rate"] == 0.5 and rates["/r", "python"]["language_acceptance"] == 0.5 and rates[None, "json"]["files"] == 1
    assert V.check_syntax(spark.createDataFrame([], ddl)).count() == 0
