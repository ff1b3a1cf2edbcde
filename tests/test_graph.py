import random

from codeseam.operators import extract, graph

EDGE = "index_id string, from_path string, to_path string, type string, confidence double"


def brute(edges, start, types, depth, direction):
    steps = []
    for _, a, b, t, c in edges:
        if types is None or t in types:
            steps += [(a, b, t, c)] * (direction != "in") + [(b, a, t, c)] * (direction != "out")
    best = {}

    def walk(node, seen, hops):
        if hops == depth:
            return
        for a, b, t, c in steps:
            if a == node and b not in seen:
                old = best.get((b, t), (99, 0.0))
                best[b, t] = (min(old[0], hops + 1), max(old[1], c))
                walk(b, seen | {b}, hops + 1)

    walk(start, {start}, 0)
    return best


def test_neighbors_against_all_simple_paths(spark):
    random.seed(12)
    nodes = "abcdefg"
    edges = [("i", random.choice(nodes), random.choice(nodes), random.choice(["calls", "imports", "tests"]), random.choice([0.1, 0.5, 0.9])) for _ in range(22)]
    df, starts = spark.createDataFrame(edges, EDGE), spark.createDataFrame([("i", n) for n in "abx"] + [("other", "a")], "index_id string, start string")
    for types, depth, direction in [(None, 1, "both"), (None, 2, "out"), (["calls", "imports"], 3, "both"), (None, 3, "in"), (None, 9, "both")]:
        rows = graph.neighbors(df, starts, types, depth, direction).collect()
        for s in "abx":
            got = {(r["path"], r["edge_type"]): (r["hops"], r["confidence"]) for r in rows if r["start"] == s}
            assert got == brute(edges, s, types, min(depth, 3), direction), (s, types, depth, direction)
        assert all(r["index_id"] == "i" for r in rows)


def test_self_edges_are_never_walked(spark):
    s = spark.createDataFrame([("1", "i", "a", True), ("2", "i", "a", False)], "id string, index_id string, path string, exported boolean")
    e = graph.symbol_edges(s)
    assert sorted(r["type"] for r in e.collect()) == ["belongs_to", "belongs_to", "defines", "defines", "exports"]
    assert graph.neighbors(e, spark.createDataFrame([("i", "a")], "index_id string, start string")).count() == 0


def test_imports_resolve_to_the_first_candidate(spark):
    files = spark.createDataFrame([("i", "src/b.ts"), ("i", "src/b.tsx"), ("i", "src/lib/index.ts"), ("i", "src/b.test.ts")], "index_id string, path string")
    imports = spark.createDataFrame([("i", "src/a.ts", s) for s in ("./b.js", "./lib", "react", "./none")], "index_id string, path string, spec string")
    assert {r["spec"]: r["to_path"] for r in graph.resolve_imports(imports, files).collect()} == {"./b.js": "src/b.ts", "./lib": "src/lib/index.ts"}
    assert [(r["from_path"], r["to_path"]) for r in graph.test_edges(files).collect()] == [("src/b.test.ts", "src/b.ts")]


def test_impact(spark):
    edges = [("i", "app.ts", "core.ts", "imports", 0.9), ("i", "app.ts", "core.ts", "calls", 0.7), ("i", "tests/app.ts", "app.ts", "calls", 0.7), ("i", "core.ts", "util.ts", "imports", 0.9), ("i", "core.test.ts", "core.ts", "tests", 0.8)]
    rows = graph.impact(spark.createDataFrame(edges, EDGE), spark.createDataFrame([("i", "core.ts")], "index_id string, start string")).collect()
    of = lambda kind: {(r["path"], r["edge_type"], r["hops"], r["confidence"], r["confidence_label"]) for r in rows if r["relation"] == kind}
    assert of("caller") == {("app.ts", "imports", 1, 0.9, "high"), ("app.ts", "calls", 1, 0.7, "medium"), ("tests/app.ts", "calls", 2, 0.7, "medium")}
    assert of("callee") == {("util.ts", "imports", 1, 0.9, "high")}
    assert of("affected_test") == {("core.test.ts", "tests", 1, 0.8, "high"), ("tests/app.ts", "tests", 2, 0.6, "medium")}


def test_resolve_symbol(spark):
    s = spark.createDataFrame([("1", "i", "b", "open", "function", None, 5, 6), ("2", "i", "a", "open", "function", None, 9, 9), ("3", "i", "a", "reopen", "function", None, 1, 1), ("3", "i", "a", "reopen", "function", None, 1, 1)], "id string, index_id string, path string, name string, kind string, signature string, start_line int, end_line int")
    ask = lambda *w: spark.createDataFrame([("i", x) for x in w], "index_id string, wanted string")
    assert {(r["wanted"], r["id"], r["exact"]) for r in graph.resolve_symbol(s, ask("open", "reop", "none")).collect()} == {("open", "1", True), ("open", "2", True), ("reop", "3", False)}
    assert [r["id"] for r in graph.resolve_symbol(s, ask("open"), most=1).collect()] == ["2"]


def test_extraction(spark):
    ts = "import { a, b as c } from './x.js';\nimport D from './d';\n// call a()\nexport function run(s: string) {\n  a('}');\n  c.go();\n}\nexport class K {\n  run() { return D(); }\n}\nconst local = 1;\n"
    got = {(n, k, first, last, e) for n, k, _, first, last, e in extract.symbols_of(ts, "typescript")}
    assert {("run", "function", 4, 7, True), ("K", "class", 8, 10, True), ("run", "method", 9, 9, False), ("local", "constant", 11, 11, False)} <= got
    assert set(extract.relations_of(ts, "typescript")) == {("imports", "./x.js", None, None), ("imports", "./d", None, None), ("calls", "./x.js", "a", "a"), ("references", "./x.js", "c", "c"), ("calls", "./d", "D", "D")}
    assert {(s[0], s[1], s[3], s[4]) for s in extract.symbols_of("class A:\n  def f(self):\n    pass\n\ndef g(): ...\n", "python")} == {("A", "class", 1, 3), ("f", "function", 2, 3), ("g", "function", 5, 5)}
    broken = "def f(:\n    pass\n\n    x\ny = (\nclass _B:\n    async def g(self):\n        z\n"
    assert {(s[0], s[1], s[3], s[4], s[5]) for s in extract.symbols_of(broken, "python")} == {("f", "function", 1, 4, True), ("_B", "class", 6, 8, False), ("g", "function", 7, 8, True)}
    assert extract.symbols_of("", "python") == [] and extract.symbols_of("x", "markdown") == []
    assert {(s[0], s[1], s[5]) for s in extract.symbols_of("package a\ntype T struct {\n}\nfunc (t *T) Get() int {\n\treturn 1\n}\nfunc help() {\n}\n", "go")} == {("T", "class", True), ("Get", "method", True), ("help", "function", False)}
    java = "public class A {\n  public static Map<String, int[]> of(List<String> x) throws E {\n    return make(x);\n  }\n  int[] raw(int a);\n  A() {}\n}\n"
    assert {(s[0], s[1], s[3], s[4], s[5]) for s in extract.symbols_of(java, "java")} == {("A", "class", 1, 7, True), ("of", "method", 2, 4, True), ("raw", "method", 5, 5, False)}
    ddl = "file_id string, index_id string, path string, language string, content string"
    files = spark.createDataFrame([("1", "i", "src/a.ts", "typescript", ts), ("2", "i", "src/x.ts", None, "export const a = 1;"), ("3", "i", "src/d.ts", None, None), ("4", "i", "src/a.test.ts", None, "")], ddl)
    edges = {(r["from_path"], r["to_path"], r["type"], r["confidence"]) for r in extract.file_edges(files).collect()}
    assert edges >= {("src/a.ts", "src/x.ts", "imports", 0.9), ("src/a.ts", "src/x.ts", "calls", 0.7), ("src/a.ts", "src/x.ts", "references", 0.6), ("src/a.test.ts", "src/a.ts", "tests", 0.8)}
