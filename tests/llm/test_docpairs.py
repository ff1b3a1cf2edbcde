import pytest
from pyspark.sql import functions as F

from codeseam.llm import docpairs as D

TELLS = [
    ("/** Reads the next row and skips blank ones. */", "nextRow"),
    ("// Keeps lazy drafts lonely, never bare.", "freezeLock"),
    ("/**\n * TODO: cover the slow path.\n * Merges two ranges into the wider one.\n */", "merge"),
    ('"""parse_line splits a record at its tabs.\n\n    :param x: y\n    """', "parse_line"),
    ("// Region next to a meter is even.", "update"),
    ("# Объединяет две строки в одну.", "join"),
    ("/** 夜间，预览会排序整个批次。 */", "sortBatch"),
]
DOES_NOT = [
    ("", "x"),
    (None, "x"),
    ("/**\n *\n */", "x"),
    ("/** computeBranchPreview function. */", "computeBranchPreview"),
    ("/** Computes the branch preview. */", "computeBranchPreview"),
    ("// Publishes the current jetty.", "publish_current_jetty"),
    ("/**\n * @param a\n * @returns {void}\n */", "x"),
    ('""":param a:\n:return:\n"""', "x"),
    ("// TODO(dev-48): write this", "x"),
    ("No description provided.", "x"),
    ("// eslint-disable-next-line no-unused-vars", "x"),
    ("# noqa: E501", "x"),
    ("/* SPDX-License-Identifier: MIT */", "x"),
    ("/** Copyright (c) 2020 the authors. All rights reserved. */", "x"),
    ("// const dirty = store.send(a.b());", "x"),
    ("# total := a.walk(b[3])", "x"),
    ("// =====================", "x"),
    ("/** {@inheritDoc} */", "x"),
]


@pytest.mark.parametrize(("doc", "name"), TELLS)
def test_tells(doc, name):
    assert D.tells(doc, name)


@pytest.mark.parametrize(("doc", "name"), DOES_NOT)
def test_does_not_tell(doc, name):
    assert not D.tells(doc, name)


CAPTURES = [
    ("a.ts", "/** d */\nexport function f(a: string): void {\n  const s = \"}\"; // }\n  if (a) { `${'}'}` }\n}\nlet y = 1", 2, 5),
    ("a.js", "const g = (x) => {\n  return { a: '{' };\n};\nfoo()", 1, 3),
    ("a.go", "// d\nfunc (s *T) f(a int) (int, error) {\n\tx := '{'\n\treturn 1, nil\n}\nfunc g() {}", 2, 5),
    ("A.java", "class A {\n  @Override\n  public int f(List<String> x) {\n    return \"}\".length();\n  }\n}", 2, 5),
    ("a.c", "static char *f(const char *p) {\n  /* } */\n  return p;\n}\nint g;", 1, 4),
    ("a.py", "@dec\ndef f(a, b=')'):\n    '''doc: (\n}'''\n    x = [\n1]\n    return x\n\ny = 2", 1, 7),
]


@pytest.mark.parametrize(("path", "text", "first", "last"), CAPTURES)
def test_capture(path, text, first, last):
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
    got = D.capture(text, starts, first, last, path.endswith(".py"))
    assert got.whole and got.code.rstrip(";") == "\n".join(text.split("\n")[first - 1 : last]).rstrip(";")


COMMENTS = [
    ("a.ts", "let x;\n/**\n * Reads rows.\n */\n@dec()\nexport function f(a) {\n}\n", 6, "/**\n * Reads rows.\n */"),
    ("a.ts", "let x; /* not this */\nfunction f(a) {\n}\n", 2, ""),
    ("a.ts", "// far away\n\nfunction f(a) {\n}\n", 3, ""),
    ("a.go", "// Reads\n// rows.\nfunc f() {\n}\n", 3, "// Reads\n// rows."),
    ("A.java", "interface A {\n  /** Reads rows. */\n  int f(int a);\n  int g();\n}", 3, "  /** Reads rows. */"),
    ("a.py", "class A:\n    # above\n    @dec\n    def f(self, a=':'):\n\n        r\"\"\"Reads rows: (\n        all.\"\"\"\n        return a\n", 4, '\"\"\"Reads rows: (\n        all.\"\"\"'),
    ("a.py", "# Reads rows.\ndef f():\n    return 1\n", 2, "# Reads rows."),
]


@pytest.mark.parametrize(("path", "text", "first", "comment"), COMMENTS)
def test_comment_is_part_of_the_capture(path, text, first, comment):
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
    got = D.capture(text, starts, first, first + 1, path.endswith(".py"))
    assert got.whole and got.comment == comment


@pytest.mark.parametrize("text", ["function f" + "(" * 30_000, "function f(a) {" + "{" * 20_000, "const f = " + "a => " * 20_000 + "(", "function f(a) { '" * 3_000, "/*" * 50_000, "def f(" + "[" * 20_000, "def f():\n" + "    x = [\n" * 5_000])
def test_broken_texts_are_given_up_by_their_form(text):
    for indented in (False, True):
        starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
        assert D.capture(text, starts, 1, 1, indented).code


def test_operator(spark):
    s_ddl = "id string, file_id string, path string, name string, kind string, signature string, start_line int, end_line int, doc string, symbols string, content string"
    text = "// Adds a row and counts it.\nfunction add(a) {\n  return a;\n}\nconst b = () => {\n};\n"
    good = "// Adds a row and counts it."
    rows = [
        ("1", "f", "a.js", "add", "function", "function add(a) {", 2, 4, good, None, None),
        ("1", "f", "a.js", "add", "function", "function add(a) {", 2, 4, good, None, None),
        ("2", "f", "a.js", "b", "constant", "const b = () => {", 5, 6, good, None, None),
        ("3", "f", "a.js", "label", "constant", 'const label = "a => b()";', 5, 5, good, None, None),
        ("4", "f", "a.js", "C", "class", "class C {", 1, 2, good, None, None),
        ("5", "f", "a.js", "add", "function", None, None, None, good, None, None),
        ("6", "gone", None, None, "method", None, 1, 2, good, None, None),
        ("7", "f", "a.js", "add", "function", None, 2, 4, None, None, None),
        ("8", "f", "a.js", "add", None, None, 2, 4, good, None, None),
        ("9", "n", "a.js", "add", "Function", None, 2, 4, good, None, None),
    ]
    f = spark.createDataFrame([("f", text, "x"), ("f", text, "x"), ("n", None, "x")], "file_id string, content string, symbols string")
    out = {r["symbol_id"]: r for r in D.documented_functions(spark.createDataFrame(rows, s_ddl), f).collect()}
    assert set(out) == {"1", "2", "5", "6", "9"}
    assert out["1"]["code"] == "function add(a) {\n  return a;\n}" and out["1"]["captured"] and out["1"]["description"] == "Adds a row and counts it."
    assert out["2"]["captured"] and out["2"]["description"] == "Adds a row and counts it." and out["2"]["code"] == "const b = () => {\n}"
    assert out["5"]["captured"] is False and out["6"]["code"] is None and out["9"]["code"] is None
    assert D.documented_functions(spark.createDataFrame([], s_ddl), f).count() == 0
    other = f.select("file_id", F.lit("// TODO: say more\nfunction add(a) {\n}\n").alias("content"))  # the file says less than the table
    assert {r["symbol_id"] for r in D.documented_functions(spark.createDataFrame(rows[:1], s_ddl), other).collect()} == set()
