import random

from codeseam.operators import chunking as C


def test_line_ranges():
    assert C.line_ranges(["a" * 9] * 5, limit=20, overlap=0) == [(1, 2), (3, 4), (5, 5)]
    assert C.line_ranges(["a" * 9] * 4, limit=20, overlap=10) == [(1, 2), (2, 3), (3, 4), (4, 4)]  # an overlap that is left over is a chunk
    assert C.line_ranges([""]) == [(1, 1)]
    assert C.line_ranges(["x" * 5000], limit=100, overlap=10) == [(1, 1)]  # unless it is the same range again
    assert C.line_ranges(["😀"] * 4, limit=6, overlap=0) == [(1, 2), (3, 4)]  # two units each, and one for the line's end


def test_every_line_is_in_a_range():
    random.seed(1)
    for _ in range(300):
        lines = ["x" * random.choice([0, 1, 5, 30, 90]) for _ in range(random.randint(1, 40))]
        ranges = C.line_ranges(lines, 1, random.choice([10, 50, 100]), random.choice([0, 5, 20]))
        covered = {n for a, b in ranges for n in range(a, b + 1)}
        assert covered == set(range(1, len(lines) + 1)) and len(set(ranges)) == len(ranges)


def test_outermost_symbols():
    s = [("inner", "method", 4, 5), ("bad", "function", 0, 3), ("K", "class", 3, 6), ("late", "function", 50, 60), ("cross", "function", 6, 8), ("f", "function", 8, 99)]
    assert [x[0] for x in C.outermost(s, 10)] == ["K", "f"]
    assert C.outermost(s, 10)[1][3] == 10


def test_structured_ranges_follow_symbols():
    text = "import a\n\nclass A {\n  m() {}\n}\n\nfunction f() {\n  return 1\n}"
    got = C.structured_ranges(text, [("A", "class", 3, 5), ("m", "method", 4, 4), ("f", "function", 7, 9)])
    assert [(a, b, s and s[0]) for a, b, s in got] == [(1, 2, None), (3, 5, "A"), (6, 6, None), (7, 9, "f")]


def test_comments_join_their_symbol():
    text = "x\n/**\n * doc\n */\n@dec\nfunction f() {}\n\n// apart\n\ndef g(): pass"
    got = C.structured_ranges(text, [("f", "function", 6, 6), ("g", "function", 10, 10)])
    assert [(a, b) for a, b, s in got if s] == [(2, 6), (10, 10)]


def test_operator(spark):
    ddl = "file_id string, index_id string, path string, language string, content string, symbols string"
    code = "// top\nexport function f() {\n  return 1\n}\nlast"
    rows = [("1", "i", "a.ts", None, code, "x"), ("2", "i", "b.md", "markdown", "# t\ntext", None), ("3", "i", "c.ts", None, None, None), ("4", "i", "d.ts", None, "", None)]
    s_ddl = "id string, file_id string, name string, kind string, start_line int, end_line int"
    symbols = spark.createDataFrame([("s", "1", "f", "function", 2, 4), ("s", "1", "f", "function", 2, 4), ("n", "1", "x", None, None, None)], s_ddl)
    files = spark.createDataFrame(rows, ddl)
    out = C.chunk_files(files, symbols).orderBy("file_id", "start_line").collect()
    assert [(r["file_id"], r["start_line"], r["end_line"], r["symbol_id"], r["chunker"], r["content_type"]) for r in out] == [
        ("1", 1, 4, "s", "structural", "code"), ("1", 5, 5, None, "structural", "code"), ("2", 1, 2, None, "line", "prose"), ("4", 1, 1, None, "line", "code"),
    ]
    assert out[0]["content"] == "// top\nexport function f() {\n  return 1\n}" and len({r["id"] for r in out}) == 4
    assert [r["id"] for r in C.chunk_files(files, symbols).orderBy("file_id", "start_line").collect()] == [r["id"] for r in out]
    assert C.chunk_files(files.limit(0), symbols).count() == 0
    big = spark.createDataFrame([("9", "i", "a.ts", None, "x = 1\n" * 100_000, None)], ddl)
    own = spark.createDataFrame([("s9", "9", "x", "constant", 1, 2)], s_ddl)
    assert {r["chunker"] for r in C.chunk_files(big, own).select("chunker").distinct().collect()} == {"line"}
