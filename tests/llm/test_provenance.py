import itertools
import math
import random

import pytest

from codeseam.llm import provenance as V

SOURCE = "import { a } from './b.js';\n\nexport function readRows(x) {\n  return a(x);\n}\n" * 12
MINIFIED = "!function(e,t){" + "var a=1,b=t.c;e.d=function(f){for(var i=0;i<f.length;i++)t[f[i]]=!0};" * 40 + "}(this)"
CASES = [
    ("src/a/readRows.js", SOURCE, "handwritten"),
    ("src/a/x.go", "// Code generated by tool v1. DO NOT EDIT.\n" + SOURCE, "generated"),
    ("src/a/x.py", "#!/usr/bin/env python3\n# Diese Datei wurde automatisch aus x.xml erzeugt. Nicht bearbeiten.\nx = 1\n", "generated"),
    ("src/a/x.go", "// Finds auto-generated files by their banner.\n" + SOURCE, "handwritten"),
    ("codegen/a/x.go", "// Writes the generated tables; the generator itself is edited here.\n" + SOURCE, "handwritten"),
    ("api/a.pb.go", SOURCE, "generated"),
    ("web/package-lock.json", '{"lockfileVersion": 3}', "generated"),
    ("dist/a.js.map", '{"mappings": "AAAA"}', "generated"),
    ("web/a.min.js", MINIFIED, "minified"),
    ("src/a/b.js", MINIFIED, "minified"),
    ("node_modules/x/a.js", SOURCE, "vendored"),
    ("vendors/x/a.js", SOURCE, "handwritten"),
    ("vendor_portal/x/a.js", SOURCE, "handwritten"),
    ("src/u/a.js", "// libx 1.2.3 -- upstream: https://libx.example/r\n// copied into this tree without changes\n" + SOURCE, "vendored"),
    ("src/u/a.js", "// Copyright (c) 2020 the others contributors. All rights reserved.\n" + SOURCE, "handwritten"),
    ("firmware/a.h", "unsigned char a[] = {\n" + "  0xdb, 0x85, 0x49, 0xdc, 0xeb,\n" * 60 + "};\n", "blob"),
    ("data/a.json", "[" + ", ".join(f'{{"id": {i}, "k": "x", "v": {i}.5}}' for i in range(100)) + "]", "blob"),
    ("src/a/font.py", 'FONT = "' + "iwIrrfJra7j2ztudiLV3TLH2YRU/cdBhmE6wwTe+" * 50 + '"\n', "blob"),
    ("src/a/key.py", 'ICON = "data:image/png;base64,' + "iwIrrfJra7j2ztud" * 8 + '"\n' + SOURCE, "handwritten"),
    ("config/a.json", '{\n  "a": 1,\n  "b": "x"\n}\n' * 1, "handwritten"),
    ("certs/a.pem", "-----BEGIN CERTIFICATE-----\n" + "A1b2" * 400, "handwritten"),
]


@pytest.mark.parametrize(("path", "text", "label"), CASES)
def test_evidence(path, text, label):
    e = V.evidence(path, text, "repo")
    assert V.LABELS[e.index(max(e))] == label


ENCODED = "iwIrrfJra7j2ztudiLV3TLH2YRU/cdBhmE6wwTe+"


@pytest.mark.parametrize("size", [56_000, 62_000, 300_000])
def test_shares_are_of_the_whole_text_at_every_size(size):
    """Data in the middle of code are no blob, data around code are one, whatever the length."""
    label = lambda path, text: max(zip(V.evidence(path, text), V.LABELS))[1]
    code = SOURCE * (size // 4 // len(SOURCE) + 1)
    inside = code + 'const X = "' + ENCODED * (size // 2 // len(ENCODED)) + '";\n' + code
    assert len(inside) >= size and label("src/a/b.py", inside) == "handwritten"
    code = SOURCE * (size // 6 // len(SOURCE))
    around = ('X = "' + ENCODED * ((size - len(code)) // 2 // len(ENCODED)) + '"\n').join(["", code, ""])
    assert label("src/a/font.py", around) == "blob"
    records = "[" + ", ".join(f'{{"id": {i}, "k": "x"}}' for i in range(100))
    assert label("data/a.json", records + ', {"notes": ["' + "a b " * (size // 4 - 500) + '"]}]\n' + "\n" * (size // 400)) == "blob"


LICENCE = [f"Clause {i} of the licence: the work is given as it is, without any warranty." for i in range(300)]


@pytest.mark.parametrize("lines", [3, 30, 300])
def test_banners_below_a_licence(lines):
    """All comments before the first code are read, and none after it."""
    label = lambda path, text: max(zip(V.evidence(path, text), V.LABELS))[1]
    slashes, block, hashes = "".join(f"// {x}\n" for x in LICENCE[:lines]), "/*\n" + "".join(f" * {x}\n\n" for x in LICENCE[:lines]) + " */\n", "".join(f"# {x}\n" for x in LICENCE[:lines])
    made, note, long = "Code generated by tool v1. DO NOT EDIT.", "upstream: https://libx.example/r", "x" * 500 + " DO NOT EDIT"
    for head in (slashes, block, block + "\n\n" + slashes):
        assert label("src/a/x.go", head + f"// {made}\n" + SOURCE) == "generated"
        assert label("src/a/x.js", head + f"/* {note} */\n" + SOURCE) == "vendored"
        assert label("src/a/x.go", head + f"// {long}\n" + SOURCE) == "generated"
        assert label("src/a/x.go", head + "package x\n" + f"// {made}\n// {note}\n" + SOURCE) == "handwritten"
        assert label("src/a/x.go", head + f"/* kept */ package x\n// {made}\n" + SOURCE) == "handwritten"
        assert label("src/a/x.go", head + SOURCE) == "handwritten"
    assert label("src/a/x.py", hashes + f'"""Rows.\n\n{made}\n"""\nx = 1\n') == "generated"
    assert label("src/a/x.h", block + f"#ifndef X_H\n#define X_H\n#include <a.h>\n/* {made} */\nint x;\n") == "generated"
    assert label("src/a/x.h", block + f"#define X 1\n/* {made} */\nint x;\n") == "handwritten"
    owned = V.evidence("src/a/x.js", slashes + "// Copyright 2020 the repo authors\n" + SOURCE, "repo")
    assert owned[V.LABELS.index("vendored")] == -1.5


def test_marks_of_bundles_and_lockfiles_anywhere():
    label = lambda path, text: max(zip(V.evidence(path, text), V.LABELS))[1]
    banner = "/*\n" + "\n".join(LICENCE[:60]) + "\n*/\n"
    assert len(banner) > 3000
    assert label("web/a.js", banner + "var a = (function (modules) {\n" + SOURCE * 5 + "})([]);\n") == "minified"
    assert label("web/a.js", banner + SOURCE * 5) == "handwritten"
    rows = ",\n".join(f'"k{i}": "a b"' for i in range(100))
    assert label("web/deps.json", '{"meta": {' + rows + '}, "lockfileVersion": 3}') == "generated"
    assert label("web/deps.json", '{"meta": {' + rows + '}, "note": "has no lockfileVersion"}') == "handwritten"


def test_header_of_long_lines_is_linear():
    """No pattern of the header goes over a run of blanks again from each of its characters."""
    for text in ("// code" + " " * 200_000 + "x\n", "/*" + " " * 200_000 + "*/ x\n", "#" * 200_000 + "\n", "/*" * 100_000):
        assert V.evidence("src/a/x.go", text, "repo")[0] == V.PRIOR


def test_beliefs_are_exact(spark):
    """Against the sum over all labellings of a small tree."""
    random.seed(8)
    files = [(f"f{i}", d, [random.uniform(-2, 2) for _ in V.LABELS]) for i, d in enumerate(["", "a", "a", "a/b", "c/d"])]
    dirs = ["", "a", "a/b", "c", "c/d"]
    parent = {"a": "", "a/b": "a", "c": "", "c/d": "c"}
    n = len(V.LABELS)
    marginal = {f: [0.0] * n for f, _, _ in files}
    for labels in itertools.product(range(n), repeat=len(dirs)):
        at = dict(zip(dirs, labels))
        weight = math.prod(V.SAME_DIRECTORY if at[d] == at[p] else 1.0 for d, p in parent.items())
        sums = [sum(math.exp(e) * (V.SAME_FILE if x == at[d] else 1.0) for x, e in enumerate(ev)) for _, d, ev in files]
        whole = weight * math.prod(sums)
        for (f, d, ev), s in zip(files, sums):
            for x, e in enumerate(ev):
                marginal[f][x] += whole / s * math.exp(e) * (V.SAME_FILE if x == at[d] else 1.0)
    df = spark.createDataFrame([("t", d, f, *ev) for f, d, ev in files], "tree string, dir string, file string, b0 double, b1 double, b2 double, b3 double, b4 double")
    for r in V.propagate(df).collect():
        mine = [math.exp(r[f"b{i}"]) for i in range(n)]
        want = marginal[r["file"]]
        assert all(abs(a / sum(mine) - b / sum(want)) < 1e-9 for a, b in zip(mine, want))


def test_siblings_decide_a_weak_case(spark):
    """A file that alone is only a little suspicious follows its directory."""
    weak = (2.0, 0.0, 0.0, 1.9, 0.0)
    sure = (0.0, 0.0, 0.0, 8.0, 0.0)
    ddl = "tree string, dir string, file string, b0 double, b1 double, b2 double, b3 double, b4 double"
    df = spark.createDataFrame([("t", "x/y", "w", *weak), *[("t", "x/y", f"s{i}", *sure) for i in range(3)], ("u", "x/y", "w2", *weak)], ddl)
    by = {r["file"]: [r[f"b{i}"] for i in range(5)] for r in V.propagate(df).collect()}
    assert by["w"].index(max(by["w"])) == 3 and by["w2"].index(max(by["w2"])) == 0


def test_operator(spark):
    ddl = "file_id string, index_id string, path string, content string, repository string, tree string, label string"
    rows = [(str(i), "i", p, t, None, None, None) for i, (p, t, _) in enumerate(CASES)]
    rows += [rows[0], ("n1", "i", None, None, None, None, None), ("n2", None, "a/b/c/d/e.js", "", None, None, None), ("n3", "gone", "x.py", "y = 1\n" * 200_000, None, None, None)]
    idx = spark.createDataFrame([("i", "/srv/repo"), ("i", "/srv/repo")], "id string, repo_root string")
    out = V.classify(spark.createDataFrame(rows, ddl), idx).collect()
    assert len(out) == len(CASES) + 3
    by = {r["file_id"]: r for r in out}
    assert all(by[str(i)]["label"] == label for i, (_, _, label) in enumerate(CASES))
    assert all(by[k]["label"] == "handwritten" and 0 < by[k]["probability"] <= 1 for k in ("n1", "n2", "n3"))
    assert V.classify(spark.createDataFrame([], ddl), idx).count() == 0
