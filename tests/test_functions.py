import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from codeseam.functions import paths as P
from codeseam.functions import porter
from codeseam.functions import scoring as S
from codeseam.functions import text as X


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], ddl).select(column.alias("v")).head()["v"]


def test_identifiers(spark):
    split = lambda t, *a: one(spark, X.split_identifiers("t", *a), t=t)
    assert split("HTTPServerMaxLen2X user_id_value plain ab_cd parseHTTP") == ["http", "server", "max", "len2", "user", "value", "parse"]
    assert split("aB cD eF") == []
    assert len(split(" ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}_other{i}" for i in range(200)))) == 128
    assert split("foo_123_bar") == ["foo", "bar"]
    assert one(spark, X.with_subtokens("t"), t="x = parseFile") == "x = parseFile\nparse file"
    assert one(spark, X.with_subtokens("t"), t="plain") == "plain"


def test_dedent_and_previews(spark):
    assert one(spark, X.dedent("t"), t="    a\n\n      b\n    c") == "a\n\n  b\nc"
    assert one(spark, X.dedent("t"), t="a\n  b") == "a\n  b"
    assert one(spark, X.snippet("t", F.lit("the Beta")), t="alpha beta Beta") == "alpha **beta** **Beta**"
    long = "x" * 600 + " needle " + "y" * 600
    got = one(spark, X.snippet("t", F.lit("needle"), 100), t=long)
    assert got.startswith("…") and got.endswith("\n…") and "**needle**" in got
    assert one(spark, X.snippet("t", F.lit("absent"), 10), t="0123456789abc") == "0123456789\n…"
    assert one(spark, X.headline("t", F.lit("two"), F.lit(None).cast("string")), t="\n  one\n two words\n") == "**two** words"
    assert one(spark, X.headline("t", F.lit("two"), F.lit(" sig(two) ")), t="one") == "sig(**two**)"
    assert one(spark, X.headline_text("t", F.lit("q"), F.lit(None).cast("string"), 5), t="123456789") == "12345…"


def test_cursor(spark):
    c = one(spark, X.encode_cursor(F.lit(12), F.lit("chk_?>é")))
    assert "+" not in c and "/" not in c and "=" not in c
    assert one(spark, X.decode_cursor("c"), c=c) == 12
    assert one(spark, X.decode_cursor("c"), c="%%%") == 0
    assert one(spark, X.decode_cursor("c"), c=None) == 0


def test_hashes(spark):
    with pytest.raises(Exception, match="an index needs"):
        one(spark, X.index_identity(), repo_root="/r", worktree_path="/r", branch_name="main", head_sha=None)
    assert one(spark, X.index_identity(), repo_root="/r", worktree_path="/r", branch_name="DETACHED", head_sha=None).startswith("idx_")
    assert one(spark, X.utf16_length("t"), t="a😀") == 3
    assert one(spark, X.strip_quotes("t"), t="'a\"") == "a"
    assert one(spark, X.first_line("t"), t="a\nb") == "a"
    assert one(spark, X.escape_pattern("t"), t="a.b(c)*") == r"a\.b\(c\)\*"


def test_paths(spark):
    for path, want in {"./a/../b//c": "b/c", "../x": "../x", "a/../../b": "../b", "/a/../../b": "/b", "": ".", "a/.": "a"}.items():
        assert one(spark, P.normalize("p"), p=path) == want, path
    assert one(spark, P.inside("p"), p="a/../b") and not one(spark, P.inside("p"), p="a/../../b")
    for path, ext in {"a/.env": "", "a/b.d.ts": ".ts", "x": "", "a.b/c": ""}.items():
        assert one(spark, P.extname("p"), p=path) == ext
    assert one(spark, P.language("p"), p="X.TS") == "typescript" and one(spark, P.language("p"), p="Makefile") is None
    denied = ["node_modules/x", "a/dist/b", "a.min.js", "x/vendor/y", "b.bundle.js", "a.map", "target/x"]
    assert all(one(spark, P.denied("p"), p=p) for p in denied)
    assert not any(one(spark, P.denied("p"), p=p) for p in ["distribution/x", "a/build.ts", "vendors/a", "outbox/a", "my_target/x"])
    tests = {"a.test.ts": True, "a/b_test.go": True, "test_a.py": True, "tests/a.ts": True, "a/__tests__/b": True, "contest/a.ts": False, "a/latest.ts": False}
    assert {p: one(spark, P.is_test("p"), p=p) for p in tests} == tests
    assert one(spark, P.has_prefix("p", "./src/"), p="src/a") and not one(spark, P.has_prefix("p", "s_c"), p="src/a")


def test_candidates_and_targets(spark):
    c = one(spark, P.import_candidates("p", F.lit("./x.js")), p="src/a.ts")
    assert c[:2] == ["src/x.js", "src/x.ts"] and "src/x.js.ts" not in c
    c = one(spark, P.import_candidates("p", F.lit("../lib")), p="src/a.ts")
    assert c[:2] == ["lib", "lib.ts"] and "lib/index.ts" in c
    assert one(spark, P.import_candidates("p", F.lit("react")), p="src/a.ts") is None
    assert one(spark, P.test_targets("p"), p="src/a.test.ts")[0] == "src/a.ts"
    assert "src/a.ts" in one(spark, P.test_targets("p"), p="src/__tests__/a.test.ts")
    assert "pkg/foo.py" in one(spark, P.test_targets("p"), p="pkg/test_foo.py")
    assert one(spark, P.test_targets("p"), p="src/a.ts") == []


def test_generated_queries(spark):
    assert one(spark, P.symbol_query("n", F.lit("src/x.ts")), n="parseHttpHeader") == "parse http header"
    assert one(spark, P.symbol_query("n", F.lit("src/row-reader.ts")), n="parse") == "row reader"
    assert one(spark, P.symbol_query("n", F.lit("a.ts")), n="x") == ""
    assert one(spark, P.module_subject("p"), p="src/auth/index.ts") == "auth"
    assert one(spark, P.module_subject("p"), p="src/auth/sessionStore.ts") == "auth session store"


def test_ranking():
    assert math.isclose(sum(S.WEIGHTS.values()), 1.0) and math.isclose(sum(S.LEXICAL.values()), 1.0)
    w = S.redistributed(S.WEIGHTS, ["fts", "symbol"])
    assert math.isclose(w["fts"] + w["symbol"], 1.0) and w["graph"] == 0


def test_numbers(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 5, 10)], "v double")
    assert [r[0] for r in df.select(S.min_max(F.col("v"), F.lit(0.0), F.lit(10.0))).collect()] == [0.0, 0.5, 1.0]
    assert one(spark, S.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 1.0
    assert one(spark, S.rounded(F.lit(0.1235))) == 0.124
    assert one(spark, S.nearest_rank(F.array(*map(F.lit, (3.0, 1.0, 2.0, 4.0))), 50)) == 3.0
    assert one(spark, S.nearest_rank(F.array().cast("array<double>"), 50)) == 0.0
    assert [one(spark, S.confidence_label(F.lit(c))) for c in (0.8, 0.5, 0.49)] == ["high", "medium", "low"]


def test_seeded_generator():
    assert [S.Xorshift(1).next() for _ in range(2)] == [270369 / 2**32] * 2
    assert S.Xorshift(0).state == 1 and S.Xorshift(-1).state == 0xFFFFFFFF
    shuffled = S.seeded_shuffle(list(range(20)), 42)
    assert sorted(shuffled) == list(range(20)) and shuffled == S.seeded_shuffle(list(range(20)), 42) != list(range(20))
    low, high = S.bootstrap([0.0, 1.0] * 20, 7)
    assert 0.3 < low < 0.5 < high < 0.7 and S.bootstrap([0.3], 1) == (0.3, 0.3) and S.bootstrap([], 1) == (0.0, 0.0)


def test_porter_against_sqlite():
    words = """running nothing validate validated validating validates session sessions caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling
    hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism
    decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable
    defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll validatesession be at y by
    university generalizations oscillators archaeology apology""".split()
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    want = dict(db.execute("SELECT doc, term FROM v"))
    assert {w: porter.stem(porter.fold(w)) for w in words} == {w: want[i] for i, w in enumerate(words)}
    assert porter.fold("café") == "cafe"
