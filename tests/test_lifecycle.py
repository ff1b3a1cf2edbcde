import json
import re
import subprocess
from datetime import datetime
from random import Random

import pytest
from pyspark.sql import functions as F

from codeseam.functions import scoring as S
from codeseam.operators import evaluation as E
from codeseam.operators import maintenance as M
from codeseam.operators import usage as U
from codeseam.sources import corpus, tasks

SCAN = "index_id string, path string, size long, mtime_ms long, content_hash string, scanned_at timestamp"
FILE = "id string, index_id string, path string, size long, mtime_ms long, content_hash string, deleted boolean, last_indexed_at long"
T0, T1 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def test_diff(spark):
    scans = [("i", "same", 1, 1, "a", T0), ("i", "size", 2, 1, "a", T0), ("i", "time", 1, 2, "a", T0), ("i", "new", 1, 1, "a", T0), ("i", "stale", 1, 1, "a", T0), ("i", "back", 1, 1, "a", T0), ("i", "twice", 9, 9, "z", T0), ("i", "twice", 1, 1, "A", T1)]
    stored = [(str(n), "i", p, 1, 1, "a", d, t) for n, (p, d, t) in enumerate([("same", False, 1), ("size", False, 1), ("time", False, 1), ("gone", False, 1), ("stale", False, 1), ("back", False, 1), ("back", True, 2), ("twice", None, 1)])]
    chunks = spark.createDataFrame([("i", "stale", None), ("i", "same", 2)], "index_id string, path string, chunker_version int")
    args = spark.createDataFrame(scans, SCAN), spark.createDataFrame(stored, FILE), chunks
    got = {r["path"]: r["change"] for r in M.diff(*args).collect()}
    assert got == {"same": "unchanged", "size": "changed", "time": "changed", "new": "new", "gone": "deleted", "stale": "changed", "back": "new", "twice": "unchanged"}
    assert {r["path"]: r["change"] for r in M.diff(*args, by_hash=True).collect()}["time"] == "unchanged"
    work = {r["path"]: r["work"] for r in M.split_work(M.diff(*args), 2).collect()}
    assert work == {"size": "now", "stale": "now", "time": "pending", "back": "pending", "new": "pending", "gone": "now"}
    marked = {r["path"]: r["stale"] for r in M.mark_stale(args[0], M.split_work(M.diff(*args), 2).where(F.col("work") == "pending")).collect()}
    assert marked["new"] and not marked["same"]
    assert M.diff(args[0].limit(0), args[1].limit(0)).count() == 0


def test_deletes(spark):
    e = spark.createDataFrame([("i", "a", "b"), ("i", "b", "c"), ("i", "c", "d"), ("j", "a", "b")], "index_id string, from_path string, to_path string")
    gone = spark.createDataFrame([("i", "b")], "index_id string, path string")
    assert {(r[0], r[1]) for r in M.without_edges(e, gone, "out").collect()} == {("i", "a"), ("i", "c"), ("j", "a")}
    assert {(r[0], r[1]) for r in M.without_edges(e, gone).collect()} == {("i", "c"), ("j", "a")}
    assert M.without_indexes(e, gone).count() == 1


NOW = 100 * M.DAY
INDEX = "id string, repo_root string, worktree_path string, branch_name string, head_sha string, created_at long, last_accessed_at long, expires_at long, pinned boolean, status string"


def index(id, last, branch="b", worktree="/r", expires=None, pinned=False):
    return (id, "/r", worktree, branch, "h", 0, last, expires, pinned, "active")


def test_retention(spark):
    rows = [
        index("old", NOW - 15 * M.DAY), index("fresh", NOW - 13 * M.DAY), index("detached", NOW - 4 * M.DAY, "DETACHED"), index("linked", NOW - 3 * M.DAY, worktree="/w"), index("pinned", 0, pinned=True),
        index("said", NOW - 2 * M.HOUR, expires=NOW - 1), index("grace", NOW - M.HOUR + 1, expires=1), index("active", 0), index("held", 0),
    ]
    leases = spark.createDataFrame([("held", NOW + 1), ("old", NOW)], "index_id string, expires_at long")
    df = spark.createDataFrame(rows, INDEX)
    got = {r["index_id"]: r["reason"] for r in M.prune(df, leases, NOW, "active").collect()}
    assert got == {"old": "expired", "fresh": "valid", "detached": "expired", "linked": "expired", "pinned": "pinned", "said": "expired", "grace": "grace", "active": "active"}
    assert {r["index_id"]: r["reason"] for r in M.prune(df, leases, NOW, strict=True).collect()}["fresh"] == "expired"
    drop = lambda **k: [tuple(r) for r in M.drop_target(df, **k).collect()]
    assert drop(index_id="pinned") == [("pinned", "pinned")] and drop(index_id="active", active="active") == [("active", "active")] and drop(index_id="x") == []
    assert drop(branch="b", worktree="/w") == [("linked", "drop")] and drop(branch="b")[0][0] == "grace"
    opened = spark.createDataFrame([("said", "/r", "/r", "b", "h", NOW), ("brand", "/r", "/r", "n", "h", NOW)], "id string, repo_root string, worktree_path string, branch_name string, head_sha string, at long")
    log = {r["id"]: r for r in M.upsert_index(df, opened).collect()}
    assert len(log) == 10 and log["said"]["expires_at"] is None and log["said"]["last_accessed_at"] == NOW == log["brand"]["created_at"]
    with pytest.raises(ValueError, match="newer"):
        M.check_version(99)


def test_usage(spark):
    ddl = "tool string, repo_root string, result_text string, is_error boolean, saved_override long, at long"
    found = json.dumps({"results": [{"path": "a"}, {"path": "b"}]})
    impact = json.dumps({"callers": [{"path": "a"}], "affectedTests": [{"path": "t"}, {"path": "a"}], "target": {"path": "x"}, "related": [{"sourcePath": "s", "path": "r"}]})
    rows = [("search", "/r", found, False, None, 1), ("search", "/r", found, True, None, 9), ("search", "/r", "no json", None, None, 2), ("expand", "/r", found, False, None, 3), ("impact", "/q", impact, False, None, 4), ("search", "/q", found, False, -5, 5)]
    df = spark.createDataFrame(rows, ddl)
    by = {(r["tool"], r["calls"]): r for r in U.record(df).collect()}
    assert by["search", 2]["bytes_saved"] == 2 * 4096 - len(found) and by["search", 2]["last_called_at"] == 2
    assert by["expand", 1]["bytes_saved"] == 0 and by["search", 1]["bytes_saved"] == 0 and by["impact", 1]["bytes_saved"] == 3 * 4096 - len(impact)
    roll = {(r["level"], r["tool"]): r["calls"] for r in U.rollup(U.record(df), U.TRACKED).collect() if r["level"] != "repo"}
    assert roll == {("tool", "search"): 3, ("tool", "expand"): 1, ("tool", "impact"): 1, ("total", None): 5}
    assert df.where("tool = 'impact'").select(U.discovery_paths(F.col("result_text"))).head()[0] == ["x", "s", "r", "a", "t", "a"]
    calls = spark.createDataFrame([(1, "i", ["a", "a", "b", "none"], 10), (2, "i", [], 10), (3, "i", ["b"], 999)], "call_id long, index_id string, paths array<string>, served long")
    files = spark.createDataFrame([("i", "a", 100, 1), ("i", "a", 50, 2), ("i", "b", 7, 1)], "index_id string, path string, size long, last_indexed_at long")
    assert {r["call_id"]: r["saved"] for r in U.saved_from_files(calls, files).collect()} == {1: 47, 2: 0, 3: 0}
    assert {r["call_id"]: r["saved"] for r in U.saved_from_files(calls, files, 1).collect()}[1] == 40


def test_evaluation(spark):
    t = spark.createDataFrame([("t", ["a", "b"]), ("none", [])], "id string, expected_paths array<string>")
    ddl = "task_id string, arm string, repeat int, found_paths array<string>, tool_calls int, bytes_served long, elapsed_ms double"
    runs = [("t", "full", 0, ["x", "a", "x", "c", "d", "e"], 1, 10, 5.0), ("t", "graph", 0, ["x", "a"], 1, 10, 5.0), ("t", "full", 1, [], 1, 10, 9.0), ("none", "full", 0, ["a"], 1, 10, 1.0)]
    m = E.measure(spark.createDataFrame(runs, ddl), t, 5)
    got = {(r["task_id"], r["arm"], r["repeat"]): (r["recall"], r["rr"], r["precision"], r["success"]) for r in m.collect()}
    assert got == {("t", "full", 0): (0.5, 0.5, 0.2, True), ("t", "graph", 0): (0.5, 0.5, 0.5, True), ("t", "full", 1): (0.0, 0.0, 0.0, False), ("none", "full", 0): (0.0, 0.0, 0.0, False)}
    a = {r["arm"]: r for r in E.missed_thresholds(E.aggregate(m, ["arm"])).collect()}
    assert a["full"]["tasks"] == 2 and a["full"]["samples"] == 3 and a["full"]["recall"] == 0.125 and a["full"]["success_rate"] == 0.25 and a["full"]["p50_ms"] == 5.0 and a["full"]["p95_ms"] == 9.0
    assert a["graph"]["recall_ci"]["low"] == a["graph"]["recall_ci"]["high"] == 0.5 and "recall" in a["graph"]["missed"]
    kinds = spark.createDataFrame([(f"{k}{i}", k, i) for k, n in (("locate", 3), ("callers", 1), ("history", 2)) for i in range(n)], "id string, type string, pos int")
    assert [r["id"] for r in E.interleave(kinds, 5).orderBy("n").collect()] == ["locate0", "callers0", "history0", "locate1", "history1"]
    arms = E.arm_rotation(kinds, 2)
    first = {(r["id"], r["repeat"]): r["arm"] for r in arms.where("ord = 0").collect()}
    assert first["locate0", 0] == "full" and first["locate0", 1] == "lexical" and first["locate1", 0] == "lexical"
    e = spark.createDataFrame([("a", "src/b.ts", "imports"), ("c", "src/b.ts", "calls"), ("a", "src/b.ts", "calls"), ("src/b.ts", "src/b.ts", "calls"), ("t", "src/b.ts", "tests")], "from_path string, to_path string, type string")
    (callers,) = E.relationship_tasks(e, "callers").collect()
    assert callers["expected_paths"] == ["a", "c"] and callers["query"] == "callers of src b" or callers["query"].startswith("callers of")
    assert [r["expected_paths"] for r in E.relationship_tasks(e, "tests").collect()] == [["t"]]
    commits = spark.createDataFrame([("1", "Speed up the row reader", ["src/b.ts", "x", "src/b.ts"]), ("2", "Merge branch of it all", ["src/b.ts"]), ("3", "Fix b.ts once again", ["src/b.ts"]), ("4", "short", ["src/b.ts"])], "sha string, subject string, paths array<string>")
    assert [r["query"] for r in E.history_tasks(commits, spark.createDataFrame([("src/b.ts",)], "path string")).collect()] == ["Speed up the row reader"]
    paths = spark.createDataFrame([(f"p{i}",) for i in range(20)], "path string")
    scale = E.nested_scales(paths, paths.where("path = 'p7'"), [3, 10], 1).orderBy("pos").collect()
    assert scale[0]["path"] == "p7" and [r["scale"] for r in scale] == [3] * 3 + [10] * 7
    d = [E.task_digest(x.withColumn("type", F.lit("a")).withColumn("query", F.lit("q"))).head()[0] for x in (t, t.orderBy(F.col("id").desc()))]
    assert d[0] == d[1]


def test_task_files(spark, tmp_path):
    good = {"id": "1", "suite": "retrieval", "type": "locate", "query": "q", "expected_paths": ["a.ts"], "contributes": True, "reviewed": True}
    known = spark.createDataFrame([("a.ts",)], "path string")

    def load(*items, version=1):
        p = tmp_path / "t.json"
        p.write_text(json.dumps({"version": version, "tasks": list(items)}))
        return tasks.load_tasks(spark, str(p), known)

    assert load(good).count() == 1
    for change, why in [({"query": " "}, "no query"), ({"type": "x"}, "type"), ({"expected_paths": []}, "nothing"), ({"expected_paths": ["../a"]}, "outside"), ({"expected_paths": ["b.ts"]}, "not there"), ({"reviewed": False}, "reviewed"), ({"suite": "graph", "type": "tests"}, "target")]:
        with pytest.raises(ValueError, match=why):
            load(good | change)
    with pytest.raises(ValueError, match="twice"):
        load(good, good)
    with pytest.raises(ValueError, match="version 1"):
        load(good, version=2)
    tasks.write_artifacts(str(tmp_path / "out"), spark.createDataFrame([("full", 0.5)], "arm string, recall double"), load(good))
    assert "| full | 0.500 |" in (tmp_path / "out" / "report.md").read_text()


def test_scan(spark, tmp_path):
    files = {"src/a.ts": b"let a", "src/big.ts": b"x" * (5 * 1024 * 1024 + 1), "bin/x.py": b"a\0b", "build/y.ts": b"y", "skip/z.ts": b"z", "keep/skip.log": b"l", "keep/use.log": b"u", ".gitignore": b"skip/\n*.log\n# c\n", "keep/.gitignore": b"!use.log\n", "ctl.txt": bytes(range(1, 9)) * 3}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r for r in corpus.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.ts", "keep/use.log", ".gitignore", "keep/.gitignore"}
    assert got["src/a.ts"]["language"] == "typescript" and got["src/a.ts"]["content"] == "let a" and got["src/a.ts"]["size"] == 5
    assert {r["path"] for r in corpus.scan(spark, str(tmp_path), listed=["src/a.ts", "none"]).collect()} == {"src/a.ts"}


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    assert corpus.git_files(str(tmp_path)) is None
    run("init", "-q", "-b", "main")
    (tmp_path / "a.ts").write_text("a")
    (tmp_path / ".gitignore").write_text("no.ts\n")
    (tmp_path / "no.ts").write_text("n")
    run("add", ".")
    run("commit", "-qm", "Add the first file")
    (tmp_path / "b c.ts").write_text("b")
    assert set(corpus.git_files(str(tmp_path))) == {"a.ts", ".gitignore", "b c.ts"}
    scope = corpus.git_scope(str(tmp_path))
    assert scope["branch_name"] == "main" and len(scope["head_sha"]) == 40 and scope["dirty"] == ["b c.ts"]
    assert [(r["subject"], sorted(r["paths"])) for r in corpus.git_log(spark, str(tmp_path)).collect()] == [("Add the first file", [".gitignore", "a.ts"])]
    assert corpus.porcelain("R  new\0old\0 M x\0??\0") == [("R ", "new"), (" M", "x")]


def test_latencies_are_not_gathered(spark):
    """Percentiles over all runs and by group, with nulls and a group without latencies; no list of a group's runs."""
    random = Random(3)
    rows = [(f"t{i % 50}", "abc"[i % 3] if i < 3000 else "d", 1.0, 0.5, 0.2, True, 1, 10, float(random.randrange(900)) if i % 7 and i < 3000 else None) for i in range(3010)]
    m = spark.createDataFrame(rows, "task_id string, arm string, recall double, rr double, precision double, success boolean, tool_calls long, bytes_served long, elapsed_ms double")
    for by in ([], ["arm"]):
        out = E.aggregate(m, by)
        assert "elapsed_ms" not in " ".join(re.findall(r"collect_list\([^)]*\)", out._jdf.queryExecution().optimizedPlan().toString()))
        got = {r["arm"] if by else "": r for r in out.collect()}
        assert set(got) == (set("abcd") if by else {""})
        for key, r in got.items():
            values = [x[8] for x in rows if x[8] is not None and key in ("", x[1])]
            assert (r["p50_ms"], r["p95_ms"]) == (S.percentile(values, 50), S.percentile(values, 95))
            assert r["samples"] == sum(key in ("", x[1]) for x in rows) and r["recall_ci"]["low"] == 1.0


def test_thresholds_of_the_graph_arm(spark):
    rows = [("full", 0.9, 0.4, 0.9, 0.1), ("graph", 0.5, 0.0, 0.9, 0.4), ("graph", 0.9, 0.0, 0.9, 0.5)]
    a = spark.createDataFrame(rows, "arm string, recall double, rr double, success_rate double, precision double")
    assert [r["missed"] for r in E.missed_thresholds(a).collect()] == [["rr"], ["recall", "graph_precision"], []]
    assert [r["missed"] for r in E.missed_thresholds(a.drop("arm")).collect()] == [["rr"], ["recall", "rr"], ["rr"]]


def test_quality_by_category(spark):
    q = spark.createDataFrame([("a", 1), ("a", 6), ("b", None), ("b", 2)], "category string, rank int")
    got = {r["category"]: (r["queries"], r["recall"], round(r["mrr"], 4), r["top1"]) for r in E.quality(q).collect()}
    assert got == {"a": (2, 0.5, 0.5833, 0.5), "b": (2, 0.5, 0.25, 0.0), None: (4, 0.5, 0.4167, 0.25)}


def test_numbers_within_a_hot_key(spark):
    rows = [("hot", i) for i in range(500)] + [("a", 3), ("a", 1), (None, 2)]
    df = spark.createDataFrame(rows, "type string, pos int").repartition(7)
    got = {(r["type"], r["pos"]): r["nth"] for r in E.numbered(df, "type", "pos", "nth").collect()}
    assert got == {**{("hot", i): i for i in range(500)}, ("a", 1): 0, ("a", 3): 1, (None, 2): 0}


def test_unique_files_and_the_graph_arm(spark):
    ranked = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 0)], "query_id int, path string, rank int")
    found = E.unique_files(ranked, 2, ["query_id"], [F.col("rank")])
    assert {r["query_id"]: r["found_paths"] for r in found.collect()} == {1: ["a", "b"], 2: ["z"]}
    edges = spark.createDataFrame([("i", "x", "t", "calls", 0.7), ("i", "y", "t", "imports", 0.9), ("i", "y", "t", "calls", 0.7), ("i", "s", "t", "tests", 0.8)], "index_id string, from_path string, to_path string, type string, confidence double")
    tasks = spark.createDataFrame([("1", "callers", "i", "t"), ("2", "tests", "i", "t"), ("3", "callers", "i", None), ("4", "locate", "i", "t")], "id string, type string, index_id string, target_path string")
    assert {r["task_id"]: r["found_paths"] for r in E.graph_arm(edges, tasks, 5).collect()} == {"1": ["y", "x"], "2": ["s"], "3": [], "4": []}


def test_freshness_probe(spark, tmp_path):
    from codeseam.engine import Engine

    rows = [("i", "src/a.py", "python", "def f():\n    return 1\n"), ("i", "tests/b.py", "python", "x = 1\n"), ("i", "yarn.lock", None, "y\n")]
    files = spark.createDataFrame(rows, "index_id string, path string, language string, content string")
    got = E.freshness_probe(Engine(spark, f"file://{tmp_path}/s", "i"), files)
    assert got == {"attempted": True, "passed": True, "path": "src/a.py", "modified_visible": True, "deleted_removed": True}
    assert not E.freshness_probe(Engine(spark, f"file://{tmp_path}/t", "i"), files.where("path <> 'src/a.py'"))["attempted"]
