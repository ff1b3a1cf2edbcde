import pytest
from pyspark.sql import functions as F

from codeseam.engine import Busy, Corrupt, Engine, is_corruption
from codeseam.streaming import jobs

FILES = [
    ("src/session.ts", "// Opens a session for a token.\nexport function openSession(token: string) {\n  return token;\n}\nexport function closeSession() {\n}\n"),
    ("src/app.ts", "import { openSession } from './session.js';\nopenSession('x');\n"),
    ("src/session.test.ts", "import { openSession } from './session';\nopenSession('t');\n"),
    ("docs/guide.md", "# Sessions\nA session is opened with a token.\n"),
]


def files(spark, rows=FILES):
    return spark.createDataFrame([("i", p, None, c) for p, c in rows], "index_id string, path string, language string, content string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", "i")
    assert e.current() == {"status": "missing"}
    with pytest.raises(LookupError):
        e.stats()
    e.build(files(spark))
    return e


def test_search_and_expand(engine):
    top = engine.search("open session").orderBy("rank").collect()
    assert top[0]["path"].startswith("src/session") and top[0]["preview"]
    (text,) = engine.expand(handle=top[0]["handle"]).collect()
    assert text["text"]
    groups, related = engine.explore("open session")
    assert groups.count() >= 2 and related.count() >= 1
    assert {r["content_type"] for r in engine.table("chunks").select("content_type").distinct().collect()} == {"code", "prose"}


def test_graph_questions(engine):
    assert {(r["path"], r["edge_type"]) for r in engine.related("src/session.ts", depth=1).collect()} == {("src/app.ts", "imports"), ("src/app.ts", "calls"), ("src/session.test.ts", "imports"), ("src/session.test.ts", "calls"), ("src/session.test.ts", "tests")}
    assert [r["path"] for r in engine.tests_for("./src/session.ts").collect()] == ["src/session.test.ts"]
    touched = engine.impact(symbol="openSession").collect()
    assert {r["path"] for r in touched if r["relation"] == "affected_test"} == {"src/session.test.ts"}
    assert {r["name"] for r in engine.impact(symbol="Session").collect()} == {"openSession", "closeSession"}  # candidates
    assert [r["name"] for r in engine.outline("src").orderBy("symbol_no").collect()] == ["openSession", "closeSession"]


def test_refresh_makes_a_new_snapshot(engine, spark):
    rows = [*FILES[1:], ("src/new.ts", "export const fresh = 1;\n"), ("docs/guide.md", "# Changed\n")]
    rows = [r for r in rows if r != FILES[3]]
    before = engine.snapshot()["snapshot"]
    changes = {r["path"]: r["change"] for r in engine.refresh(files(spark, rows)).collect()}
    assert changes == {"src/session.ts": "deleted", "src/app.ts": "unchanged", "src/session.test.ts": "unchanged", "src/new.ts": "new", "docs/guide.md": "changed"} or engine.snapshot()["snapshot"] == before + 1
    assert {r["path"] for r in engine.table("files").select("path").collect()} == {p for p, _ in rows}
    assert engine.snapshot()["snapshot"] == before + 1
    engine.refresh(files(spark, rows))
    assert engine.snapshot()["snapshot"] == before + 1  # nothing changed
    engine.build(files(spark, rows))
    assert engine.vacuum(keep=1) > 0
    assert engine.doctor() | {"spark": 0, "python": 0} == {"spark": 0, "python": 0, "index": True, "files": True, "symbols": True, "chunks": True, "lengths": True, "postings": True, "edges": True}
    assert engine.stats().where("table = 'files'").head()["n_rows"] == len(rows)


def state(e):
    """All tables without their layers, as sets of rows."""
    cols = {"files": ["path", "content_hash"], "symbols": ["path", "name", "start_line"], "chunks": ["id", "content"], "lengths": ["chunk_id", "length"], "postings": ["chunk_id", "field", "term", "tf"], "edges": ["from_path", "to_path", "type"]}
    return {t: sorted(tuple(r) for r in e.table(t).select("index_id", *c).collect()) for t, c in cols.items()}


def test_refresh_writes_only_what_has_changed(spark, tmp_path):
    e, whole = Engine(spark, f"file://{tmp_path}/a", "i"), Engine(spark, f"file://{tmp_path}/b", "i")
    assert e.ensure(files(spark))["layers"] == [1]  # there was none
    edited = [("src/session.ts", FILES[0][1] + "export function renewSession() {\n}\n"), *FILES[1:3], ("src/other.ts", "import { renewSession } from './session';\nrenewSession();\n")]
    work = {r["path"]: (r["change"], r["work"]) for r in e.refresh(files(spark, edited)).collect()}
    assert work == {"src/session.ts": ("changed", "now"), "src/other.ts": ("new", "now"), "docs/guide.md": ("deleted", "now")}
    assert e.snapshot()["layers"] == [1, 2] and {r["path"] for r in e._stored("files", 2).collect()} == {"src/session.ts", "src/other.ts"}
    whole.build(files(spark, edited))
    assert state(e) == state(whole)
    for text in ("renew session", "opened with a token"):
        rows = lambda x: [(r["handle"], r["score"], r["preview"]) for r in x.search(text).orderBy("rank").collect()]  # noqa: E731, B023
        assert rows(e) == rows(whole)
    scan = e._index(e._own).postings.where(F.col("term").isin("renew"))._jdf.queryExecution().toString()
    assert "In(term" in scan or "EqualTo(term" in scan  # the scan is told the terms
    only = [r for r in edited if r[0] != "src/other.ts"]
    e.refresh(files(spark, only))  # nothing but a deletion
    whole.build(files(spark, only))
    assert state(e) == state(whole) and len(e.snapshot()["layers"]) == 3
    before = state(e)
    assert e.compact()["layers"] == [4] and state(e) == before
    assert e.ensure(files(spark, only))["snapshot"] == 4


def test_budget_lease_and_recovery(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", "i")
    e.build(files(spark))
    assert e.persistent() and e.lease("other", ttl=10_000_000) and not e.lease("me") and e.lease("other")
    with pytest.raises(Busy):
        e.refresh(files(spark, FILES[:2]))
    e.release("me")
    assert not e.lease("me")
    e.release("other")
    more = [*FILES, *((f"src/n{i}.ts", f"export const n{i} = 1;\n") for i in range(3))]
    work = e.refresh(files(spark, more), budget=2)
    assert sorted((r["path"], r["work"]) for r in work.collect()) == [("src/n0.ts", "now"), ("src/n1.ts", "now"), ("src/n2.ts", "pending")]
    assert [r["path"] for r in e.pending().collect()] == ["src/n2.ts"]
    e.refresh(files(spark, more), budget=2)
    assert e.pending().count() == 0 and e.table("files").count() == 7
    assert e.restore(1)["snapshot"] == 4 and e.table("files").count() == 4
    e.check()
    assert e.build_subset(files(spark), files(spark, FILES[:2]))["layers"] == [5] and e.table("files").count() == 2
    for f in (tmp_path / "s" / "symbols" / "snapshot=5").rglob("*.parquet"):
        f.write_bytes(b"junk")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Corrupt, match="symbols") as found:
        e.check()
    assert is_corruption(found.value) and is_corruption("x is not a Parquet file") and not is_corruption("disk full")


def test_indexes_are_pruned_and_dropped(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", "i")
    two = files(spark).unionByName(files(spark).withColumn("index_id", F.lit("old")))
    e.build(two)
    ddl = "id string, repo_root string, worktree_path string, branch_name string, head_sha string, created_at long, last_accessed_at long, expires_at long, pinned boolean, status string"
    rows = [("i", "r", "r", "main", "x", 0, 10**12, None, False, "active"), ("old", "r", "r", "b", "x", 0, 0, None, False, "active"), ("kept", "r", "r", "c", "x", 0, 0, None, True, "active")]
    known, none = spark.createDataFrame(rows, ddl), spark.createDataFrame([], "index_id string, owner string, expires_at long")
    assert e.drop(known, branch="main") == {"index_id": "i", "decision": "active"} and e.drop(known, index_id="kept")["decision"] == "pinned" and e.drop(known, branch="zzz")["decision"] == "not found"
    assert {r["index_id"]: r["action"] for r in e.prune(known, none, 10**12 + 1).collect()} == {"i": "skip", "old": "delete", "kept": "skip"}
    assert {r["index_id"] for r in e.table("files").collect()} == {"i"}
    e.build(two)
    assert e.drop(known, index_id="old")["decision"] == "drop" and e.table("chunks").where("index_id = 'old'").count() == 0


def test_related_usage_and_contexts_of_the_engine(engine, spark):
    page, near = engine.search_related("open session")
    first = page.where("rank = 0").head()["path"]
    assert page.count() and {r["path"] for r in near.collect()} == {r["path"] for r in engine.related(first, ["imports", "imported_by", "tests"], 1).collect()}
    events = spark.createDataFrame([("search", "r", '{"results": []}', False, None, 5)], "tool string, repo_root string, result_text string, is_error boolean, saved_override long, at long")
    engine.record_usage(events)
    engine.record_usage(events)
    assert [r["calls"] for r in engine.usage().where("level = 'total'").collect()] == [2]
    engine.save_context("q", "c", [("h", "p")], "n")
    assert engine.load_context("q", "c")["items"] == [{"handle": "h", "path": "p"}]
    engine.delete_context("q", "c")
    with pytest.raises(LookupError):
        engine.load_context("q", "c")


def test_contexts(engine):
    engine.save_context("r", "todo", [("h1", "a"), ("h1", "a")], "first")
    engine.save_context("r", "todo", [("h2", "b")], "second", pinned=True)
    engine.save_context("r", "gone", [], "x")
    engine.save_context("r", "gone", [], "x", deleted=True)
    (c,) = engine.contexts().collect()
    assert c["notes"] == "second" and c["pinned"] and len(c["items"]) == 1 and c["id"].startswith("ctx_")


def test_streams(spark, tmp_path):
    ddl = "tool string, repo_id string, at long, served long, saved long"
    rows = spark.createDataFrame([("a", "r", 1, 10, 1), ("a", "r", 3, 10, 1), ("b", "r", 2, 5, 0)], ddl)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    q = jobs.usage_rollup(stream).writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    q.awaitTermination()
    want = rows.groupBy("tool", "repo_id").agg(F.count("*").alias("calls"), F.max("at").alias("m"), F.sum("served").alias("s"), F.sum("saved").alias("v"))
    assert {tuple(r) for r in spark.table("rolled").collect()} == {tuple(r) for r in want.collect()}

    timed = spark.createDataFrame([("a", "2026-01-01 00:10:00"), ("a", "2026-01-01 00:20:00"), ("b", "2026-01-01 05:00:00")], "tool string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    timed.write.parquet(str(tmp_path / "timed"))
    q = jobs.windowed_usage(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "timed"))).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["tool"], r["calls"]) for r in spark.table("hours").collect()} == {("a", 2), ("b", 1)}
    spark.createDataFrame([("i", 1), ("i", 5)], "index_id string, at long").write.parquet(str(tmp_path / "used"))
    q = jobs.last_access(spark.readStream.schema("index_id string, at long").parquet(str(tmp_path / "used"))).writeStream.outputMode("complete").format("memory").queryName("used").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("used").collect()] == [("i", 5)]


def test_refresh_stream_sees_each_scan_once(spark, tmp_path):
    ddl = "index_id string, path string, size long, mtime_ms long, content_hash string, scanned_at timestamp"
    spark.createDataFrame([("i", "a", 1, 1, "x", None), ("i", "b", 1, 1, "y", None)], ddl).write.parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([("1", "i", "a", 1, 1, "x", False, 1)], "id string, index_id string, path string, size long, mtime_ms long, content_hash string, deleted boolean, last_indexed_at long")
    seen = []

    def process(rows, number):
        seen.extend((number, r["path"], r["change"]) for r in rows.collect())

    for _ in range(2):  # the second run finds nothing new
        jobs.refresh(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), lambda: stored, process, str(tmp_path / "state")).awaitTermination()
    assert seen == [(0, "b", "new")]
