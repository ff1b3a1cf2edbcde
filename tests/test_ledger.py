from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeseam.operators import ledger

SCAN = "index_id string, path string, content_hash string, scanned_at timestamp, token string, state string"
FILE = "id string, index_id string, path string, content_hash string, deleted boolean, last_indexed_at long, token string, version string"
RUN = "run_id long, index_id string, started_at long, finished_at long, state string, until string"


def at(n):
    return datetime(2026, 1, 1, 0, n)


RUNS = [(1, "i", 100, 150, "ok", None), (2, "i", 200, None, "failed", None), (3, "i", 300, 350, "ok", None), (3, "i", 300, 350, "ok", None), (4, "i", 400, None, "running", None), (9, None, 1, 2, "ok", None), (8, "j", None, None, "ok", None)]


def test_only_committed_runs_count(spark):
    scans = [("i", p, h, at(1), None, None) for p, h in [("same", "AB"), ("changed", "b"), ("new", "c"), ("failed", "d"), ("running", "e"), ("early", "f"), ("deleted", "g"), ("nohash", "h")]]
    scans += [("i", "same", "old", at(0), None, None), ("i", "same", "AB", at(1), None, None), ("j", "same", "ab", at(1), None, None), ("i", "unhashed", None, at(1), None, None), (None, None, "x", None, None, None)]
    files = [
        ("1", "i", "same", "ab", False, 120, None, None), ("1", "i", "same", "ab", False, 120, None, None), ("2", "i", "changed", "a", False, 310, None, None), ("3", "i", "failed", "d", False, 210, None, None),
        ("4", "i", "running", "e", False, 410, None, None), ("5", "i", "early", "f", False, 99, None, None), ("6", "i", "deleted", "g", False, 110, None, None), ("7", "i", "deleted", "g", True, 320, None, None),
        ("8", "i", "nohash", None, False, 320, None, None), ("9", "j", "same", "ab", False, 500, None, None), ("0", "i", "unhashed", None, False, 120, None, None), (None, None, None, None, None, None, None, None),
    ]
    args = spark.createDataFrame(scans, SCAN), spark.createDataFrame(files, FILE), spark.createDataFrame(RUNS, RUN)
    rows = ledger.fold(*args).collect()
    assert len(rows) == len({(r["index_id"], r["path"]) for r in rows}) == 11
    done = {(r["index_id"], r["path"]) for r in rows if r["state"] == "done"}
    assert done == {("i", "same")}
    assert ledger.pending(*args).count() == 10
    held = lambda now: {(r["index_id"], r["path"]) for r in ledger.fold(*args, now=now, ttl=50).collect() if r["state"] == "leased"}
    assert held(399) == held(450) == set() and len(held(449)) == 8 and {i for i, _ in held(420)} == {"i"}  # the run of 400 holds what it has not done
    none = [a.limit(0) for a in args]
    assert ledger.pending(none[0], args[1], args[2]).count() == 0
    assert ledger.pending(args[0], none[1], none[2]).count() == 11


def terms(spark, runs):
    return ledger.lease_terms(ledger.run_leases(spark.createDataFrame(runs, RUN), ttl=50), ["index_id"])


def test_a_write_belongs_to_the_last_run_before_it(spark):
    files = [("a", "i", "p", "x", False, t, None, None) for t in (100, 199, 200, 299, 300, 399, 400)]
    got = ledger.accepted(spark.createDataFrame(files, FILE), terms(spark, RUNS), ["index_id"], "last_indexed_at").collect()
    assert sorted((r["last_indexed_at"], r["token"]) for r in got) == [(100, 1), (199, 1), (300, 3), (399, 3)]


def test_stale_tokens_are_rejected(spark):
    """Where writes say their token it has to be that of the term."""
    ddl = "index_id string, at long, token long"
    writes = spark.createDataFrame([("i", 150, 1), ("i", 310, 1), ("i", 310, 3), ("i", 250, 2), ("i", 410, 4), (None, 310, 3), ("i", None, 3), ("i", 310, None)], ddl)
    got = ledger.accepted(writes, terms(spark, RUNS), ["index_id"], "at", "token").collect()
    assert sorted((r["at"], r["token"]) for r in got) == [(150, 1), (310, 3)]
    timed = spark.createDataFrame([("i", 1, 10, 20, True), ("i", 2, 30, None, True)], "index_id string, token long, since long, until long, committed boolean")
    late = ledger.accepted(writes.select("index_id", F.lit(25).alias("at")), ledger.lease_terms(timed, ["index_id"]), ["index_id"], "at")
    assert late.count() == 0  # the lease of 10 ran out at 20


def test_terms_go_on_over_days(spark):
    day = ledger.DAY_MS
    starts = [5, day - 1, day, 4 * day + 7, 4 * day + 9]
    runs = [(n, "i", t, None, "ok", None) for n, t in enumerate(starts)] + [(9, "j", 3 * day, None, "ok", None)]
    got = sorted((r["index_id"], r["since"], r["fenced"]) for r in terms(spark, runs).collect())
    assert got == [*(("i", a, b) for a, b in zip(starts, [*starts[1:], None])), ("j", 3 * day, None)]


@pytest.fixture
def book(spark, tmp_path):
    return ledger.Ledger(spark, f"file://{tmp_path}/ledger")


def states(book, now):
    return {r["item"]: r["state"] for r in book.state(now).collect()}


def test_leases_expire_and_stale_writers_are_rejected(spark, book):
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1"), ("c", "1")], "item string, version string")
    assert states(book, 0) == {}
    book.enqueue(items, 1, now=0)
    book.enqueue(items, 1, now=0)  # a retry of the same batch
    book.enqueue(items, 2, now=1)  # known already
    assert states(book, 1) == {"a": "pending", "b": "pending", "c": "pending"}
    slow = book.lease("slow", 2, now=10, ttl=100)
    assert states(book, 50) == {"a": "leased", "b": "leased", "c": "pending"}
    assert states(book, 111) == {"a": "pending", "b": "pending", "c": "pending"}
    quick = book.lease("quick", 5, now=120, ttl=100)
    assert quick > slow and book.leased(quick).count() == 3
    book.complete(slow, now=130)  # its lease ran out and was passed on
    assert set(states(book, 131).values()) == {"leased"}
    book.complete(quick, now=140, items=items.where(F.col("item") != "c"))
    book.complete(quick, now=140, items=items.where(F.col("item") != "c"))  # a retry
    assert states(book, 150) == {"a": "done", "b": "done", "c": "leased"}
    assert states(book, 1000) == {"a": "done", "b": "done", "c": "pending"}
    book.enqueue(spark.createDataFrame([("a", "2")], "item string, version string"), 3, now=1001)
    assert {(r["item"], r["version"], r["state"]) for r in book.state(1002).collect() if r["item"] == "a"} == {("a", "1", "done"), ("a", "2", "pending")}


def test_half_written_batches_are_not_seen(spark, book, tmp_path):
    book.enqueue(spark.createDataFrame([("a", "1")], "item string, version string"), 1, now=0)
    (tmp_path / "ledger" / "enqueue-1" / "_SUCCESS").unlink()
    assert book.events().count() == 0


def test_a_retried_batch_keeps_its_items(spark, book, tmp_path):
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1")], "item string, version string")
    book.enqueue(items, 1, now=0)
    book.enqueue(items, 1, now=5)  # the first call had succeeded
    assert states(book, 6) == {"a": "pending", "b": "pending"} and book.events().count() == 2
    (tmp_path / "ledger" / "enqueue-1" / "_SUCCESS").unlink()
    book.enqueue(items, 1, now=7)  # it had not
    assert states(book, 8) == {"a": "pending", "b": "pending"} and book.events().count() == 2
    token = book.lease("x", 1, now=10, ttl=100)
    book.complete(token, now=20)
    book.enqueue(items, 1, now=30)
    assert states(book, 31) == {"a": "done", "b": "pending"}
    with pytest.raises(ValueError, match="other items"):
        book.enqueue(spark.createDataFrame([("c", "1")], "item string, version string"), 1, now=40)
    assert states(book, 41) == {"a": "done", "b": "pending"}


def test_completions_of_one_token_add_up(spark, book, tmp_path):
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "item string, version string")
    book.enqueue(items, 1, now=0)
    token = book.lease("x", 3, now=10, ttl=100)
    only = lambda i: items.where(F.col("item") == i)
    book.complete(token, now=20, items=only("a"))
    book.complete(token, now=30, items=only("b"))
    assert states(book, 40) == {"a": "done", "b": "done", "c": "leased"}
    book.complete(token, now=200, items=only("a"))  # a late retry changes nothing
    book.complete(token, now=200, items=only("c"))  # too late
    assert states(book, 201) == {"a": "done", "b": "done", "c": "pending"}
    assert sum(1 for d in (tmp_path / "ledger").iterdir() if d.name.startswith("done-")) == 3


def test_two_owners_never_have_the_same_token(spark, book, tmp_path):
    items = spark.createDataFrame([("a", "1")], "item string, version string")
    book.enqueue(items, 1, now=0)
    (tmp_path / "ledger" / "token-1").touch()  # taken by another at the same moment
    token = book.lease("x", 1, now=10, ttl=100)
    assert token == 2
    other = ledger.Ledger(spark, book.root)
    assert other.lease("y", 1, now=11, ttl=100) == 3 and other.leased(3).count() == 0


def test_compaction_keeps_the_state(spark, book, tmp_path):
    items = spark.createDataFrame([(c, "1") for c in "abcd"], "item string, version string")
    book.enqueue(items, 1, now=0)
    first = book.lease("x", 2, now=10, ttl=10)
    book.complete(first, now=15, items=items.where(F.col("item") == "a"))
    second = book.lease("y", 2, now=30, ttl=100)
    before = sorted(map(tuple, book.state(50).collect()))
    assert {r[2] for r in before} == {"done", "leased", "pending"}
    assert book.compact() == 4 and sorted(map(tuple, book.state(50).collect())) == before
    assert book.events().count() < 12 and book.vacuum() == 4 and sorted(map(tuple, book.state(50).collect())) == before
    book.complete(first, now=60)  # the token has been replaced
    book.complete(second, now=60)
    assert states(book, 61) == {"a": "done", "b": "done", "c": "done", "d": "pending"}
    book.enqueue(items, 2, now=70)
    assert book.compact() == 3 and states(book, 71) == {"a": "done", "b": "done", "c": "done", "d": "pending"}
    (tmp_path / "ledger" / "covers-compact-000000002").unlink()  # one that is not whole is passed over
    assert book._batches()[0] == "compact-000000001"


def test_lease_decision(spark):
    df = spark.createDataFrame([(None, None), ("me", 50), ("you", 50), ("you", 5)], "held string, until long")
    free = ledger.lease_decision(F.col("held"), F.col("until"), F.lit("me"), F.lit(10))
    assert [r[0] for r in df.select(free).collect()] == [True, True, False, True]
