"""Queries of the maintenance, usage and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import options as O
from codeseam.functions import paths as P
from codeseam.functions import scoring as S
from codeseam.operators import evaluation as E
from codeseam.operators import ledger
from codeseam.operators import maintenance as M
from codeseam.operators import usage as U
from codeseam.plans.retrieval import EDGES, edges
from codeseam.plans.textual import _TEST, SPLIT, first_seen
from codeseam.session import table

QUERIES, ORACLES = {}, {}
#: The moment at which retention and leases are looked at.
NOW = 1_772_300_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# -- freshness ---------------------------------------------------------------------------------------------------------

SCAN = "(SELECT index_id, path, size, mtime_ms, lower(content_hash) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY index_id, path ORDER BY scanned_at DESC, size DESC, mtime_ms DESC, lower(content_hash) DESC) AS r FROM scanned_files) WHERE r = 1)"
STORED = "(SELECT index_id, path, size, mtime_ms, lower(content_hash) AS hash, deleted FROM (SELECT *, row_number() OVER (PARTITION BY index_id, path ORDER BY last_indexed_at DESC, id DESC) AS r FROM files) WHERE r = 1)"
_STALE = "(SELECT DISTINCT index_id, path, true AS stale FROM chunks WHERE chunker_version IS NULL OR chunker_version < 2)"
_DIFF = (
    f"d AS (SELECT coalesce(n.index_id, o.index_id) AS index_id, coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' "
    f"WHEN s.stale OR {{0}} THEN 'changed' ELSE 'unchanged' END AS change FROM {SCAN} n FULL JOIN (SELECT * FROM {STORED} WHERE NOT deleted) o ON n.index_id = o.index_id AND n.path = o.path "
    f"LEFT JOIN {_STALE} s ON s.index_id = coalesce(n.index_id, o.index_id) AND s.path = coalesce(n.path, o.path))"
)
_BY_TIME = _DIFF.format("n.size IS DISTINCT FROM o.size OR n.mtime_ms IS DISTINCT FROM o.mtime_ms")


def _changes(spark: SparkSession, sf: str, by_hash: bool = False) -> DataFrame:
    return M.diff(table(spark, sf, "scanned_files"), table(spark, sf, "files"), table(spark, sf, "chunks"), by_hash)


@query(f"WITH {_BY_TIME} SELECT index_id, path, change FROM d")
def freshness_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)


@query("WITH " + _DIFF.format("n.hash IS DISTINCT FROM o.hash") + " SELECT index_id, path, change FROM d")
def freshness_diff_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf, True)


@query(
    f"WITH {_BY_TIME}, w AS (SELECT *, row_number() OVER (PARTITION BY index_id, change = 'deleted' ORDER BY change, path) AS r FROM d WHERE change <> 'unchanged') "
    "SELECT index_id, path, change, CASE WHEN change = 'deleted' OR r <= 5 THEN 'now' ELSE 'pending' END AS work FROM w"
)
def pending_split(spark: SparkSession, sf: str) -> DataFrame:
    return M.split_work(_changes(spark, sf), 5)


@query("SELECT DISTINCT f.index_id, f.path FROM files f WHERE NOT f.deleted AND NOT EXISTS (SELECT 1 FROM scanned_files s WHERE s.index_id = f.index_id AND s.path = f.path)")
def removed_files(spark: SparkSession, sf: str) -> DataFrame:
    return M.missing_paths(table(spark, sf, "scanned_files"), table(spark, sf, "files"))


@query(
    "SELECT index_id, count(*) AS n FROM (SELECT DISTINCT id, index_id, path FROM chunks) c WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.deleted AND f.index_id = c.index_id AND f.path = c.path) GROUP BY 1"
)
def delete_file_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", "index_id", "path").distinct()
    return M.without_paths(c, table(spark, sf, "files").where("deleted")).groupBy("index_id").agg(F.count("*").alias("n"))


def _gone(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where(F.col("p_partkey") % 7 == 0)
    return p.select(F.lit("all").alias("index_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))


@query(EDGES + ", g AS (SELECT 'p' || p_partkey AS path FROM part WHERE p_partkey % 7 = 0) SELECT type, count(*) AS n FROM e WHERE a NOT IN (SELECT path FROM g) GROUP BY 1")
def delete_file_edges_out(spark: SparkSession, sf: str) -> DataFrame:
    return M.without_edges(edges(spark, sf), _gone(spark, sf), "out").groupBy("type").agg(F.count("*").alias("n"))


@query(EDGES + ", g AS (SELECT 'p' || p_partkey AS path FROM part WHERE p_partkey % 7 = 0) SELECT type, count(*) AS n FROM e WHERE a NOT IN (SELECT path FROM g) AND b NOT IN (SELECT path FROM g) GROUP BY 1")
def delete_file_edges_both(spark: SparkSession, sf: str) -> DataFrame:
    return M.without_edges(edges(spark, sf), _gone(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT c.index_id, count(DISTINCT c.id) AS n FROM chunks c WHERE c.index_id NOT IN (SELECT id FROM index_rows WHERE status = 'deleted') GROUP BY 1")
def delete_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "index_rows").where(F.col("status") == "deleted").select(F.col("id").alias("index_id"))
    return M.without_indexes(table(spark, sf, "chunks"), gone).groupBy("index_id").agg(F.countDistinct("id").alias("n"))


# -- retention and leases ----------------------------------------------------------------------------------------------

_LINKED = "(worktree_path IS NOT NULL AND worktree_path <> '' {0})"
_EXPIRY = (
    "CASE WHEN pinned THEN NULL WHEN expires_at IS NOT NULL THEN expires_at WHEN branch_name = 'DETACHED' THEN last_accessed_at + 3 * 86400000 "
    "WHEN " + _LINKED + " THEN last_accessed_at + 48 * 3600000 ELSE last_accessed_at + 14 * 86400000 END"
)
_OTHER = "AND worktree_path IS DISTINCT FROM repo_root"


def _leases(spark: SparkSession, sf: str) -> DataFrame:
    """A running run holds its index until six hours after its start."""
    r = table(spark, sf, "index_runs").where(F.col("state") == "running")
    return r.select("index_id", F.col("run_id").cast("string").alias("owner"), (F.col("started_at") + 6 * M.HOUR).alias("expires_at"))


@query("SELECT id AS index_id, coalesce(" + _EXPIRY.format(_OTHER) + ", -1) AS until, coalesce(" + _EXPIRY.format("") + ", -1) AS until_strict FROM index_rows")
def index_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "index_rows").select(F.col("id").alias("index_id"), F.coalesce(M.expiry(), F.lit(-1)).alias("until"), F.coalesce(M.expiry(True), F.lit(-1)).alias("until_strict"))


_PRUNE = (
    f"SELECT index_id, CASE WHEN reason = 'expired' THEN 'delete' ELSE 'skip' END AS action, reason FROM (SELECT id AS index_id, CASE WHEN pinned THEN 'pinned' WHEN {NOW} - last_accessed_at < 3600000 THEN 'grace' "
    f"WHEN until IS NULL OR {NOW} < until THEN 'valid' ELSE 'expired' END AS reason FROM (SELECT *, {{0}} AS until FROM index_rows) i "
    f"WHERE NOT EXISTS (SELECT 1 FROM index_runs r WHERE r.state = 'running' AND r.index_id = i.id AND r.started_at + 6 * 3600000 > {NOW}))"
)


@query(_PRUNE.format(_EXPIRY.format(_OTHER)))
def ttl_prune(spark: SparkSession, sf: str) -> DataFrame:
    return M.prune(table(spark, sf, "index_rows"), _leases(spark, sf), NOW)


@query(_PRUNE.format(_EXPIRY.format("")))
def ttl_prune_strict(spark: SparkSession, sf: str) -> DataFrame:
    return M.prune(table(spark, sf, "index_rows"), _leases(spark, sf), NOW, strict=True)


@query(
    f"SELECT i.id AS index_id, bool_or(coalesce(r.started_at + 6 * 3600000 > {NOW}, false)) AS held FROM index_rows i LEFT JOIN index_runs r ON r.index_id = i.id AND r.state = 'running' GROUP BY 1"
)
def lease_guard(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "index_rows").select(F.col("id").alias("index_id")).distinct().join(_leases(spark, sf), "index_id", "left")
    free = ledger.lease_decision(F.col("owner"), F.col("expires_at"), F.lit("me"), F.lit(NOW))
    return held.groupBy("index_id").agg(F.bool_or(~free).alias("held"))


@query("SELECT id AS index_id, CASE WHEN pinned THEN 'pinned' ELSE 'drop' END AS decision FROM index_rows WHERE branch_name = 'main' ORDER BY last_accessed_at DESC, id LIMIT 1")
def drop_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return M.drop_target(table(spark, sf, "index_rows"), branch="main")


@query("SELECT status, count(*) AS n, count(expires_at) AS with_expiry FROM (SELECT CASE WHEN created_at % 2 = 0 THEN 'active' ELSE status END AS status, CASE WHEN created_at % 2 = 0 THEN NULL ELSE expires_at END AS expires_at FROM index_rows) GROUP BY 1")
def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "index_rows")
    opened = i.where(F.col("created_at") % 2 == 0).select("id", "repo_root", "worktree_path", "branch_name", "head_sha", F.lit(NOW).alias("at"))
    return M.upsert_index(i, opened).groupBy("status").agg(F.count("*").alias("n"), F.count("expires_at").alias("with_expiry"))


# -- usage -------------------------------------------------------------------------------------------------------------


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    """The events as calls of tools: their type is the tool, their user the repository."""
    e = table(spark, sf, "events").where(F.col("event_type") != "error")
    return e.groupBy(F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("repo_id")).agg(
        F.count("*").alias("calls"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_called_at"), F.sum(F.octet_length("props")).alias("bytes_served"), F.sum(F.greatest(F.lit(0), 100 - F.octet_length("props"))).alias("bytes_saved")
    )


_USAGE = "WITH u AS (SELECT event_type AS tool, user_id::VARCHAR AS repo_id, count(*) AS calls, max(epoch_us(ts) // 1000) AS last_called_at, sum(octet_length(encode(props)))::BIGINT AS bytes_served, sum(greatest(0, 100 - octet_length(encode(props))))::BIGINT AS bytes_saved FROM events WHERE event_type <> 'error' GROUP BY ALL) "
_SUMS = "sum(calls)::BIGINT AS calls, max(last_called_at) AS last_called_at, sum(bytes_served)::BIGINT AS bytes_served, sum(bytes_saved)::BIGINT AS bytes_saved"


@query(_USAGE + f"SELECT tool, {_SUMS} FROM u GROUP BY 1")
def usage_by_tool(spark: SparkSession, sf: str) -> DataFrame:
    return U.rollup(_usage(spark, sf)).where(F.col("level") == "tool").drop("level", "repo_id")


@query(_USAGE + f"SELECT repo_id, {_SUMS} FROM u GROUP BY 1")
def usage_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    return U.rollup(_usage(spark, sf)).where(F.col("level") == "repo").drop("level", "tool")


@query(
    _USAGE + f"SELECT CASE WHEN tool IS NOT NULL THEN 'tool' WHEN repo_id IS NOT NULL THEN 'repo' ELSE 'total' END AS level, tool, repo_id, {_SUMS} FROM u GROUP BY GROUPING SETS ((tool), (repo_id), ())"
)
def usage_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return U.rollup(_usage(spark, sf))


_RESULT = "'{\"results\": [' || array_to_string(list_transform(range(0, user_id % 4), lambda i: '{\"path\": \"p' || i || '\"}'), ', ') || ']}'"


@query(
    f"SELECT tool, repo_id, count(*) AS calls, sum(served)::BIGINT AS bytes_served, sum(saved)::BIGINT AS bytes_saved FROM (SELECT CASE WHEN event_type = 'view' THEN 'search' ELSE 'expand' END AS tool, substr(sha256('/r/' || user_id), 1, 16) AS repo_id, "
    f"octet_length(encode(r)) AS served, CASE WHEN event_type = 'view' THEN greatest(0, (user_id % 4) * 4096 - octet_length(encode(r))) ELSE 0 END AS saved FROM (SELECT *, {_RESULT} AS r FROM events WHERE event_type <> 'error')) GROUP BY ALL"
)
def usage_record(spark: SparkSession, sf: str) -> DataFrame:
    items = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("user_id") % 4), lambda i: F.concat(F.lit('{"path": "p'), i.cast("string"), F.lit('"}')))
    e = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", "search").otherwise("expand").alias("tool"),
        F.concat(F.lit("/r/"), F.col("user_id").cast("string")).alias("repo_root"),
        F.concat(F.lit('{"results": ['), F.array_join(items, ", "), F.lit("]}")).alias("result_text"),
        (F.col("event_type") == "error").alias("is_error"),
        F.lit(None).cast("bigint").alias("saved_override"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
    )
    return U.record(e).select("tool", "repo_id", "calls", "bytes_served", "bytes_saved")


@query(
    "WITH s AS (SELECT index_id, path, arg_max(size, struct_pack(a := last_indexed_at, b := size)) AS size FROM files GROUP BY ALL), c AS (SELECT run_id AS call_id, index_id FROM index_runs), "
    "p AS (SELECT call_id, index_id, path, row_number() OVER (PARTITION BY call_id ORDER BY path) AS r FROM c JOIN (SELECT DISTINCT index_id, path FROM scanned_files) USING (index_id)), "
    "t AS (SELECT call_id, sum(size) AS total FROM p JOIN s USING (index_id, path) WHERE r <= 50 GROUP BY 1) SELECT call_id, greatest(0, coalesce(total, 0) - 1000)::BIGINT AS saved FROM c LEFT JOIN t USING (call_id) WHERE call_id IN (SELECT call_id FROM p)"
)
def usage_saved_estimate(spark: SparkSession, sf: str) -> DataFrame:
    named = U.top_by(table(spark, sf, "scanned_files").select("index_id", "path").distinct(), ["index_id"], [F.col("path")], 60)
    paths = named.groupBy("index_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))  # at most 60 each
    calls = table(spark, sf, "index_runs").select(F.col("run_id").alias("call_id"), "index_id").join(paths, "index_id").withColumn("served", F.lit(1000))
    return U.saved_from_files(calls, table(spark, sf, "files"))


@query(
    "SELECT 'files' AS \"table\", index_id, count(*) AS n_rows FROM files GROUP BY 2 UNION ALL SELECT 'symbols', index_id, count(*) FROM symbols GROUP BY 2 UNION ALL SELECT 'chunks', index_id, count(*) FROM chunks GROUP BY 2"
)
def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    return U.index_counts({t: table(spark, sf, t) for t in ("files", "symbols", "chunks")})


@query(
    "SELECT 'ctx_' || substr(sha256(repo_id || name), 1, 16) AS id, repo_id, name, notes, pinned, n_items, last_accessed_at FROM (SELECT user_id::VARCHAR AS repo_id, event_type AS name, arg_max(props, event_id) AS notes, arg_max(value > 50, event_id) AS pinned, 1::BIGINT AS n_items, max(event_id) AS last_accessed_at, arg_max(event_id % 10 = 0, event_id) AS gone FROM events GROUP BY ALL) WHERE NOT gone"
)
def context_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    item = F.struct(F.lit("h").alias("handle"), F.col("props").alias("path"))
    log = e.select(
        F.col("user_id").cast("string").alias("repo_id"), F.col("event_type").alias("name"), F.col("props").alias("notes"), (F.col("value") > 50).alias("pinned"), F.array(item, item).alias("items"), F.col("event_id").alias("at"), (F.col("event_id") % 10 == 0).alias("deleted")
    )
    return U.latest_contexts(log).select("id", "repo_id", "name", "notes", "pinned", F.size("items").cast("bigint").alias("n_items"), "last_accessed_at")


# -- evaluation --------------------------------------------------------------------------------------------------------


@query(
    "WITH t AS (SELECT doc_id, doc_type AS type, row_number() OVER (PARTITION BY doc_type ORDER BY doc_id) AS pos FROM documents WHERE doc_type IN ('commit', 'issue', 'query', 'review')) "
    "SELECT doc_id, type, n FROM (SELECT *, row_number() OVER (ORDER BY pos, list_position(['query','commit','issue','review'], type)) - 1 AS n FROM t) WHERE n < 100"
)
def task_interleave(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["query", "commit", "issue", "review"]
    t = table(spark, sf, "documents").where(F.col("doc_type").isin(kinds)).select("doc_id", F.col("doc_type").alias("type"), F.col("doc_id").alias("pos"))
    return E.interleave(t, 100, kinds).select("doc_id", "type", F.col("n").cast("bigint").alias("n"))


@query(
    "WITH t AS (SELECT doc_id AS id, doc_type AS type, row_number() OVER (PARTITION BY doc_type ORDER BY doc_id) - 1 AS nth FROM documents WHERE doc_type IN ('commit', 'query')) "
    "SELECT id, type, repeat, ord, ['full','lexical','fts-only','rg'][(nth + repeat + ord) % 4 + 1] AS arm FROM t, (SELECT unnest(range(0, 3)) AS repeat), (SELECT unnest(range(0, 4)) AS ord)"
)
def arm_rotation(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").where(F.col("doc_type").isin("commit", "query")).select(F.col("doc_id").alias("id"), F.col("doc_type").alias("type"), F.col("doc_id").alias("pos"))
    r = E.arm_rotation(t, 3)
    return r.select("id", "type", F.col("repeat").cast("bigint").alias("repeat"), F.col("ord").cast("bigint").alias("ord"), "arm")


_STOP = ", ".join(repr(w) for w in P.QUERY_STOPWORDS)
_STEM = "regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '[._-]+', ' ', 'g')"
_LOCATE = (
    f"WITH s AS (SELECT DISTINCT name, path FROM symbols WHERE exported AND NOT regexp_matches(path, '{P.GENERATED}')), "
    f"a AS (SELECT *, list_filter({first_seen(SPLIT.format('name', 3), 5)}, lambda p: p NOT IN ({_STOP})) AS parts, list_filter(string_split_regex({_STEM}, '[^A-Za-z0-9]+'), lambda p: length(p) >= 3) AS stem FROM s), "
    f"b AS (SELECT *, list_filter({first_seen('list_concat(parts, stem)', 1000)}, lambda p: lower(p) NOT IN ({_STOP})) AS both_ FROM a), "
    "q AS (SELECT name, path, CASE WHEN len(parts) >= 2 THEN array_to_string(parts[1:4], ' ') WHEN len(both_) >= 2 THEN array_to_string(both_[1:4], ' ') ELSE '' END AS query FROM b) "
    "SELECT query, path, min(name) AS symbol, 'locate-' || substr(sha256(query || chr(0) || path), 1, 12) AS id FROM q WHERE query <> '' AND lower(query) <> lower(name) GROUP BY query, path"
)


@query(_LOCATE)
def locate_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return E.locate_tasks(table(spark, sf, "symbols")).select("query", F.get("expected_paths", F.lit(0)).alias("path"), "symbol", "id")


@query(
    EDGES
    + ", d AS (SELECT DISTINCT b AS to_path, a AS from_path FROM e WHERE a <> b AND type IN ('imports', 'calls', 'references')), "
    "x AS (SELECT to_path, count(*) AS n, sum(('0x' || substr(sha256(from_path), 1, 12))::HUGEINT)::HUGEINT AS s, list_sort(list(from_path))[1:20] AS p FROM d GROUP BY 1) "
    "SELECT 'callers-' || substr(sha256('callers of ' || to_path || chr(0) || n || chr(0) || s), 1, 12) AS id, 'callers' AS type, 'callers of ' || to_path AS query, to_path AS target_path, array_to_string(p, ',') AS expected FROM x"
)
def relationship_tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = E.relationship_tasks(edges(spark, sf), "callers")
    return t.select("id", "type", "query", "target_path", F.array_join("expected_paths", ",").alias("expected"))


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as tasks, whose parts are expected; the parts of the customer's other orders are what was found."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    tasks = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("part").alias("expected_paths"))
    found = line.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_list("part")).alias("found_paths"))
    arm = F.when(F.col("task_id") % 3 == 0, "graph").otherwise("full")
    shifted = found.withColumn("found_paths", F.concat(F.array(F.lit("x"), F.lit("x"), F.lit("y")), F.slice("found_paths", 2, 9)))
    return shifted.select("task_id", arm.alias("arm"), "found_paths", F.lit(2).alias("tool_calls"), F.col("task_id").alias("bytes_served"), (F.col("task_id") % 97).cast("double").alias("elapsed_ms")), tasks


_RUNS = (
    "WITH t AS (SELECT l_orderkey AS task_id, list(DISTINCT l_partkey::VARCHAR) AS expected, list_sort(list(l_partkey::VARCHAR)) AS parts FROM lineitem GROUP BY 1), "
    "r AS (SELECT task_id, expected, CASE WHEN task_id % 3 = 0 THEN 'graph' ELSE 'full' END AS arm, list_concat(['x', 'y'], list_filter(parts[2:10], lambda p, i: list_position(parts[2:10], p) = i))[1:5] AS found FROM t), "
    "m AS (SELECT task_id, arm, len(list_intersect(found, expected)) AS hits, len(found) AS n, len(expected) AS e, list_min(list_filter(list_transform(expected, lambda x: coalesce(list_position(found, x), 0)), lambda p: p > 0)) AS first FROM r), "
    "x AS (SELECT task_id, arm, hits / e AS recall, coalesce(1.0 / first, 0.0)::DOUBLE AS rr, hits / (CASE WHEN arm = 'graph' THEN n ELSE 5 END) AS precision, hits > 0 AS success FROM m) "
)


@query(_RUNS + "SELECT task_id, arm, round(recall, 9) AS recall, round(rr, 9) AS rr, round(precision, 9) AS precision, success FROM x")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = E.measure(*_runs(spark, sf), 5)
    return m.select("task_id", "arm", *[F.round(c, 9).alias(c) for c in ("recall", "rr", "precision")], "success")


@query(
    _RUNS + "SELECT task_id % 100 AS grp, count(*) AS tasks, round(avg(success::INT), 9) AS success_rate, round(avg(recall), 9) AS recall, round(avg(rr), 9) AS rr, round(avg(precision), 9) AS precision, sum(2)::BIGINT AS tool_calls, "
    "list_sort(list((task_id % 97)::DOUBLE))[least(count(*), floor(0.50 * count(*))::BIGINT + 1)] AS p50_ms, list_sort(list((task_id % 97)::DOUBLE))[least(count(*), floor(0.95 * count(*))::BIGINT + 1)] AS p95_ms FROM x GROUP BY 1"
)
def eval_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    m = E.measure(*_runs(spark, sf), 5).withColumn("grp", F.col("task_id") % 100)
    a = E.aggregate(m, ["grp"])
    return a.select("grp", "tasks", *[F.round(c, 9).alias(c) for c in E.METRICS], "tool_calls", "p50_ms", "p95_ms")


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    m = E.measure(*_runs(spark, sf), 5).withColumn("grp", F.col("task_id") % 100)
    a = E.missed_thresholds(E.aggregate(m, ["grp"]))
    return a.select("grp", *[F.col(f"{m}_ci.{x}").alias(f"{m}_{x}") for m in E.METRICS for x in ("low", "high")], F.array_join("missed", ",").alias("missed"))


@query(
    "SELECT user_id, list_sort(list(value))[least(count(*), floor(0.5 * count(*))::BIGINT + 1)] AS p50, list_sort(list(value))[least(count(*), floor(0.95 * count(*))::BIGINT + 1)] AS p95 FROM events GROUP BY 1"
)
def nearest_rank_percentile(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    half = E.exact_nearest_rank(e, ["user_id"], "value", 50).withColumnRenamed("value", "p50")
    return half.join(E.exact_nearest_rank(e, ["user_id"], "value", 95).withColumnRenamed("value", "p95"), "user_id")


@query("SELECT event_id, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE round((value - lo) / (hi - lo), 9) END AS fts FROM (SELECT event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id, event_type))")
def minmax_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    bounds = e.groupBy("user_id", "event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # partial sums instead of a window
    return e.join(bounds, ["user_id", "event_type"]).select("event_id", F.round(S.min_max(F.col("value"), F.col("lo"), F.col("hi")), 9).alias("fts"))


@query("SELECT length(text) BETWEEN 10 AND 160 AND NOT regexp_matches(text, '^(merge|release|chore\\b|bump\\b|v?[0-9]+\\.[0-9]+\\.[0-9]+)', 'i') AS usable, count(*) AS n FROM documents WHERE doc_type = 'commit' AND text IS NOT NULL GROUP BY 1")
def history_subjects(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where((F.col("doc_type") == "commit") & F.col("text").isNotNull())
    return d.groupBy(E.usable_subject("text").alias("usable")).agg(F.count("*").alias("n"))


@query("SELECT task_id, sum(CASE WHEN w THEN c END)::BIGINT AS calls_with, sum(CASE WHEN NOT w THEN c END)::BIGINT AS calls_without, round(CASE WHEN sum(CASE WHEN NOT w THEN c END) > 0 THEN 1 - sum(CASE WHEN w THEN c END) / sum(CASE WHEN NOT w THEN c END) END, 9) AS calls_ratio FROM (SELECT user_id AS task_id, event_type = 'view' AS w, 1 AS c FROM events) GROUP BY 1")
def discovery_proxy(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), (F.col("event_type") == "view").alias("with_index"), F.lit(1).alias("calls"), F.octet_length("props").alias("bytes"))
    return E.discovery_proxy(e).select("task_id", "calls_with", "calls_without", F.round("calls_ratio", 9).alias("calls_ratio"))


@query(
    f"WITH p AS (SELECT DISTINCT path FROM corpus_files), need AS (SELECT path FROM p WHERE {_TEST} ORDER BY path LIMIT 10), "
    "o AS (SELECT p.path, row_number() OVER (ORDER BY need.path IS NULL, sha256('42|' || p.path)) - 1 AS pos FROM p LEFT JOIN need ON need.path = p.path) "
    "SELECT path, pos, CASE WHEN pos < 25 THEN 25 WHEN pos < 100 THEN 100 ELSE 400 END AS scale FROM o WHERE pos < 400"
)
def nested_scales(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "corpus_files").select("path").distinct()
    n = E.nested_scales(f, f.where(P.is_test("path")).orderBy("path").limit(10), [25, 100, 400], 42)
    return n.select("path", F.col("pos").cast("bigint").alias("pos"), "scale")


@query(
    "WITH t AS (SELECT doc_id, doc_type AS type, row_number() OVER (PARTITION BY doc_type ORDER BY sha256('42|' || doc_id)) AS pos FROM documents WHERE doc_type IN ('commit', 'issue', 'query', 'review')) "
    "SELECT doc_id, type, n FROM (SELECT *, row_number() OVER (ORDER BY pos, list_position(['query','commit','issue','review'], type)) - 1 AS n FROM t) WHERE n < 200"
)
def eval_tasks(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["query", "commit", "issue", "review"]
    t = table(spark, sf, "documents").where(F.col("doc_type").isin(kinds)).select(F.col("doc_id").alias("id"), F.col("doc_type").alias("type"))
    return E.assembled(t, 200, 42, kinds).select(F.col("id").alias("doc_id"), "type", F.col("n").cast("bigint").alias("n"))


@query(
    _RUNS + "SELECT coalesce(arm, 'all') AS category, count(*) AS queries, round(avg((first <= 5)::INT), 9) AS recall, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr, round(avg((first = 1)::INT), 9) AS top1 "
    "FROM (SELECT arm, coalesce(first, 99) AS first0, first FROM m) GROUP BY GROUPING SETS ((arm), ())".replace("avg((first <= 5)::INT)", "avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END)").replace("avg((first = 1)::INT)", "avg(CASE WHEN first = 1 THEN 1 ELSE 0 END)")
)
def quality_rollup(spark: SparkSession, sf: str) -> DataFrame:
    runs, tasks = _runs(spark, sf)
    m = E.measure(runs, tasks, 5)
    q = E.quality(m.select(F.col("arm").alias("category"), F.when(F.col("rr") > 0, F.round(1 / F.col("rr"))).alias("rank")))
    return q.select(F.coalesce("category", F.lit("all")).alias("category"), "queries", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "top1")])


@query(
    "SELECT DISTINCT index_id, path FROM corpus_files WHERE coalesce(language, '') <> '' AND octet_length(encode(content)) <= 524288 AND NOT contains(lower(regexp_extract(path, '([^/]*)$', 1)), 'lock') "
    "AND NOT regexp_matches(path, '(^|/)(test|tests|__tests__)(/|$)', 'i') AND NOT regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '\\.(test|spec)\\.')"
)
def freshness_candidates(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "corpus_files").withColumn("size", F.octet_length("content"))
    return f.where(E.freshness_candidate()).select("index_id", "path").distinct()


@query(
    "SELECT DISTINCT size, CASE WHEN size < 1024 THEN size || 'B' WHEN size < 1048576 THEN printf('%.1fKB', floor(size / 1024 * 10 + 0.5) / 10) ELSE printf('%.2fMB', floor(size / 1048576 * 100 + 0.5) / 100) END AS shown FROM files WHERE size >= 0"
)
def bytes_shown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").where(F.col("size") >= 0).select("size", O.bytes_shown(F.col("size")).alias("shown")).distinct()
