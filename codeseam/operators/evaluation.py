"""Evaluating retrieval: tasks from the index, arms, metrics, intervals and thresholds."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codeseam.functions import paths as P
from codeseam.functions import scoring as S
from codeseam.functions import text as X
from codeseam.operators import graph
from codeseam.session import broadcast_if_small, checkpointed

TASK_TYPES = ["locate", "callers", "tests", "history"]
ARMS = ["full", "lexical", "fts-only", "rg"]
# The metrics, and what is added to the seed of each one's interval.
METRICS = {"success_rate": 11, "recall": 23, "rr": 37, "precision": 41}
# What a run has to reach.
THRESHOLDS = {"recall": 0.6, "rr": 0.5, "success_rate": 0.7, "graph_precision": 0.5}



def task_id(kind: Column | str, query: Column, paths: Column) -> Column:
    digest = F.sha2(F.concat_ws("\0", query, F.array_join(paths, "\0")), 256)
    return F.concat(kind if isinstance(kind, Column) else F.lit(kind), F.lit("-"), F.substring(digest, 1, 12))


def _hashed(seed: int, key: str) -> Column:
    """A fixed order that looks like none, for any number of rows."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def locate_tasks(symbols: DataFrame) -> DataFrame:
    """``id, type, query, symbol, expected_paths`` for each exported symbol outside generated code that can be looked
    for without its name; one for each query and path."""
    rows = symbols.where(F.col("exported") & ~P.is_generated("path")).select("name", "path", P.symbol_query("name", "path").alias("query"))
    rows = rows.where((F.col("query") != "") & (F.lower("query") != F.lower("name")))
    one = rows.groupBy("query", "path").agg(F.min("name").alias("symbol"))
    paths = F.array("path")
    return one.select(task_id("locate", F.col("query"), paths).alias("id"), F.lit("locate").alias("type"), "query", "symbol", paths.alias("expected_paths"))


def expected_callers(edges: DataFrame) -> DataFrame:
    """``to_path, n, first, last``: by how many files each path is imported, called or referred to, and the first and last of
    them in order; no list is gathered."""
    rows = edges.where(F.col("type").isin("imports", "calls", "references") & (F.col("from_path") != F.col("to_path")))
    return rows.groupBy("to_path").agg(F.countDistinct("from_path").alias("n"), F.min("from_path").alias("first"), F.max("from_path").alias("last"))


def relationship_tasks(edges: DataFrame, kind: str, most: int = 20) -> DataFrame:
    """``id, type, query, target_path, expected_paths`` for each path that others call (``callers``) or test
    (``tests``). The first ``most`` expected paths are listed; the id is of all of them, by their number and the sum of
    their hashes, so that no list of a hub's callers is ever gathered.
    """
    types = ["tests"] if kind == "tests" else ["imports", "calls", "references"]
    rows = edges.where(F.col("type").isin(types) & (F.col("from_path") != F.col("to_path"))).select("from_path", "to_path").distinct()
    digest = F.sum(F.conv(F.substring(F.sha2("from_path", 256), 1, 12), 16, 10).cast("decimal(38,0)"))
    all_ = rows.groupBy("to_path").agg(F.count("*").alias("n"), digest.alias("sum"))
    order = W.partitionBy("to_path").orderBy("from_path")  # limited before it is shuffled
    first = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    listed = first.groupBy("to_path").agg(F.array_sort(F.collect_list("from_path")).alias("expected_paths"))
    query = F.concat(F.lit("tests for " if kind == "tests" else "callers of "), P.module_subject("to_path"))
    of_all = F.array(F.col("n").cast("string"), F.col("sum").cast("string"))
    return all_.join(listed, "to_path").select(task_id(kind, query, of_all).alias("id"), F.lit(kind).alias("type"), query.alias("query"), F.col("to_path").alias("target_path"), "expected_paths")


# Fixed value: subjects of commits that say nothing.
_EMPTY_SUBJECT = r"(?i)^(merge|release|chore\b|bump\b|v?\d+\.\d+\.\d+)"


def usable_subject(subject: Column | str) -> Column:
    """A commit's subject that says something."""
    s = X._col(subject)
    return F.length(s).between(10, 160) & ~s.rlike(_EMPTY_SUBJECT)


def history_tasks(commits: DataFrame, known: DataFrame, most: int = 12) -> DataFrame:
    """``commits``: ``sha, subject, paths``. A task for each commit with a usable subject that names none of its files;
    its known files, at most ``most``, are expected."""
    rows = commits.where(usable_subject("subject")).select("sha", "subject", F.posexplode(F.array_distinct("paths")).alias("at", "path"))
    there = rows.join(known.select("path").distinct(), "path", "left_semi")
    one = there.groupBy("sha", "subject").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]), 1, most).alias("expected_paths"))
    named = F.exists("expected_paths", lambda p: F.contains(F.lower("subject"), F.lower(P.basename(p))))
    return one.where(~named).select(task_id("history", F.col("subject"), F.col("expected_paths")).alias("id"), F.lit("history").alias("type"), F.col("subject").alias("query"), "expected_paths")


def assembled(tasks: DataFrame, limit: int, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """The tasks of an evaluation (``id, type`` and others): the types in turns, each in a fixed order by hash of the seed and
    the id, each id once; the first ``limit`` with their number ``n`` from 0."""
    once = tasks.dropDuplicates(["id"]).withColumn("pos", F.struct(_hashed(seed, "id"), "id"))
    return interleave(once, limit, order).drop("pos")


def interleave(tasks: DataFrame, limit: int, order: list[str] | None = None) -> DataFrame:
    """Tasks in turns of the types, ``type, pos`` giving each task's place in its type; the first ``limit`` with their
    number ``n`` from 0."""
    kinds = order or TASK_TYPES
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("type"))
    nth = F.row_number().over(W.partitionBy("type").orderBy("pos"))  # limited before it is shuffled
    first = tasks.withColumn("turn", nth).where(F.col("turn") <= limit).withColumn("place", place)
    w = W.orderBy("turn", "place")  # over at most limit rows of each type
    return first.withColumn("n", F.row_number().over(w) - 1).where(F.col("n") < limit).drop("turn", "place")


def numbered(rows: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """``rows`` with their number from 0 within ``key`` in the order of ``order``, however many a key has: rows are laid out
    in ranges, counted by range, and numbered within each."""
    laid = checkpointed(rows.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a key
    offset = laid.groupBy(key, "_range").count().select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy(key, "_range").orderBy(order)) - 1
    both = laid.withColumn(into, within).join(broadcast_if_small(offset), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return both.withColumn(into, F.col(into) + F.col("_offset")).drop("_range", "_key", "_of", "_offset")


def arm_rotation(tasks: DataFrame, repeats: int, arms: list[str] | None = None) -> DataFrame:
    """The order in which each task's arms run in each repeat: ``id, type, repeat, ord, arm``; the n-th task of a type
    begins with arm ``(n + repeat) mod 4``, so each arm comes at each place equally often."""
    names = arms or ARMS
    rows = numbered(tasks, "type", "pos", "nth")
    grid = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("ord"))
    arm = F.get(F.array(*map(F.lit, names)), F.pmod(F.col("nth") + F.col("repeat") + F.col("ord"), F.lit(len(names))).cast("int"))
    return grid.select("id", "type", "repeat", "ord", arm.alias("arm"))


def unique_files(ranked: DataFrame, k: int, keys: list[str], order: list[Column]) -> DataFrame:
    """``keys, found_paths``: of ranked results (``path``, in the given order) the first ``k`` different files."""
    first = ranked.groupBy(*keys, "path").agg(F.min(F.struct(*order)).alias("_first"))
    w = W.partitionBy(*keys).orderBy("_first", "path")  # limited before it is shuffled
    kept = first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_n", "path")))  # of k
    return kept.groupBy(*keys).agg(F.transform(listed, lambda x: x["path"]).alias("found_paths"))


#: So many pages of results are read for ``k`` different files.
PAGES = 4


def retrieval_arms(
    chunks: DataFrame, symbols: DataFrame, edges: DataFrame | None, files: DataFrame, queries: DataFrame, k: int = 10,
    arms: list[str] | None = None, scope: str = "index", stem: bool = True, locale_order: bool = True,
) -> DataFrame:
    """``query_id, arm, found_paths, tool_calls`` for each query that has any: the first ``k`` different files of each arm.

    The arms of the index rank the same candidates with other weights, so these are found once; ``PAGES`` pages of ``k``
    results are read at most. ``rg`` is the search for any of the words in the files themselves.
    """
    from codeseam.operators import search

    arms = arms or ARMS
    weights = {"full": S.WEIGHTS, "lexical": S.LEXICAL, "fts-only": S.FTS_ONLY}
    scored = checkpointed(search.signals(search.candidates(chunks, queries, k, stem=stem, scope=scope), queries, symbols, edges))
    out = None
    for arm in arms:
        if arm in weights:
            rows = search.ranked(scored, weights[arm], locale_order).where(F.col("rank") < PAGES * k)
            found = unique_files(rows, k, ["query_id"], [F.col("rank")])
            pages = rows.groupBy("query_id").agg(F.ceil(F.count("*") / k).cast("int").alias("tool_calls"))
            found = found.join(pages, "query_id")
        else:
            rows = search.grep_baseline(files, queries, k, locale_order)
            found = unique_files(rows, k, ["query_id"], [F.col("rank")]).withColumn("tool_calls", F.lit(1))
        found = found.select("query_id", F.lit(arm).alias("arm"), "found_paths", "tool_calls")
        out = found if out is None else out.unionByName(found)
    return out


def graph_arm(edges: DataFrame, tasks: DataFrame, k: int = 10) -> DataFrame:
    """``task_id, arm, found_paths, tool_calls``: what the graph says of each task of ``callers`` or ``tests`` (``id, type,
    index_id, target_path``) one step away, the first ``k`` different files by hops, confidence, type and path. A task
    without a target or of another type finds nothing."""
    asked = tasks.where(F.col("type").isin("callers", "tests") & F.col("target_path").isNotNull()).select(F.col("id").alias("task_id"), "type", "index_id", F.col("target_path").alias("start"))
    asked = checkpointed(asked)
    near = graph.impact(edges, asked.select("index_id", "start"), 1)
    relation = F.when(F.col("type") == "tests", "affected_test").otherwise("caller")
    rows = asked.join(near, ["index_id", "start"]).where(F.col("relation") == relation)
    found = unique_files(rows, k, ["task_id"], [F.col("hops"), -F.col("confidence"), F.col("edge_type")])
    none = F.array().cast("array<string>")
    return tasks.select(F.col("id").alias("task_id")).distinct().join(found, "task_id", "left").select("task_id", F.lit("graph").alias("arm"), F.coalesce("found_paths", none).alias("found_paths"), F.lit(1).alias("tool_calls"))


def quality(results: DataFrame, k: int = 5) -> DataFrame:
    """``category, queries, recall, mrr, top1`` for each category and for all (``category`` null): ``results`` has ``category,
    rank``, the place from 1 of the expected path, null where it was not found."""
    rank = F.col("rank")
    sets = results.groupingSets([[F.col("category")], []], "category").agg(
        F.count("*").alias("queries"),
        F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias("recall"),
        F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"),
        F.avg(F.when(rank == 1, 1.0).otherwise(0.0)).alias("top1"),
    )
    return sets.select("category", "queries", "recall", "mrr", "top1")


def freshness_candidate(path: Column | str = "path", language: Column | str = "language", size: Column | str = "size") -> Column:
    """True for a file that a freshness probe may write to: text of a known language, small, no lock file and no test."""
    base = F.lower(P.basename(path))
    known = F.coalesce(X._col(language) != "", F.lit(False)) & (X._col(size) <= 512 * 1024)
    test = X._col(path).rlike(r"(?i)(^|/)(test|tests|__tests__)(/|$)") | base.rlike(r"\.(test|spec)\.")
    return F.coalesce(known & ~F.contains(base, F.lit("lock")) & ~test, F.lit(False))


def freshness_probe(engine, files: DataFrame, seed: int = 42) -> dict[str, object]:
    """Whether an edit and a deletion become visible to a search: a word of its own is added to one file of ``files`` and the
    index refreshed, then the file is left out and the index refreshed again. ``files``: ``index_id, path, language,
    content`` of the engine's index, which is left without that file."""
    free = files.where(freshness_candidate("path", F.coalesce("language", P.language("path")), F.octet_length("content")))
    chosen = free.orderBy(_hashed(seed, "path"), "path").limit(1).head()
    if chosen is None:
        return {"attempted": False, "passed": False, "reason": "no file can be written to"}
    word = "probe" + hashlib.sha256(f"{seed}|{chosen['path']}".encode()).hexdigest()[:12]
    own = F.col("path") == chosen["path"]
    seen = lambda: engine.search(word, snippet="none").where(own).limit(1).count() > 0
    engine.ensure(files)
    engine.refresh(files.withColumn("content", F.when(own, F.concat("content", F.lit(f"\n{word}\n"))).otherwise(F.col("content"))))
    edited = seen()
    engine.refresh(files.where(~own))
    removed = not seen()
    return {"attempted": True, "passed": edited and removed, "path": chosen["path"], "modified_visible": edited, "deleted_removed": removed}


def measure(runs: DataFrame, tasks: DataFrame, k: int) -> DataFrame:
    """``runs`` (``task_id, arm, found_paths``, others kept) with ``recall, rr, precision, success``: of the first ``k``
    different paths found; precision is over k, and over what was found in the arm ``graph``."""
    t = tasks.select(F.col("id").alias("task_id"), F.array_distinct("expected_paths").alias("expected"))
    rows = runs.join(t, "task_id").withColumn("found", F.slice(F.array_distinct("found_paths"), 1, k))
    hits = F.size(F.array_intersect("found", "expected"))
    first = F.array_min(F.filter(F.transform("expected", lambda e: F.array_position("found", e)), lambda at: at > 0))
    n = F.when(F.col("arm") == "graph", F.size("found")).otherwise(F.lit(k))
    return rows.select(
        *runs.columns,
        F.when(F.size("expected") == 0, 0.0).otherwise(hits / F.size("expected")).alias("recall"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"),
        F.when(n <= 0, 0.0).otherwise(hits / n).alias("precision"),
        (hits > 0).alias("success"),
    )


def aggregate(measured: DataFrame, by: list[str], seed: int = 42) -> DataFrame:
    """Means over the repeats of a task and then over tasks, with intervals and latencies, for each group ``by``.

    ``measured`` has ``task_id, recall, rr, precision, success, tool_calls, bytes_served, elapsed_ms``. Latencies are taken
    without gathering a group's runs. The intervals resample a group's tasks in their order, 500 times in Python: where
    they are asked for, four numbers for each task of a group are gathered in one row and have to fit one task of Spark.
    No limit is enforced, so ``by`` has to bound the tasks of a group; no other column depends on that.
    """
    names = list(METRICS)
    used = dict.fromkeys([*by, "task_id", "recall", "rr", "precision", "success", "tool_calls", "bytes_served", "elapsed_ms"])
    keys = [*by, "_all"]  # a key even where ``by`` is empty
    measured = checkpointed(measured.select(*used, F.lit(0).alias("_all")))  # read by each of the aggregations
    per_task = measured.groupBy(*keys, "task_id").agg(F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("recall").alias("recall"), F.avg("rr").alias("rr"), F.avg("precision").alias("precision"))
    values = lambda m: F.transform(F.array_sort(F.collect_list(F.struct("task_id", m))), lambda x: x[m])
    means = per_task.groupBy(*keys).agg(F.count("*").alias("tasks"), *[F.avg(m).alias(m) for m in names], *[values(m).alias(f"_{m}") for m in names])
    totals = measured.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("bytes_served").alias("bytes_served"),
    )
    rows = means.join(totals, keys)
    for percent in (50, 95):
        ranked = exact_nearest_rank(measured, keys, "elapsed_ms", percent).withColumnRenamed("elapsed_ms", f"_{percent}")
        rows = rows.join(ranked, keys, "left")
    rows = rows.select(
        *by, "tasks", "samples", *names, "tool_calls", "bytes_served",
        F.coalesce("_50", F.lit(0.0)).alias("p50_ms"), F.coalesce("_95", F.lit(0.0)).alias("p95_ms"),
        *[S.bootstrap_interval(F.col(f"_{m}"), F.lit(seed + offset)).alias(f"{m}_ci") for m, offset in METRICS.items()],
    )
    return rows


def missed_thresholds(aggregates: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """``aggregates`` with the names of what is below its threshold as ``missed``: of the arm ``graph`` (a column ``arm``)
    recall, success rate and its own limit of precision, of any other recall, rr and success rate."""
    limits = thresholds or THRESHOLDS
    graph_arm_ = F.coalesce(F.col("arm") == "graph", F.lit(False)) if "arm" in aggregates.columns else F.lit(False)
    rules = {"recall": F.col("recall"), "rr": F.when(~graph_arm_, F.col("rr")), "success_rate": F.col("success_rate"), "graph_precision": F.when(graph_arm_, F.col("precision"))}
    return aggregates.withColumn("missed", F.array_compact(F.array(*[F.when(c < limits[m], m) for m, c in rules.items() if m in limits])))


def nested_scales(paths: DataFrame, required: DataFrame, scales: list[int], seed: int) -> DataFrame:
    """``path, pos, scale``: required paths first and the others in a fixed order by hash; a path belongs to every scale
    that is larger than its place, and ``scale`` is the smallest. Smaller scales are thus part of larger ones."""
    need = required.select("path").distinct().withColumn("need", F.lit(0))
    rows = paths.select("path").distinct().join(need, "path", "left").withColumn("need", F.coalesce("need", F.lit(1)))
    top = max(scales)
    order = [F.col("need"), _hashed(seed, "path"), F.col("path")]
    first = rows.orderBy(*order).limit(top)  # the largest scale is what is asked for
    placed = first.withColumn("pos", F.row_number().over(W.orderBy(*order)) - 1)
    scale = F.coalesce(*[F.when(F.col("pos") < s, s) for s in sorted(scales)])
    return placed.select("path", "pos", scale.alias("scale"))


def discovery_proxy(calls: DataFrame) -> DataFrame:
    """``calls``: ``task_id, with_index, calls, bytes``. For each task what the index spares: ``calls_ratio,
    bytes_ratio``, the share that is left without it taken away."""
    per = calls.groupBy("task_id").agg(
        F.sum(F.when(F.col("with_index"), F.col("calls"))).alias("calls_with"), F.sum(F.when(~F.col("with_index"), F.col("calls"))).alias("calls_without"),
        F.sum(F.when(F.col("with_index"), F.col("bytes"))).alias("bytes_with"), F.sum(F.when(~F.col("with_index"), F.col("bytes"))).alias("bytes_without"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, 1 - F.col(a) / F.col(b))
    return per.select("*", ratio("calls_with", "calls_without").alias("calls_ratio"), ratio("bytes_with", "bytes_without").alias("bytes_ratio"))


def task_digest(tasks: DataFrame) -> DataFrame:
    """One row with a hash of the whole task set, whatever its order. The sum of the tasks' hashes stands for their
    list, which is never gathered."""
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct("id", "type", "query", "expected_paths")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return tasks.agg(F.sha2(F.concat_ws(":", F.count("*"), F.sum(each)), 256).alias("digest"))


def exact_nearest_rank(df: DataFrame, keys: list[str], value: str, percent: float, accuracy: int = 1000) -> DataFrame:
    """``keys, value``: of each group the value at the floor of the share of its length, without gathering the group.

    An approximate percentile with a known error brackets the value; what lies below the bracket is counted, and only
    the values inside it, a few thousandths of the group and counted by value, are ordered. Nulls do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    share, error = percent / 100, 2.0 / accuracy
    bracket = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", [max(0.0, share - error), min(1.0, share + error)], accuracy).alias("_b")
    )
    inside = rows.join(bracket, keys).where(F.col("_v") <= F.col("_b")[1])
    below = F.count_if(F.col("_v") < F.col("_b")[0])
    counted = inside.groupBy(*keys).agg(below.alias("_below"), F.first("_n").alias("_n"))
    by_value = inside.where(F.col("_v") >= F.col("_b")[0]).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    target = F.least(F.col("_n") - 1, F.floor(F.lit(share) * F.col("_n")))
    running = F.sum("_c").over(W.partitionBy(*keys).orderBy("_v"))
    placed = by_value.withColumn("_upto", running).join(counted, keys).where(F.col("_below") + F.col("_upto") > target)
    return placed.groupBy(*keys).agg(F.min("_v").alias(value))
