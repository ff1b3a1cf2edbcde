"""Relation graphs: edges, bounded traversal, tests and impact, for many start nodes at once.

Edges are ``index_id, from_path, to_path, type, confidence``. Self-edges are stored and never walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codeseam.functions import paths as P
from codeseam.functions.scoring import confidence_label
from codeseam.session import broadcast_if_small, checkpointed, is_small

# The kinds of edges.
EDGE_TYPES = "imports imported_by defines exports references calls tests belongs_to".split()
MAX_DEPTH = 3


def symbol_edges(symbols: DataFrame) -> DataFrame:
    """A file defines its symbols, its symbols belong to it, and it exports some."""
    kinds = F.array_compact(F.array(F.lit("defines"), F.lit("belongs_to"), F.when(F.col("exported"), "exports")))
    return symbols.dropDuplicates(["id"]).select("index_id", F.col("path").alias("from_path"), F.col("path").alias("to_path"), F.explode(kinds).alias("type"), F.lit(1.0).alias("confidence"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports``: ``index_id, path, spec``. Adds ``to_path``, the first candidate that is a file of the index;
    imports that mean none are left out."""
    known = files.select("index_id", F.col("path").alias("candidate")).distinct()
    tried = imports.distinct().select("*", F.posexplode(P.import_candidates("path", "spec")).alias("at", "candidate"))
    keys = imports.columns
    return tried.join(known, ["index_id", "candidate"]).groupBy(*keys).agg(F.min_by("candidate", "at").alias("to_path"))


def test_edges(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """From each test file to the files it tests by name, as far as they exist among ``known`` (or these files)."""
    known = (files if known is None else known).select("index_id", F.col("path").alias("to_path")).distinct()
    tests = files.where(P.is_test("path")).select("index_id", F.col("path").alias("from_path")).distinct()
    wanted = tests.select("*", F.explode(P.test_targets("from_path")).alias("to_path"))
    return wanted.join(known, ["index_id", "to_path"], "left_semi").select("index_id", "from_path", "to_path", F.lit("tests").alias("type"), F.lit(0.8).alias("confidence"))


def _steps(edges: DataFrame, types: list[str] | None, direction: str, frontier: DataFrame | None = None) -> DataFrame:
    """``index_id, node, next, type, confidence`` in the direction of walking, without self-edges and repeats.

    ``frontier``: ``index_id, node`` from which steps are wanted. If it is measured to be small only steps from there are
    read off the edges, before anything is shuffled; else the join that follows takes it into account.
    """
    e = edges.where(F.col("from_path") != F.col("to_path"))
    if types is not None:
        e = e.where(F.col("type").isin(*types))
    out = e.select("index_id", F.col("from_path").alias("node"), F.col("to_path").alias("next"), "type", "confidence")
    back = e.select("index_id", F.col("to_path").alias("node"), F.col("from_path").alias("next"), "type", "confidence")
    pruned = frontier is not None and is_small(frontier)
    if pruned:
        out, back = (x.join(F.broadcast(frontier), ["index_id", "node"], "left_semi") for x in (out, back))
    steps = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    if pruned:  # few steps can lead to many rows, so they are laid on all cores, whatever their size
        context = edges.sparkSession.sparkContext
        steps = steps.repartition(2 * context.defaultParallelism, "index_id", "node", "next", "type")
    return steps.groupBy("index_id", "node", "next", "type").agg(F.max("confidence").alias("confidence"))


#: A node with more steps than this is met by several tasks, each with a share of its steps.
HUB_STEPS = 50_000


def _walked(reached: DataFrame, steps: DataFrame) -> DataFrame:
    """``reached`` (``index_id, start, node``) with the steps from each node. A hub's steps are never in one task: a small
    ``reached`` goes to where the steps are, which lie apart; else both sides of a hub are split in as many parts as it needs."""
    if is_small(reached):
        return steps.join(F.broadcast(reached), ["index_id", "node"])
    hubs = steps.groupBy("index_id", "node").count().where(F.col("count") > HUB_STEPS)
    hubs = broadcast_if_small(checkpointed(hubs.select("index_id", "node", F.ceil(F.col("count") / HUB_STEPS).cast("int").alias("_parts"))))
    parts = F.coalesce("_parts", F.lit(1))
    many = steps.join(hubs, ["index_id", "node"], "left").withColumn("_part", F.pmod(F.xxhash64("next"), parts).cast("int")).drop("_parts")
    from_ = reached.join(hubs, ["index_id", "node"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return from_.join(many, ["index_id", "node", "_part"]).drop("_part")


def neighbors(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, depth: int = 2, direction: str = "both") -> DataFrame:
    """``starts``: ``index_id, start``. Gives ``index_id, start, path, edge_type, hops, confidence``.

    A neighbour is reached by a simple path of at most ``depth`` steps (1 to 3); for each neighbour and type of the last
    step the fewest steps and the greatest confidence of a last step are given. Paths are not listed: for the third
    step it is enough to know two different first stops on the way to its second, as then one of them is not the
    node that is reached. So rows grow with the nodes reached and not with the paths. Edges are pruned by the nodes that a
    step sets out from, and the partial results cut the lineage, so no step is walked twice.
    """
    depth = min(max(1, depth), MAX_DEPTH)
    begin = checkpointed(starts.select("index_id", "start").distinct())
    frontier = lambda rows, column: rows.select("index_id", F.col(column).alias("node")).distinct()
    one = _walked(begin.withColumn("node", F.col("start")), _steps(edges, types, direction, frontier(begin, "start"))).drop("node")
    one = checkpointed(one) if depth > 1 else one
    rows = one.select("index_id", "start", F.col("next").alias("path"), "type", "confidence", F.lit(1).alias("hops"))
    if depth > 1:
        reached = one.select("index_id", "start", F.col("next").alias("node")).distinct()
        two = _walked(reached, _steps(edges, types, direction, frontier(one, "next"))).where(F.col("next") != F.col("start"))
        two = checkpointed(two) if depth > 2 else two
        rows = rows.unionByName(two.select("index_id", "start", F.col("next").alias("path"), "type", "confidence", F.lit(2).alias("hops")))
    if depth > 2:
        ways = two.groupBy("index_id", "start", F.col("next").alias("node")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
        three = _walked(ways, _steps(edges, types, direction, frontier(two, "next"))).where(
            (F.col("next") != F.col("start")) & ~((F.col("low") == F.col("high")) & (F.col("low") == F.col("next")))
        )
        rows = rows.unionByName(three.select("index_id", "start", F.col("next").alias("path"), "type", "confidence", F.lit(3).alias("hops")))
    return rows.groupBy("index_id", "start", "path", F.col("type").alias("edge_type")).agg(F.min("hops").alias("hops"), F.max("confidence").alias("confidence"))


def ordered(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Neighbours of each start (or of other ``keys``) with their place ``n`` from 1: fewest hops, then greatest confidence,
    then edge type and path."""
    w = W.partitionBy(*(keys or ["index_id", "start"])).orderBy("hops", F.col("confidence").desc(), "edge_type", "path")
    return rows.withColumn("n", F.row_number().over(w))


def tests_for(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets``: ``index_id, start``. The test files of each, as ``index_id, start, path, edge_type, hops, confidence``."""
    e = edges.where(F.col("type") == "tests").select("index_id", F.col("to_path").alias("start"), F.col("from_path").alias("path"), "confidence")
    found = e.join(broadcast_if_small(targets.select("index_id", "start").distinct()), ["index_id", "start"])
    return found.groupBy("index_id", "start", "path").agg(F.max("confidence").alias("confidence")).select(
        "index_id", "start", "path", F.lit("tests").alias("edge_type"), F.lit(1).alias("hops"), "confidence"
    )


def best_handles(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each start, path and edge type: the fewest hops, then the greatest confidence."""
    keep = extra or []
    best = rows.groupBy("index_id", "start", "path", "edge_type").agg(F.max(F.struct(-F.col("hops"), "confidence", *keep)).alias("b"))
    return best.select("index_id", "start", "path", "edge_type", (-F.col("b").getField("col1")).alias("hops"), F.col("b.confidence").alias("confidence"), *[F.col(f"b.{k}").alias(k) for k in keep])


def impact(edges: DataFrame, targets: DataFrame, depth: int = 2, include_tests: bool = True) -> DataFrame:
    """What a change of each target touches: ``index_id, start, relation, path, edge_type, hops, confidence,
    provenance, confidence_label`` with the relations ``caller, callee, affected_file, affected_test``."""
    targets = checkpointed(targets.select("index_id", "start").distinct())
    callers = checkpointed(neighbors(edges, targets, ["calls", "references", "imports", "imported_by"], depth, "in"))
    callees = neighbors(edges, targets, ["calls", "references", "imports"], depth, "out")
    # what else could be affected walks over a part of the callers' edges, so only its hops and confidence could differ
    affected = best_handles(callers.unionByName(neighbors(edges, targets, ["imported_by", "references", "calls"], depth, "in")))
    graph = F.lit("graph").alias("provenance")
    out = [
        callers.select("*", graph, F.lit("caller").alias("relation")),
        callees.select("*", graph, F.lit("callee").alias("relation")),
        affected.select("*", graph, F.lit("affected_file").alias("relation")),
    ]
    label = confidence_label(F.col("confidence"))
    if include_tests:
        direct = tests_for(edges, targets).select("*", graph)
        via = tests_for(edges, affected.select("index_id", F.col("path").alias("start"))).select("index_id", F.col("start").alias("via"), F.col("path").alias("test"), "confidence")
        far = affected.select("index_id", "start", F.col("path").alias("via")).distinct().join(via, ["index_id", "via"]).select(
            "index_id", "start", F.col("test").alias("path"), F.lit("tests").alias("edge_type"), F.lit(1).alias("hops"), "confidence", graph
        )
        named = affected.where(P.is_impact_test("path")).select(
            "index_id", "start", "path", F.lit("tests").alias("edge_type"), "hops", F.least("confidence", F.lit(0.6)).alias("confidence"), F.lit("path-heuristic").alias("provenance")
        )
        tests = best_handles(direct.unionByName(far).unionByName(named), ["provenance"])
        out.append(tests.select("index_id", "start", "path", "edge_type", "hops", "confidence", "provenance", F.lit("affected_test").alias("relation")))
    rows = out[0]
    for one in out[1:]:
        rows = rows.unionByName(one)
    return rows.withColumn("confidence_label", F.when(F.col("provenance") == "path-heuristic", "medium").otherwise(label))


def resolve_symbol(symbols: DataFrame, names: DataFrame, most: int = 20) -> DataFrame:
    """``names``: ``index_id, wanted``. The symbols of exactly that name, or where there is none, those that contain it;
    at most ``most`` for each name in the order of path and line, as ``index_id, wanted, id, path, name, kind,
    signature, start_line, end_line, exact``."""
    s = symbols.dropDuplicates(["id"]).select("index_id", "id", "path", "name", "kind", "signature", "start_line", "end_line")
    wanted = broadcast_if_small(names.select("index_id", "wanted").distinct())
    exact = s.join(wanted, (s["index_id"] == wanted["index_id"]) & (F.col("name") == F.col("wanted"))).drop(wanted["index_id"]).withColumn("exact", F.lit(True))
    rest = broadcast_if_small(wanted.join(exact.select("index_id", "wanted").distinct(), ["index_id", "wanted"], "left_anti"))
    part = s.join(rest, "index_id").where(F.contains("name", "wanted")).withColumn("exact", F.lit(False))
    order = W.partitionBy("index_id", "wanted").orderBy("path", "start_line", "id")  # limited before it is shuffled
    return exact.unionByName(part).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
