"""Usage roll-ups, index counts and saved contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codeseam.functions import text as X

AVERAGE_FILE_BYTES = 4096
# Tools that find things, and tools whose use is counted.
DISCOVERY = ["search", "explore", "related", "impact"]
TRACKED = [*DISCOVERY, "expand", "save", "load"]

_PART = "array<struct<path:string,sourcePath:string>>"
RESULT_DDL = (
    "path string, target struct<path:string>, "
    + ", ".join(f"{name} {_PART}" for name in ("results", "files", "related", "candidates", "callers", "callees", "affectedFiles", "affectedTests"))
)
_IMPACT = ["callers", "callees", "affectedFiles", "affectedTests", "candidates"]


def count_handles(tool: Column, result: Column) -> Column:
    """How many things a result names; 0 for one that is no JSON."""
    r = F.from_json(result, RESULT_DDL)
    size = lambda name: F.coalesce(F.size(r[name]), F.lit(0))
    impact = sum((F.greatest(size(n), F.lit(0)) for n in _IMPACT), F.lit(0))
    return F.when(tool == "explore", F.greatest(size("files"), F.lit(0))).when(tool == "impact", impact).otherwise(F.greatest(size("results"), F.lit(0)))


def discovery_paths(result: Column) -> Column:
    """All paths of a result in their order."""
    r = F.from_json(result, RESULT_DDL)
    none = F.array().cast("array<string>")
    paths = lambda name: F.coalesce(F.transform(r[name], lambda x: x["path"]), none)
    related = F.coalesce(F.flatten(F.transform(r["related"], lambda x: F.array(x["sourcePath"], x["path"]))), none)
    return F.array_compact(
        F.concat(F.array(r["path"], r["target"]["path"]), paths("results"), paths("files"), related, *[paths(n) for n in ("candidates", "callers", "callees", "affectedFiles", "affectedTests")])
    )


def saved_bytes(tool: Column, result: Column, override: Column | None = None) -> Column:
    """What a call spared its caller: the files it names at their usual size, less what it served; never negative."""
    served = F.octet_length(result)
    guess = F.when(tool.isin(DISCOVERY), F.greatest(F.lit(0), count_handles(tool, result) * AVERAGE_FILE_BYTES - served)).otherwise(0)
    return F.when(override.isNotNull(), F.greatest(F.lit(0), override)).otherwise(guess) if override is not None else guess


def saved_from_files(calls: DataFrame, files: DataFrame, most: int = 50) -> DataFrame:
    """``call_id, saved``: the real sizes of the first ``most`` different files that a call names, less what it served.

    ``calls``: ``call_id, index_id, paths, served``.
    """
    named = calls.select("call_id", "index_id", F.explode(F.slice(F.array_distinct("paths"), 1, most)).alias("path"))
    sizes = files.groupBy("index_id", "path").agg(F.max(F.struct("last_indexed_at", "size")).alias("s")).select("index_id", "path", F.col("s.size").alias("size"))
    total = named.join(sizes, ["index_id", "path"]).groupBy("call_id").agg(F.sum("size").alias("total"))
    saved = F.greatest(F.lit(0), F.coalesce("total", F.lit(0)) - F.col("served"))
    return calls.join(total, "call_id", "left").select("call_id", F.when(F.size("paths") > 0, saved).otherwise(0).cast("bigint").alias("saved"))


def record(events: DataFrame) -> DataFrame:
    """Calls as usage rows ``tool, repo_id, calls, last_called_at, bytes_served, bytes_saved``; errors do not count.

    ``events``: ``tool, repo_root, result_text, is_error, saved_override, at``.
    """
    ok = events.where(~F.coalesce("is_error", F.lit(False)))
    rows = ok.select(
        "tool",
        X.hash_id("", "repo_root", length=16).alias("repo_id"),
        F.col("at"),
        F.octet_length("result_text").alias("served"),
        saved_bytes(F.col("tool"), F.col("result_text"), F.col("saved_override")).alias("saved"),
    )
    return rows.groupBy("tool", "repo_id").agg(F.count("*").alias("calls"), F.max("at").alias("last_called_at"), F.sum("served").alias("bytes_served"), F.sum("saved").alias("bytes_saved"))


def rollup(usage: DataFrame, tracked: list[str] | None = None) -> DataFrame:
    """Usage by tool, by repository and in all, in one pass: ``level, tool, repo_id, calls, last_called_at,
    bytes_served, bytes_saved`` with the levels ``tool, repo, total``."""
    rows = usage.where(F.col("tool").isin(tracked)) if tracked else usage
    sets = rows.groupingSets([[F.col("tool")], [F.col("repo_id")], []], "tool", "repo_id").agg(
        F.sum("calls").alias("calls"), F.max("last_called_at").alias("last_called_at"), F.sum("bytes_served").alias("bytes_served"), F.sum("bytes_saved").alias("bytes_saved"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 1, "tool").when(F.col("g") == 2, "repo").otherwise("total")
    return sets.select(level.alias("level"), "tool", "repo_id", "calls", "last_called_at", "bytes_served", "bytes_saved")


def index_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, index_id, n_rows`` over tables that have an index_id."""
    parts = [t.groupBy("index_id").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "index_id", "n_rows") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def context_id(repo_id: Column | str, name: Column | str) -> Column:
    return X.hash_id("ctx_", repo_id, name, length=16, separator="")


def latest_contexts(log: DataFrame) -> DataFrame:
    """Of an append-only log of saved contexts (``repo_id, name, notes, pinned, items, at, deleted``) the newest of each
    repository and name that is not deleted, its items without repeats."""
    newest = log.groupBy("repo_id", "name").agg(F.max_by(F.struct("notes", "pinned", "items", "at", "deleted"), "at").alias("c"))
    return newest.where(~F.coalesce("c.deleted", F.lit(False))).select(
        context_id("repo_id", "name").alias("id"), "repo_id", "name", "c.notes", "c.pinned", F.array_distinct("c.items").alias("items"), F.col("c.at").alias("last_accessed_at")
    )


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, limited before they are shuffled."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
