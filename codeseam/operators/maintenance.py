"""Keeping indexes fresh: snapshot diffs, pending work, deletions, retention, leases and versions.

Tables are immutable; a change is a new table. Times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codeseam.session import broadcast_if_small

HOUR, DAY = 3_600_000, 86_400_000
#: Versions of the stored tables; a newer one than the last is refused.
SCHEMA_VERSIONS = {1: "base tables", 2: "chunker and chunker_version of chunks", 3: "layout by index and path"}


def latest_state(files: DataFrame) -> DataFrame:
    """The newest row of each index and path (ties: the greatest id)."""
    rest = [c for c in files.columns if c not in ("index_id", "path")]
    first = ["last_indexed_at", "id"]
    newest = files.groupBy("index_id", "path").agg(F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("s"))
    return newest.select("index_id", "path", *[F.col(f"s.{c}").alias(c) for c in rest])


def stale_paths(chunks: DataFrame, version: int = 2) -> DataFrame:
    """Paths with chunks of no or an older chunker."""
    return chunks.where(F.col("chunker_version").isNull() | (F.col("chunker_version") < version)).select("index_id", "path").distinct()


def diff(scanned: DataFrame, stored: DataFrame, chunks: DataFrame | None = None, by_hash: bool = False) -> DataFrame:
    """``index_id, path, change`` with ``new, changed, deleted, unchanged``.

    A stored path is changed if its size or time differs, or if its chunks are stale; with ``by_hash`` its content
    hash counts in place of both. Deleted rows of the store count as not stored. Of several scans of a path the newest
    counts.
    """
    cols = ["content_hash"] if by_hash else ["size", "mtime_ms"]
    scan = scanned.groupBy("index_id", "path").agg(F.max(F.struct("scanned_at", "size", "mtime_ms", F.lower("content_hash").alias("content_hash"))).alias("n"))
    have = latest_state(stored).where(~F.coalesce("deleted", F.lit(False))).select("index_id", "path", F.struct("size", "mtime_ms", F.lower("content_hash").alias("content_hash")).alias("o"))
    both = scan.join(have, ["index_id", "path"], "full")
    if chunks is not None:
        both = both.join(stale_paths(chunks).withColumn("stale", F.lit(True)), ["index_id", "path"], "left")
    else:
        both = both.withColumn("stale", F.lit(False))
    same = F.lit(True)
    for c in cols:
        same &= F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.coalesce("stale", F.lit(False)) | ~same, "changed").otherwise("unchanged")
    return both.select("index_id", "path", change.alias("change"))


def split_work(changes: DataFrame, budget: int) -> DataFrame:
    """``index_id, path, change, work``: the first ``budget`` changed and new paths of each index in order are ``now``,
    the others ``pending``; deletions are always ``now``."""
    todo = changes.where(F.col("change").isin("new", "changed", "deleted"))
    order = W.partitionBy("index_id").orderBy("change", "path")
    now = todo.where(F.col("change") != "deleted").withColumn("n", F.row_number().over(order)).where(F.col("n") <= budget).select("index_id", "path", F.lit("now").alias("work"))
    return todo.join(now, ["index_id", "path"], "left").select(
        "index_id", "path", "change", F.when(F.col("change") == "deleted", "now").otherwise(F.coalesce("work", F.lit("pending"))).alias("work")
    )


def mark_stale(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """``rows`` with ``stale``: whether their path is still to be indexed."""
    p = pending.select("index_id", "path").distinct().withColumn("stale", F.lit(True))
    return rows.join(p, ["index_id", "path"], "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def missing_paths(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored paths that the scan lacks."""
    return stored.where(~F.coalesce("deleted", F.lit(False))).select("index_id", "path").distinct().join(scanned.select("index_id", "path").distinct(), ["index_id", "path"], "left_anti")


def without_paths(table: DataFrame, gone: DataFrame, column: str = "path") -> DataFrame:
    """``table`` without the rows of these paths."""
    g = gone.select(F.col("index_id").alias("_i"), F.col("path").alias("_p")).distinct()
    return table.join(g, (F.col("index_id") == F.col("_i")) & (F.col(column) == F.col("_p")), "left_anti")


def without_edges(edges: DataFrame, gone: DataFrame, mode: str = "both") -> DataFrame:
    """Edges without those that begin at the paths (``out``), or that begin or end there (``both``)."""
    kept = without_paths(edges, gone, "from_path")
    return without_paths(kept, gone, "to_path") if mode == "both" else kept


def without_indexes(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(broadcast_if_small(gone.select("index_id").distinct()), "index_id", "left_anti")


def expiry(strict: bool = False) -> Column:
    """When an index row expires: never if pinned; when it says so; 3 days after its last use if detached, 48 hours for
    a linked worktree, else 14 days. ``strict``: every index that has a worktree path counts as a linked one."""
    last = F.col("last_accessed_at")
    linked = F.col("worktree_path").isNotNull() & (F.col("worktree_path") != "")
    if not strict:
        linked &= ~F.col("worktree_path").eqNullSafe(F.col("repo_root"))
    return (
        F.when(F.col("pinned"), F.lit(None).cast("bigint"))
        .when(F.col("expires_at").isNotNull(), F.col("expires_at"))
        .when(F.col("branch_name") == "DETACHED", last + 3 * DAY)
        .when(linked, last + 48 * HOUR)
        .otherwise(last + 14 * DAY)
    )


def prune(indexes: DataFrame, leases: DataFrame, now: int, active: str | None = None, strict: bool = False) -> DataFrame:
    """``index_id, action, reason`` for each index without a valid lease: ``delete`` if expired, else ``skip`` because
    it is ``active``, ``pinned``, was used within the last hour (``grace``) or is ``valid``."""
    held = leases.where(F.col("expires_at") > now).select(F.col("index_id").alias("id")).distinct()
    rows = indexes.dropDuplicates(["id"]).join(held, "id", "left_anti")
    until = expiry(strict)
    reason = (
        F.when(F.col("id") == F.lit(active), "active")
        .when(F.col("pinned"), "pinned")
        .when(F.lit(now) - F.col("last_accessed_at") < HOUR, "grace")
        .when(until.isNull() | (F.lit(now) < until), "valid")
        .otherwise("expired")
    )
    return rows.select(F.col("id").alias("index_id"), F.when(reason == "expired", "delete").otherwise("skip").alias("action"), reason.alias("reason"))


def drop_target(indexes: DataFrame, index_id: str | None = None, branch: str | None = None, worktree: str | None = None, active: str | None = None) -> DataFrame:
    """The one index that a request to drop means, the last used of several: ``index_id, decision`` with ``drop,
    active`` or ``pinned``; empty if there is none."""
    rows = indexes.where(F.col("id") == index_id) if index_id else indexes.where(F.col("branch_name") == branch)
    if worktree and not index_id:
        rows = rows.where(F.col("worktree_path") == worktree)
    decision = F.when(F.col("id") == F.lit(active), "active").when(F.col("pinned"), "pinned").otherwise("drop")
    return rows.orderBy(F.col("last_accessed_at").desc(), "id").limit(1).select(F.col("id").alias("index_id"), decision.alias("decision"))


def upsert_index(indexes: DataFrame, opened: DataFrame) -> DataFrame:
    """The index log with the opened ones: an index that is opened again is active, has no expiry and a new last use;
    a new one is added. ``opened``: ``id, repo_root, worktree_path, branch_name, head_sha, at``."""
    fresh = opened.select(
        "id", "repo_root", "worktree_path", "branch_name", "head_sha", F.col("at").alias("created_at"), F.col("at").alias("last_accessed_at"),
        F.lit(None).cast("bigint").alias("expires_at"), F.lit(False).alias("pinned"), F.lit("active").alias("status"),
    )
    again = indexes.join(opened.select("id", "at"), "id").select(
        *[
            F.col("at").alias("last_accessed_at") if c == "last_accessed_at" else F.lit(None).cast("bigint").alias(c) if c == "expires_at" else F.lit("active").alias(c) if c == "status" else F.col(c)
            for c in indexes.columns
        ]
    )
    kept = indexes.join(opened.select("id"), "id", "left_anti")
    return kept.unionByName(again).unionByName(fresh.join(indexes.select("id"), "id", "left_anti"))


def check_version(found: int) -> int:
    """The version of stored tables if it can be read; an error if it is newer than this code."""
    if found > max(SCHEMA_VERSIONS):
        raise ValueError(f"tables of version {found} are newer than this code, which knows {max(SCHEMA_VERSIONS)}")
    return found
