"""Queries of the general problems of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeseam.operators import ledger
from codeseam.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pending(*(table(spark, sf_dir, t) for t in ("scanned_files", "files", "index_runs")))


#: The moment at which the ledger is looked at, and how long a run may hold its index.
NOW, TTL = 1_772_006_000_000, 30 * ledger.DAY_MS


def p5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fold(*(table(spark, sf_dir, t) for t in ("scanned_files", "files", "index_runs")), now=NOW, ttl=TTL).drop("done_token")


QUERIES = {"p5_found": p5_found, "p5_ledger": p5_ledger}

_LEDGER = f"""
WITH terms AS (
  SELECT index_id, run_id, state, started_at, lead(started_at) OVER (PARTITION BY index_id ORDER BY started_at) AS until
  FROM (SELECT index_id, started_at, max(run_id) AS run_id, arg_max(state, run_id) AS state
        FROM index_runs WHERE index_id IS NOT NULL AND started_at IS NOT NULL GROUP BY index_id, started_at)
), writes AS (
  SELECT f.index_id, f.path, CASE WHEN NOT coalesce(f.deleted, false) THEN lower(f.content_hash) END AS done_version, t.run_id AS done_token,
         row_number() OVER (PARTITION BY f.index_id, f.path ORDER BY f.last_indexed_at DESC, f.id DESC) AS rn
  FROM files f JOIN terms t ON f.index_id = t.index_id AND f.last_indexed_at >= t.started_at
       AND (t.until IS NULL OR f.last_indexed_at < t.until)
  WHERE t.state = 'ok'
), scans AS (
  SELECT index_id, path, lower(content_hash) AS version,
         row_number() OVER (PARTITION BY index_id, path ORDER BY scanned_at DESC NULLS LAST, lower(content_hash) DESC NULLS LAST) AS rn
  FROM scanned_files
), ledger AS (
  SELECT s.index_id, s.path, s.version, w.done_version, w.done_token,
         CASE WHEN s.version = w.done_version THEN 'done'
              WHEN s.index_id IN (SELECT index_id FROM terms WHERE state = 'running' AND until IS NULL AND started_at <= {NOW} AND started_at + {TTL} > {NOW}) THEN 'leased'
              ELSE 'pending' END AS state
  FROM (SELECT * FROM scans WHERE rn = 1) s
  LEFT JOIN (SELECT * FROM writes WHERE rn = 1) w
    ON s.index_id IS NOT DISTINCT FROM w.index_id AND s.path IS NOT DISTINCT FROM w.path
)
"""

ORACLES = {
    "p5_found": _LEDGER + "SELECT index_id, path FROM ledger WHERE state <> 'done'",
    "p5_ledger": _LEDGER + "SELECT * EXCLUDE (done_token) FROM ledger",
}
