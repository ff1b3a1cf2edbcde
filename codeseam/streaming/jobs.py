"""Structured Streaming counterparts: usage roll-ups, file refreshes and last accesses.

Each takes a streaming DataFrame and gives one, or starts a query; with ``availableNow`` a run over the same rows gives
the result of the batch operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeseam.operators import maintenance as M


def usage_rollup(events: DataFrame) -> DataFrame:
    """Calls, bytes and the last call of each tool and repository, in update mode.

    ``events``: ``tool, repo_id, at, served, saved``. The state is one row for each pair.
    """
    return events.groupBy("tool", "repo_id").agg(F.count("*").alias("calls"), F.max("at").alias("last_called_at"), F.sum("served").alias("bytes_served"), F.sum("saved").alias("bytes_saved"))


def windowed_usage(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls of each tool and hour by event time ``ts``; what is later than ``late`` is dropped with the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "tool").agg(F.count("*").alias("calls")).select("window.start", "tool", "calls")


def refresh(scans: DataFrame, stored: Callable[[], DataFrame], process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Index new scan rows as they come: each micro-batch is set against the stored files, and what is new or changed
    is given to ``process`` with the batch's number.

    ``process`` must write under that number and overwrite: a batch that is repeated after a failure then replaces what
    its first try left. The trigger takes what is there and ends; another trigger is set by the caller's schedule.
    """

    def batch(rows: DataFrame, number: int) -> None:
        process(M.diff(rows, stored()).where(F.col("change").isin("new", "changed")), number)

    return scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_access(events: DataFrame) -> DataFrame:
    """The last use of each index, in update mode: what retention looks at. ``events``: ``index_id, at``."""
    return events.groupBy("index_id").agg(F.max("at").alias("last_accessed_at"))
