"""Processing only new or changed records: a work-item ledger with leases, fencing tokens and done states.

An *item* is a key (here ``index_id, path``) with the version (content hash) that has to be processed. Its life is a
sequence of *events*; the state is a fold over them, so it can be computed for all items at once by aggregations:

``pending``  its present version has not been committed, and nobody holds it;
``leased``   a writer holds it under the newest token, and its lease has not run out;
``done``     its present version was committed by a writer whose token was the newest at that time.

A *lease* (``scope, token, since, until, committed``) holds all items of its scope. Its *term* ends when it runs out or
when the next lease of the scope begins, whichever is first: from then on a write under it is stale and rejected.

``fold`` takes the tables of scans, writes and runs: a run of an index is a lease on all its paths with ``run_id`` as token.
A run that failed has given its lease back and committed nothing, one that is still running has committed nothing yet. A
write is that of the run in whose term it falls. ``Ledger`` stores the events itself, with a lease for each item; its
writers say their token, which is compared with that of the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codeseam.session import broadcast_if_small, checkpointed

ITEM = ["index_id", "path"]
DAY_MS = 86_400_000
#: How long a run may hold its index, if nothing else is said.
LEASE_MS = 2 * DAY_MS


def run_leases(runs: DataFrame, ttl: int = LEASE_MS) -> DataFrame:
    """``index_id, token, since, until, committed``: each run as a lease on its index.

    A run that committed (``ok``) could have gone on until the next lease, as its writes count however late they came; any
    other has its lease for ``ttl``, or none if it failed. Exact duplicate rows count once; of runs that start at the same
    moment the one with the greatest run_id has the lease. Rows without index or start are left out.
    """
    at = F.col("started_at")
    held = F.when(F.col("run.state") == "running", at + ttl).when(F.col("run.state") == "ok", F.lit(None).cast("bigint")).otherwise(at)
    return (
        runs.where(F.col("index_id").isNotNull() & at.isNotNull())
        .groupBy("index_id", "started_at")
        .agg(F.max(F.struct("run_id", "state")).alias("run"))
        .select("index_id", F.col("run.run_id").alias("token"), at.alias("since"), held.alias("until"), F.coalesce(F.col("run.state") == "ok", F.lit(False)).alias("committed"))
    )


def lease_terms(leases: DataFrame, scope: list[str]) -> DataFrame:
    """``leases`` with ``fenced``, the moment at which the next lease of the scope begins (null for the newest).

    A term ends at the next beginning of its day or else at the first of the next day with one: no task holds more than the
    leases of a scope in a day, or the days of a scope.
    """
    rows = leases.withColumn("_day", F.floor(F.col("since") / DAY_MS))
    days = rows.groupBy(*scope, "_day").agg(F.min("since").alias("_first"))
    days = days.select(*scope, "_day", F.lead("_first").over(W.partitionBy(*scope).orderBy("_day")).alias("_next_day"))
    within = F.lead("since").over(W.partitionBy(*scope, "_day").orderBy("since", "token"))
    return rows.withColumn("_next", within).join(days, [*scope, "_day"]).select(*leases.columns, F.coalesce("_next", "_next_day").alias("fenced"))


def accepted(writes: DataFrame, terms: DataFrame, scope: list[str], at: str, token: str | None = None) -> DataFrame:
    """The writes that fall in the term of a lease of their scope that committed, with its ``token``.

    A write before the first lease, after its lease ran out, or under a lease that a newer one has replaced is rejected;
    where the writes say their ``token``, one that is not that of the term is stale as well. Leases are few against
    writes, so they are broadcast if measured to be small, which keeps a hot scope from being gathered in one task;
    otherwise the join shuffles and adaptive skew handling splits a hot scope.
    """
    names = {c: f"_lease_{c}" for c in ("token", "since", "until", "fenced", "committed", *scope)}
    held = broadcast_if_small(terms.where("committed").select(*[F.col(c).alias(n) for c, n in names.items()]))
    time = F.col(at)
    within = (time >= F.col("_lease_since")) & (F.col("_lease_fenced").isNull() | (time < F.col("_lease_fenced")))
    within &= F.col("_lease_until").isNull() | (time <= F.col("_lease_until"))
    for c in scope:
        within &= F.col(c) == F.col(names[c])
    if token:
        within &= F.col(token) == F.col("_lease_token")
    kept = writes.join(held, within)
    return kept.withColumn("token", F.col("_lease_token")).drop(*names.values())


def fold(scans: DataFrame, writes: DataFrame, runs: DataFrame, now: int | None = None, ttl: int = LEASE_MS) -> DataFrame:
    """The ledger: one row for each item of ``scans`` with ``version``, ``done_version``, ``done_token`` and ``state``.

    * ``version`` is the lower-cased hash of the scan row with the greatest ``scanned_at`` (ties: the greatest hash);
    * ``done_version`` that of the accepted write with the greatest ``last_indexed_at`` (ties: the greatest id), null
      if there is none, it is a deletion or it has no hash;
    * ``state`` is ``done`` if both are equal (a null version never equals another), else ``leased`` if the index's newest
      run still runs and its lease has not run out ``now``, else ``pending``. Without ``now`` every lease has run out.

    Rows without index or path are items of their own key (nulls form one group each). Both folds aggregate on the map
    side first, so a hot index or a path with many rows costs no more than its distinct keys.
    """
    terms = lease_terms(run_leases(runs, ttl), ["index_id"])
    present = scans.groupBy(*ITEM).agg(
        F.max(F.struct("scanned_at", F.lower("content_hash").alias("version"))).alias("scan")
    ).select(*ITEM, F.col("scan.version").alias("version"))
    stored = (
        accepted(writes.select(*ITEM, "id", "content_hash", "deleted", "last_indexed_at"), terms, ["index_id"], "last_indexed_at")
        .groupBy(*ITEM)
        .agg(
            F.max(
                F.struct(
                    "last_indexed_at",
                    "id",
                    F.when(~F.coalesce("deleted", F.lit(False)), F.lower("content_hash")).alias("version"),
                    "token",
                )
            ).alias("write")
        )
        .select(
            F.col("index_id").alias("_i"),
            F.col("path").alias("_p"),
            F.col("write.version").alias("done_version"),
            F.col("write.token").alias("done_token"),
        )
    )
    both = present.join(stored, F.col("index_id").eqNullSafe(F.col("_i")) & F.col("path").eqNullSafe(F.col("_p")), "left").drop("_i", "_p")
    done = F.col("version") == F.col("done_version")
    if now is None:
        return both.withColumn("state", F.when(done, "done").otherwise("pending"))
    live = terms.where(~F.col("committed") & F.col("fenced").isNull() & (F.col("since") <= now) & (F.col("until") > now))
    live = broadcast_if_small(live.select(F.col("index_id").alias("_i"), F.lit(True).alias("_held")))  # one for each index at most
    both = both.join(live, F.col("index_id") == F.col("_i"), "left")
    return both.withColumn("state", F.when(done, "done").when(F.col("_held"), "leased").otherwise("pending")).drop("_i", "_held")


def pending(scans: DataFrame, writes: DataFrame, runs: DataFrame) -> DataFrame:
    """The items that must be processed now, each once: those not done, when every lease that has not committed has run out."""
    return fold(scans, writes, runs).where(F.col("state") == "pending").select(*ITEM)


# -- the ledger as stored events ---------------------------------------------------------------------------------------

EVENT_DDL = "item STRING, version STRING, event STRING, token BIGINT, owner STRING, at BIGINT, until BIGINT"
_EVENT = [c.split()[0] for c in EVENT_DDL.split(", ")]


class Ledger:
    """An append-only event table under ``root`` with enqueue, lease, complete, state and compact.

    * ``enqueue`` adds items whose version is not yet known (an anti join);
    * ``lease`` gives up to ``n`` pending items to an owner under a new fencing token, until ``now + ttl``;
    * ``complete`` marks items of a token as done. A token whose lease has run out or was passed to a newer token is
      stale: its completion is written but the fold rejects it;
    * leases that have run out count as pending, without any clean-up.

    Each call appends one batch to a folder named by its content: a retry of a call that had failed replaces its own
    half-written folder, and one of a call that had succeeded changes nothing; a whole batch is never replaced. A token is
    taken by creating its file, which fails if it is there, so two owners never have the same; of two that lease the same
    items at the same moment the newer token holds them and the other is stale.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at()))

    def _done(self, name: str) -> bool:
        return self._fs.exists(self._at(name, "_SUCCESS"))

    def _batches(self) -> list[str]:
        """The whole batches that count: the newest compact one, and those that it has not taken in."""
        names = self._names()
        whole = [n for n in names if n.partition("-")[0] in ("enqueue", "lease", "done", "compact") and self._done(n)]
        compact = max((n for n in whole if n.startswith("compact-") and f"covers-{n}" in names), default=None)
        if compact is None:
            return [n for n in whole if not n.startswith("compact-")]
        stream = self._fs.open(self._at(f"covers-{compact}"))
        try:
            covered = set(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n"))
        finally:
            stream.close()
        return [compact, *(n for n in whole if not n.startswith("compact-") and n not in covered)]

    def events(self) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in self._batches()]
        return self.spark.read.schema(EVENT_DDL).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT_DDL)

    def _append(self, name: str, df: DataFrame) -> None:
        if not self._done(name):
            df.select(*_EVENT).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def _event(self, items: DataFrame, event: str, now: int, token: int | None = None, owner: str | None = None, until: int | None = None) -> DataFrame:
        add = {"event": event, "token": token, "owner": owner, "at": now, "until": until}
        kinds = dict(c.split() for c in EVENT_DDL.split(", "))
        return items.select("item", "version", *[F.lit(v).cast(kinds[c]).alias(c) for c, v in add.items()])

    def _fold(self) -> DataFrame:
        """``item, version, lease, commit``: the newest lease of each item version, and the completion that was accepted."""
        e = self.events()
        is_lease, is_done = F.col("event") == "lease", F.col("event") == "done"
        one = e.groupBy("item", "version").agg(
            F.max(F.when(is_lease, F.struct("token", "at", "until", "owner"))).alias("lease"),
            F.collect_set(F.when(is_done, F.struct("token", "at"))).alias("completions"),  # of one item; compact keeps one
            F.collect_set(F.when(is_lease, F.struct("token", F.col("at").alias("since"), "until"))).alias("leases"),
        )
        valid = F.filter(  # under a lease that had not run out, and before a newer one began
            "completions",
            lambda d: F.exists("leases", lambda x: (x["token"] == d["token"]) & (x["since"] <= d["at"]) & (d["at"] <= x["until"]))
            & ~F.exists("leases", lambda x: (x["token"] > d["token"]) & (x["since"] <= d["at"])),
        )
        return one.select("item", "version", "lease", F.array_min(valid).alias("commit"))

    def state(self, now: int) -> DataFrame:
        """``item, version, state, token, until`` for each item version; ``token, until`` are those of the newest lease."""
        return self._fold().select(
            "item",
            "version",
            F.when(F.col("commit").isNotNull(), "done").when((F.col("lease.at") <= now) & (F.col("lease.until") > now), "leased").otherwise("pending").alias("state"),
            F.col("lease.token").alias("token"),
            F.col("lease.until").alias("until"),
        )

    def enqueue(self, items: DataFrame, batch: int, now: int) -> None:
        """``items``: ``item, version``. ``batch`` names the folder, so other items under the number of a whole batch are an
        error."""
        known = self.events().select("item", "version").distinct()
        new = items.select("item", "version").distinct().join(known, ["item", "version"], "left_anti")
        name = f"enqueue-{batch}"
        if self._done(name):
            if not new.isEmpty():
                raise ValueError(f"batch {batch} has been written with other items")
            return
        self._append(name, self._event(new, "enqueue", now))

    def _take_token(self) -> int:
        taken = [int(n.removeprefix("token-")) for n in self._names() if n.startswith("token-")]
        token = max(taken, default=0) + 1
        while not self._fs.createNewFile(self._at(f"token-{token}")):
            token += 1
        return token

    def lease(self, owner: str, n: int, now: int, ttl: int) -> int:
        """Lease up to ``n`` pending items in the order of item and version; returns the fencing token."""
        token = self._take_token()
        free = self.state(now).where(F.col("state") == "pending").orderBy("item", "version").limit(n)
        self._append(f"lease-{token}", self._event(free, "lease", now, token, owner, now + ttl))
        return token

    def leased(self, token: int) -> DataFrame:
        """``item, version`` of what the token was given."""
        return self.events().where((F.col("event") == "lease") & (F.col("token") == token)).select("item", "version")

    def complete(self, token: int, now: int, items: DataFrame | None = None) -> None:
        """Mark the token's items (or those of ``items`` among them) as done. Each set of items is a batch of its own, so one
        completion does not touch another."""
        own = self.leased(token)
        if items is not None:
            own = own.join(items.select("item", "version").distinct(), ["item", "version"], "left_semi")
        own = checkpointed(own)  # named and written from the same rows
        n, total = own.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("item", "version").cast("decimal(38,0)")), F.lit(0))).head()
        self._append(f"done-{token}-{n}-{int(total) % 2**64:016x}", self._event(own, "done", now, token))

    def compact(self) -> int:
        """Write what still matters of all whole batches as one: each item version, its newest lease and the completion that
        was accepted. Reading then begins there; returns the number of batches taken in. ``vacuum`` deletes them."""
        covered = self._batches()
        number = max([0, *(int(n.removeprefix("compact-")) for n in self._names() if n.startswith("compact-"))]) + 1
        name = f"compact-{number:09d}"
        rows = self._fold()
        none, same = F.lit(None), ("item", "version")
        first = rows.select(*same, F.lit("enqueue").alias("event"), none.cast("bigint").alias("token"), none.cast("string").alias("owner"), none.cast("bigint").alias("at"), none.cast("bigint").alias("until"))
        held = rows.where(F.col("lease").isNotNull()).select(*same, F.lit("lease").alias("event"), F.col("lease.token").alias("token"), F.col("lease.owner").alias("owner"), F.col("lease.at").alias("at"), F.col("lease.until").alias("until"))
        # an accepted completion came under its own lease, which may not be the newest: both are kept as one that covers it
        commit = rows.where(F.col("commit").isNotNull())
        under = commit.where(F.col("commit.token") != F.col("lease.token")).select(*same, F.lit("lease").alias("event"), F.col("commit.token").alias("token"), none.cast("string").alias("owner"), F.col("commit.at").alias("at"), F.col("commit.at").alias("until"))
        done = commit.select(*same, F.lit("done").alias("event"), F.col("commit.token").alias("token"), none.cast("string").alias("owner"), F.col("commit.at").alias("at"), none.cast("bigint").alias("until"))
        self._append(name, first.unionByName(held).unionByName(under).unionByName(done))
        out = self._fs.create(self._at(f"covers-{name}"), False)
        out.write(bytearray("\n".join(covered), "utf-8"))
        out.close()
        return len(covered)

    def vacuum(self) -> int:
        """Delete the whole batches that the newest compact one has taken in; returns their number."""
        keep = set(self._batches())
        gone = [n for n in self._names() if n.partition("-")[0] in ("enqueue", "lease", "done", "compact") and n not in keep and self._done(n)]
        for n in gone:
            self._fs.delete(self._at(n), True)
        return len(gone)


def lease_decision(held_by: Column, expires_at: Column, owner: Column, now: Column) -> Column:
    """True if ``owner`` may take a lease: it is free, expired or already its own."""
    return held_by.isNull() | expires_at.isNull() | (expires_at <= now) | (held_by == owner)
