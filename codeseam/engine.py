"""The public surface: one index of a corpus as stored tables, and the questions that can be asked of it.

Tables lie as Parquet under ``root/<table>/snapshot=<n>``, partitioned by index. A build writes whole tables. A refresh
writes a layer over them: the rows of the files that have changed, and which files and chunks these replace; readers put
the layers together, and ``compact`` writes them as one. A pointer file is added when a snapshot is whole, so readers see
one whole snapshot and a failed write leaves the old one.
"""

from __future__ import annotations

import json
import platform
import time
from functools import reduce

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import text as X
from codeseam.operators import bm25, chunking, extract, graph, maintenance, search, usage
from codeseam.operators.ledger import lease_decision
from codeseam.session import broadcast_if_small

TABLES = ("files", "symbols", "chunks", "lengths", "postings", "edges")
#: What a path's rows are told by in each table.
_PATH = {"files": "path", "symbols": "path", "chunks": "path", "edges": "from_path"}
#: How long a writer holds the index, and how old a note of a build that is going on may be, in milliseconds.
LEASE_MS, MARKER_MS = 60_000, 30 * 60_000


class Busy(RuntimeError):
    """Another writer holds the index."""


class Corrupt(RuntimeError):
    """A stored table cannot be read."""


# What errors of broken stores say.
_BROKEN = ("malformed", "not a parquet file", "corrupt", "magic number", "footer")


def is_corruption(error: BaseException | str) -> bool:
    """True if an error comes from a broken store, and not from anything else."""
    text = str(error).lower()
    return isinstance(error, Corrupt) or any(m in text for m in _BROKEN)


class Engine:
    def __init__(self, spark: SparkSession, root: str, index_id: str | None = None):
        self.spark, self.root, self.index_id = spark, root.rstrip("/"), index_id
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- storage

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self) -> list[str]:
        root = self._path()
        return sorted(x.getPath().getName() for x in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def snapshot(self) -> dict | None:
        """What the newest pointer says: number, layers, version and time; None before the first build."""
        pointers = [n for n in self._names() if n.startswith("current-") and n.endswith(".json")]
        if not pointers:
            return None
        found = self._read(pointers[-1])
        maintenance.check_version(found["version"])
        return found

    def _read(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict, replace: bool = True) -> bool:
        """Write a small file as a whole under its name; False if it is there and may not be replaced."""
        draft = self._path(f"draft-{name}-{time.time_ns()}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(value), "utf-8"))
        out.close()
        if replace:
            self._fs.delete(self._path(name), False)
        if self._fs.exists(self._path(name)) or not self._fs.rename(draft, self._path(name)):
            self._fs.delete(draft, False)
            return False
        return True

    def _flip(self, number: int, layers: list[int]) -> None:
        """A pointer of its own name for each snapshot, renamed into place when it is whole: there is no moment without one."""
        text = {"snapshot": number, "layers": layers, "version": max(maintenance.SCHEMA_VERSIONS), "at": int(time.time() * 1000)}
        if not self._put(f"current-{number:012d}.json", text, replace=False):
            raise OSError(f"snapshot {number} was published by another writer")

    def _stored(self, name: str, layer: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/snapshot={layer}")

    def table(self, name: str) -> DataFrame:
        """A table of the newest snapshot: of each layer the rows that no later layer replaces."""
        now = self.snapshot()
        if now is None:
            raise LookupError("there is no index yet; build one first")
        layers = now.get("layers") or [now["snapshot"]]
        seen = [self._stored(name, layers[0])]
        for layer in layers[1:]:
            if name in _PATH:
                gone = self._stored("replaced", layer).select("index_id", "path")
                hide = maintenance.without_edges if name == "edges" else maintenance.without_paths
                deleted = self._stored("replaced", layer).where("deleted")
                seen = [hide(t, gone, "out") if name == "edges" else hide(t, gone) for t in seen]
                seen = [hide(t, deleted, "both") for t in seen] if name == "edges" else seen
            else:
                gone = broadcast_if_small(self._stored("gone_chunks", layer))
                seen = [t.join(gone, "chunk_id", "left_anti") for t in seen]
            seen.append(self._stored(name, layer))
        return reduce(DataFrame.unionByName, seen)

    def _own(self, name: str) -> DataFrame:
        t = self.table(name)
        return t.where(F.col("index_id") == self.index_id) if self.index_id else t

    # -- building

    def lease(self, owner: str, ttl: int = LEASE_MS, now: int | None = None) -> bool:
        """Take the index for writing, if it is free, its lease has run out or is the owner's own."""
        now = int(time.time() * 1000) if now is None else now
        held = self._read("lease.json")
        if held:
            values = [F.lit(held["owner"]), F.lit(held["expires_at"]).cast("bigint"), F.lit(owner), F.lit(now).cast("bigint")]
            if not self.spark.range(1).select(lease_decision(*values)).head()[0]:
                return False
            self._fs.delete(self._path("lease.json"), False)
        return self._put("lease.json", {"owner": owner, "expires_at": now + ttl}, replace=False)

    def release(self, owner: str) -> None:
        held = self._read("lease.json")
        if held and held["owner"] == owner:
            self._fs.delete(self._path("lease.json"), False)

    def _next(self) -> int:
        return ((self.snapshot() or {}).get("snapshot") or 0) + 1

    def _store(self, name: str, number: int, rows: DataFrame) -> None:
        """Write a table partitioned by index; one without rows keeps its columns."""
        folder = f"{self.root}/{name}/snapshot={number}"
        if name == "postings":
            bm25.write_postings(rows, folder)
        else:
            rows.write.mode("overwrite").partitionBy("index_id").parquet(folder)
        if not any(x.getPath().getName().startswith("index_id=") for x in self._fs.listStatus(self._path(name, f"snapshot={number}"))):
            self.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(folder)

    def _write_layer(self, number: int, files: DataFrame, known: DataFrame | None = None) -> None:
        """The tables of some files; ``known``: the paths that imports may mean, if more than these files."""
        rows = files.where(F.col("content").isNotNull()).dropDuplicates(["index_id", "path"]).withColumn("file_id", X.hash_id("file_", "index_id", "path", length=20))
        put = lambda name, df: self._store(name, number, df)
        got = lambda name: self._stored(name, number)
        ddl = {"index_id": "string", "path": "string", "language": "string", "content": "string"}
        rows = rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in ddl.items()], "file_id")
        put("files", rows.select("*", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").alias("bytes")))
        put("symbols", extract.extract_symbols(got("files")))
        put("chunks", chunking.chunk_files(got("files"), got("symbols")))
        tokens = bm25.chunk_tokens(got("chunks"), stem=True)
        put("postings", bm25.postings(tokens))
        put("lengths", bm25.chunk_lengths(tokens))
        put("edges", extract.file_edges(got("files"), got("symbols"), known))

    def build(self, files: DataFrame) -> dict:
        """Index ``files`` (``index_id, path, language, content``, others allowed) as a new whole snapshot. A note says that
        a build is going on."""
        number = self._next()
        self._put("building.json", {"snapshot": number, "started_at": int(time.time() * 1000)})
        try:
            self._write_layer(number, files)
            self._flip(number, [number])
        finally:
            self._fs.delete(self._path("building.json"), False)
        return self.snapshot()

    def build_subset(self, files: DataFrame, inventory: DataFrame) -> dict:
        """A whole snapshot of the files whose ``index_id, path`` are in ``inventory`` alone."""
        chosen = broadcast_if_small(inventory.select("index_id", "path").distinct())
        return self.build(files.join(chosen, ["index_id", "path"], "left_semi"))

    def changes(self, files: DataFrame) -> DataFrame:
        """``index_id, path, change`` of ``files`` against the stored ones, by content."""
        old = self.table("files").select("index_id", "path", "content_hash")
        new = files.where(F.col("content").isNotNull()).groupBy("index_id", "path").agg(F.max(F.sha2("content", 256)).alias("new_hash"))
        both = new.join(old, ["index_id", "path"], "full")
        change = F.when(F.col("content_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
        return both.select("index_id", "path", change.alias("change"))

    def refresh(self, files: DataFrame, budget: int | None = None, owner: str = "refresh") -> DataFrame:
        """Index what has changed, as a layer over the stored tables: ``index_id, path, change, work``, without unchanged
        paths. ``budget``: so many new and changed paths of each index are indexed ``now``, the others are ``pending``;
        deletions are always made. ``Busy`` if another writer holds the index.
        """
        if not self.lease(owner):
            raise Busy("another writer holds the index")
        try:
            now, number = self.snapshot(), self._next()
            work = maintenance.split_work(self.changes(files), budget if budget is not None else 2**31 - 1)
            folder = f"{self.root}/work/snapshot={number}"
            work.write.mode("overwrite").parquet(folder)
            work = self.spark.read.parquet(folder)
            todo = work.where(F.col("work") == "now")
            if todo.isEmpty():
                return work
            at = lambda name: f"{self.root}/{name}/snapshot={number}"
            gone = broadcast_if_small(todo.select("index_id", "path", (F.col("change") == "deleted").alias("deleted")))
            gone.write.mode("overwrite").parquet(at("replaced"))
            old = self.table("chunks").join(gone, ["index_id", "path"], "left_semi")
            old.select(F.col("id").alias("chunk_id")).distinct().write.mode("overwrite").parquet(at("gone_chunks"))
            again = files.join(broadcast_if_small(todo.where(F.col("change") != "deleted").select("index_id", "path")), ["index_id", "path"], "left_semi")
            known = files.where(F.col("content").isNotNull()).select("index_id", "path")
            self._write_layer(number, again, known)
            self._flip(number, [*(now.get("layers") or [now["snapshot"]]), number])
            return work
        finally:
            self.release(owner)

    def pending(self) -> DataFrame:
        """``index_id, path`` that the last refresh left for later."""
        now = self.snapshot()
        folder = f"work/snapshot={now['snapshot']}" if now else None
        if folder is None or not self._fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], "index_id string, path string")
        return self.spark.read.parquet(f"{self.root}/{folder}").where(F.col("work") == "pending").select("index_id", "path")

    def ensure(self, files: DataFrame, budget: int | None = None) -> dict:
        """An index that can be asked: built if there is none, else refreshed before."""
        if self.snapshot() is None:
            return self.build(files)
        self.refresh(files, budget)
        return self.snapshot()

    def compact(self) -> dict:
        """The layers of the newest snapshot as whole tables of a new one."""
        now, number = self.snapshot(), self._next()
        if now is None or len(now.get("layers") or [1]) == 1:
            return now
        for name in TABLES:
            self._store(name, number, self.table(name))
        self._flip(number, [number])
        return self.snapshot()

    # -- asking

    def search(self, query: str, **options) -> DataFrame:
        """A page of results; see ``search.search`` for the options."""
        q = self._queries([query])
        return search.search(self._own("chunks"), self._own("symbols"), self._own("edges"), q, stored=self._index(self._own), **options)

    def _index(self, get) -> bm25.Stored:
        return bm25.Stored(get("postings"), bm25.length_stats(get("lengths")))

    def search_related(self, query: str, **options) -> tuple[DataFrame, DataFrame]:
        """A page of results, and what the first of them imports, is imported by and is tested by, one step away."""
        page = self.search(query, **options)
        return page, search.related_to_first(page, self._queries([query]), self._own("edges"))

    def _queries(self, texts: list[str]) -> DataFrame:
        if not self.index_id:
            raise LookupError("choose an index first")
        return self.spark.createDataFrame([(i, t, self.index_id) for i, t in enumerate(texts)], "query_id long, query string, index_id string")

    def search_many(self, queries: DataFrame, **options) -> DataFrame:
        """``queries``: ``query_id, query, index_id``; one job for all of them."""
        return search.search(self.table("chunks"), self.table("symbols"), self.table("edges"), queries, stored=self._index(self.table), **options)

    def explore(self, query: str, limit: int = 8, max_files: int = 6, max_per_file: int = 3, max_related: int = 20, related_depth: int = 1) -> tuple[DataFrame, DataFrame]:
        hits = self.search(query, limit=limit, snippet="compact")
        files = search.explore(hits, self._own("chunks"), self._own("symbols"), max_files, max_per_file)
        return files, search.explore_related(files, self._queries([query]), self._own("edges"), related_depth, max_related)

    def related(self, path: str, types: list[str] | None = None, depth: int = 2, direction: str = "both") -> DataFrame:
        return graph.neighbors(self._own("edges"), self._start(path), types, depth, direction)

    def tests_for(self, path: str) -> DataFrame:
        return graph.tests_for(self._own("edges"), self._start(path))

    def impact(self, path: str | None = None, symbol: str | None = None, depth: int = 2, include_tests: bool = True) -> DataFrame:
        """What a change touches; several symbols of the name without a path give these candidates instead."""
        if symbol:
            found = graph.resolve_symbol(self._own("symbols"), self.spark.createDataFrame([(self.index_id, symbol)], "index_id string, wanted string"))
            found = found.where(F.col("path") == path) if path else found
            rows = found.orderBy("path", "start_line").limit(2).collect()
            if len(rows) != 1 and not path:
                return found
            path = rows[0]["path"] if rows else path
        if not path:
            raise ValueError("a symbol or a path is needed")
        return graph.impact(self._own("edges"), self._start(path), depth, include_tests)

    def _start(self, path: str) -> DataFrame:
        return self.spark.createDataFrame([(self.index_id, path.removeprefix("./").removeprefix("/"))], "index_id string, start string")

    def outline(self, prefix: str = "", limit: int = 50, everything: bool = False) -> DataFrame:
        return search.outline(self._own("symbols"), prefix, limit, everything)

    def expand(self, handle: str | None = None, path: str | None = None, start_line: int | None = None, end_line: int | None = None, budget: int = 4000) -> DataFrame:
        ddl = "target string, index_id string, handle string, path string, start_line int, end_line int"
        t = self.spark.createDataFrame([(handle or path, self.index_id, handle, path, start_line, end_line)], ddl)
        return search.expand(t, self._own("files"), self._own("chunks"), budget)

    # -- state

    def current(self) -> dict:
        """Whether there is an index, is being built or is missing, and which. A note of a build that is too old counts as
        one that has died."""
        now, note = self.snapshot(), self._read("building.json")
        age = int(time.time() * 1000) - note["started_at"] if note else None
        if now is None:
            building = age is not None and age <= MARKER_MS
            return {"status": "building", "started_at": note["started_at"], "age_ms": age} if building else {"status": "missing"}
        return {"status": "active", "index_id": self.index_id, **now}

    def persistent(self) -> bool:
        """True if there is an index with at least one file."""
        return self.snapshot() is not None and not self.table("files").isEmpty()

    def prune(self, indexes: DataFrame, leases: DataFrame, now: int, strict: bool = False) -> DataFrame:
        """What becomes of each index (see ``maintenance.prune``); those that have expired are left out of a new snapshot."""
        plan = maintenance.prune(indexes, leases, now, self.index_id, strict)
        self._without(plan.where(F.col("action") == "delete").select("index_id"))
        return plan

    def drop(self, indexes: DataFrame, index_id: str | None = None, branch: str | None = None, worktree: str | None = None) -> dict:
        """Drop the one index that is meant, unless it is the active one or pinned: ``index_id, decision``."""
        found = maintenance.drop_target(indexes, index_id, branch, worktree, self.index_id).head()
        if found is None:
            return {"index_id": None, "decision": "not found"}
        if found["decision"] == "drop":
            self._without(self.spark.createDataFrame([(found["index_id"],)], "index_id string"))
        return found.asDict()

    def _without(self, gone: DataFrame) -> None:
        now = self.snapshot()
        if now is None or gone.isEmpty():
            return
        number = self._next()
        for name in TABLES:
            self._store(name, number, maintenance.without_indexes(self.table(name), gone))
        self._flip(number, [number])

    def restore(self, number: int) -> dict:
        """Publish an older snapshot again as the newest; its tables are not copied."""
        old = self._read(f"current-{number:012d}.json")
        if old is None:
            raise LookupError(f"there is no snapshot {number}")
        self._flip(self._next(), old.get("layers") or [number])
        return self.snapshot()

    def check(self) -> None:
        """Read every table of the newest snapshot to its end; ``Corrupt`` names the first that cannot be read."""
        for name in TABLES:
            try:
                self.table(name).write.format("noop").mode("overwrite").save()
            except Exception as error:  # whatever keeps a table from being read is the finding
                raise Corrupt(f"{name}: {str(error).splitlines()[0]}") from error

    def stats(self) -> DataFrame:
        return usage.index_counts({t: self.table(t) for t in TABLES})

    def doctor(self) -> dict:
        """Versions, and whether each table can be read."""
        health = {"spark": pyspark.__version__, "python": platform.python_version(), "index": self.snapshot() is not None}
        for t in TABLES:
            try:
                health[t] = health["index"] and self.table(t).limit(1).count() >= 0
            except Exception:  # noqa: BLE001  # whatever keeps a table from being read is the finding
                health[t] = False
        return health

    def save_context(self, repo_id: str, name: str, items: list[tuple[str, str]], notes: str = "", pinned: bool = False, deleted: bool = False) -> None:
        """Append a version of a saved context to its log; the newest counts."""
        ddl = "repo_id string, name string, notes string, pinned boolean, items array<struct<handle:string,path:string>>, at long, deleted boolean"
        row = (repo_id, name, notes, pinned, items, time.time_ns(), deleted)
        self.spark.createDataFrame([row], ddl).write.mode("append").parquet(f"{self.root}/contexts")

    def contexts(self) -> DataFrame:
        return usage.latest_contexts(self.spark.read.parquet(f"{self.root}/contexts"))

    def _context(self, repo_id: str, name: str):
        found = self.contexts().where((F.col("repo_id") == repo_id) & (F.col("name") == name)).head()
        if found is None:
            raise LookupError(f"there is no context {name!r}")
        return found

    def load_context(self, repo_id: str, name: str) -> dict:
        """A saved context; loading it counts as its last use."""
        c = self._context(repo_id, name)
        self.save_context(repo_id, name, [tuple(i) for i in c["items"]], c["notes"], c["pinned"])
        return c.asDict(recursive=True)

    def delete_context(self, repo_id: str, name: str) -> None:
        self._context(repo_id, name)
        self.save_context(repo_id, name, [], deleted=True)

    def record_usage(self, events: DataFrame) -> None:
        """Append calls, as rows that ``usage`` rolls up."""
        usage.record(events).write.mode("append").parquet(f"{self.root}/usage")

    def usage(self, tracked: list[str] | None = None) -> DataFrame:
        return usage.rollup(self.spark.read.parquet(f"{self.root}/usage"), tracked)

    def vacuum(self, keep: int = 2) -> int:
        """Delete snapshots before the last ``keep``; gives the bytes that were freed."""
        now, freed = self.snapshot(), 0
        pointers = [self._read(n) for n in self._names() if n.startswith("current-")]
        kept = {layer for p in pointers if now and p["snapshot"] > now["snapshot"] - keep for layer in (p.get("layers") or [p["snapshot"]])}
        for t in (*TABLES, "replaced", "gone_chunks", "work"):
            folder = self._path(t)
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                number = int(s.getPath().getName().partition("=")[2])
                if now and number not in kept and number <= now["snapshot"]:
                    freed += self._fs.getContentSummary(s.getPath()).getLength()
                    self._fs.delete(s.getPath(), True)
        for p in pointers:  # what is gone cannot be restored
            if now and p["snapshot"] <= now["snapshot"] - keep:
                self._fs.delete(self._path(f"current-{p['snapshot']:012d}.json"), False)
        return freed
