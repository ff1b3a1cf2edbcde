"""Evaluation task files in, evaluation artifacts out."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_DDL = (
    "id string, suite string, type string, query string, target_path string, expected_paths array<string>, confidence double, contributes boolean, independent boolean, reviewed boolean"
)
FILE_DDL = f"version int, tasks array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ') for c in TASK_DDL.split(', ')))}>>"
MAX_TASKS = 10_000
SUITES = {"locate": "retrieval", "history": "retrieval", "callers": "graph", "tests": "graph"}


def load_tasks(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """The tasks of a file of version 1; an error names the first rule that a task breaks.

    Rules: at most 10,000 tasks; known types in their suite; an id and a query; ids once; expected paths, relative and
    inside the repository, that are known if ``known`` (``path``) is given; a target for graph tasks; what counts for
    thresholds has been reviewed.
    """
    doc = spark.read.schema(FILE_DDL).json(path, multiLine=True)
    if doc.where((F.col("version") == 1) & F.col("tasks").isNotNull()).count() != 1:
        raise ValueError(f"{path}: not a task file of version 1")
    tasks = doc.select(F.explode("tasks").alias("t")).select("t.*")
    suite = F.create_map(*[F.lit(x) for kv in SUITES.items() for x in kv])
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad_path = F.exists("expected_paths", lambda p: p.isNull() | (p == "") | F.startswith(p, F.lit("/")) | p.rlike(r"(^|/)\.\.(/|$)"))
    rules = {
        "it has no id": blank("id"),
        "it has no query": blank("query"),
        "its type is unknown or of another suite": ~F.coalesce(F.try_element_at(suite, F.col("type")) == F.col("suite"), F.lit(False)),
        "it expects nothing": F.coalesce(F.size("expected_paths"), F.lit(0)) < 1,
        "it expects a path outside the repository": F.coalesce(bad_path, F.lit(False)),
        "a graph task needs a target": (F.col("suite") == "graph") & blank("target_path"),
        "it counts for thresholds but is not reviewed": F.coalesce("contributes", F.lit(False)) & ~F.coalesce("reviewed", F.lit(False)),
    }
    wrong = tasks.select("id", F.array_compact(F.array(*[F.when(c, m) for m, c in rules.items()])).alias("why")).where(F.size("why") > 0).orderBy("id").first()
    if wrong:
        raise ValueError(f"{path}: task {wrong['id']!r}: {wrong['why'][0]}")
    if tasks.count() > MAX_TASKS:
        raise ValueError(f"{path}: more than {MAX_TASKS} tasks")
    twice = tasks.groupBy("id").count().where(F.col("count") > 1).orderBy("id").first()
    if twice:
        raise ValueError(f"{path}: task {twice['id']!r} comes twice")
    if known is not None:
        lost = tasks.select("id", F.explode("expected_paths").alias("path")).join(known.select("path").distinct(), "path", "left_anti").orderBy("id", "path").first()
        if lost:
            raise ValueError(f"{path}: task {lost['id']!r} expects {lost['path']!r}, which is not there")
    return tasks


def write_artifacts(folder: str, results: DataFrame, tasks: DataFrame, title: str = "Evaluation") -> None:
    """``results`` and ``tasks`` as JSON datasets, and a report of the results (a row for each arm) in Markdown."""
    results.write.mode("overwrite").json(f"{folder}/results.json")
    tasks.write.mode("overwrite").json(f"{folder}/tasks.json")
    names = [f.name for f in results.schema.fields]
    rows = [r.asDict(recursive=True) for r in results.collect()]  # a row for each arm
    show = lambda v: f"[{v['low']:.3f}, {v['high']:.3f}]" if isinstance(v, dict) else f"{v:.3f}" if isinstance(v, float) else str(v)
    table = ["| " + " | ".join(names) + " |", "|" + " - |" * len(names), *["| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows]]
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "report.md").write_text(f"# {title}\n\n" + "\n".join(table) + "\n", encoding="utf-8")
    Path(folder, "summary.json").write_text(json.dumps(rows, default=str), encoding="utf-8")
