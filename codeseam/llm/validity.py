"""Source files that do not parse.

Method: recursive-descent statements with precedence-climbing expressions and panic-mode recovery, one parser for each
language (see ``codeseam.llm.parse``). Every fault is stored; the first is the cause, later ones may follow from it.
The language is that which the path's extension claims.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeseam.llm.parse import c, go, java, js, json_, py
from codeseam.llm.parse.core import Fault, Parser
from codeseam.session import broadcast_if_small

# Extensions, the language that each claims, and its parser.
EXTENSIONS: dict[str, tuple[str, type[Parser]]] = {
    "py": ("python", py.Python),
    "js": ("javascript", js.Script),
    "mjs": ("javascript", js.Script),
    "cjs": ("javascript", js.Script),
    "jsx": ("javascript", js.Script),
    "ts": ("typescript", js.TypeScript),
    "tsx": ("typescript", js.TypeScriptX),
    "go": ("go", go.Go),
    "java": ("java", java.Java),
    "c": ("c", c.C),
    "h": ("c", c.C),
    "json": ("json", json_.Json),
}

#: Bytes by which a worker remembers texts it has parsed, so that copies are parsed once; beyond it memory begins anew,
#: which changes the speed only. A text is remembered by its hash, which takes far less than its faults.
REMEMBERED_BYTES = 32 * 1024 * 1024
_ENTRY_BYTES, _FAULT_BYTES = 250, 400


def faults(text: str | None, extension: str) -> list[Fault]:
    """The faults of a text in the language of the extension; none for a null or empty text."""
    if not text or not text.strip("﻿ \t\r\n"):
        return []
    return EXTENSIONS[extension][1](text).check()


def extension(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z]+)$", 1))


def check_syntax(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, index_id, path, language, n_faults, first_line, first_cause, faults``, one row for each distinct key whose
    path claims one of the languages. Other paths and null paths are left out; null and empty contents have no fault.
    """
    names = F.create_map(*[F.lit(x) for e, (name, _) in EXTENSIONS.items() for x in (e, name)])
    rows = (
        files.select(F.col(key).alias("key"), "index_id", "path", extension().alias("extension"), "content")
        .where(F.col("extension").isin(*EXTENSIONS))
    )
    fault = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())])
    schema = T.StructType([rows.schema["key"], rows.schema["index_id"], rows.schema["path"], rows.schema["extension"], T.StructField("faults", T.ArrayType(fault))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, list[dict]] = {}
        held = 0
        for batch in batches:
            out = []
            for text, e in zip(batch["content"], batch["extension"]):
                key = xxhash.xxh3_128_digest(f"{e}\0{text}".encode("utf-8", "surrogatepass"))
                if key not in known:
                    found = [{"line": f.line, "message": f.message} for f in faults(text, e)]
                    held += _ENTRY_BYTES + len(found) * _FAULT_BYTES
                    if held > REMEMBERED_BYTES:
                        known.clear()
                        held = 0
                    known[key] = found
                out.append(known[key])
            yield batch[["key", "index_id", "path", "extension"]].assign(faults=out)

    # a repeated key is dropped when it has been parsed, as faults are far less to shuffle than texts
    return rows.mapInPandas(run, schema).dropDuplicates(["key"]).select(
        F.col("key").alias(key),
        "index_id",
        "path",
        names[F.col("extension")].alias("language"),
        F.size("faults").alias("n_faults"),
        F.get("faults", F.lit(0))["line"].alias("first_line"),
        F.get("faults", F.lit(0))["message"].alias("first_cause"),
        "faults",
    )


def broken_rates(checked: DataFrame, indexes: DataFrame) -> DataFrame:
    """``repo_root, language, files, broken, rate, language_acceptance``: the last is the share of the language's files
    of all repositories that parse. Files whose index is unknown count under a null repo_root.
    """
    roots = broadcast_if_small(indexes.select(F.col("id").alias("_id"), "repo_root").dropDuplicates(["_id"]))
    per = (
        checked.join(roots, F.col("index_id") == F.col("_id"), "left")
        .groupBy("repo_root", "language")
        .agg(F.count("*").alias("files"), F.count_if(F.col("n_faults") > 0).alias("broken"))
    )
    total = per.groupBy(F.col("language").alias("_language")).agg((1 - F.sum("broken") / F.sum("files")).alias("language_acceptance"))
    return per.join(F.broadcast(total), F.col("language") == F.col("_language")).select(  # one row for each language
        "repo_root", "language", "files", "broken", (F.col("broken") / F.col("files")).alias("rate"), "language_acceptance"
    )
