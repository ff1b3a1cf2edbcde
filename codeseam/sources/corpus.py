"""Reading repositories into files tables: scans, deny rules, ignore files, binary sniffing and version control."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from fnmatch import translate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeseam.functions import paths as P


def is_binary(head: Column) -> Column:
    """Of the first 8192 bytes: a NUL byte, or control bytes other than tabs and line ends above a tenth."""
    digits = F.hex(F.substring(head, 1, 8192))
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), 1)
    control = F.size(F.filter(pairs, lambda b: b.rlike("^(0[0-8]|0[EF]|1.)$")))
    return F.exists(pairs, lambda b: b == "00") | (control > F.size(pairs) * 0.1)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``uri, path, size, mtime_ms`` of all files below ``root``, those with hidden names too, which Spark's own file
    sources pass over. Only names and sizes come to the driver."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    found, rows = fs.listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        uri = f.getPath().toString()
        rows.append((uri, uri[len(base) :], f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, "uri string, path string, size long, mtime_ms long")


def with_bytes(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``bytes`` of their ``uri``, read where the rows are; null for a file that cannot be read."""
    schema = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for at in range(0, len(batch), 64):  # a file has at most 5 MiB
                part, out = batch.iloc[at : at + 64], []
                for uri in part["uri"]:
                    try:
                        system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
                        with system.open_input_stream(name) as stream:
                            out.append(stream.read())
                    except OSError:
                        out.append(None)
                yield part.assign(bytes=out)

    return rows.mapInPandas(read, schema)


def scan(spark: SparkSession, root: str, listed: list[str] | None = None, ignore: bool = True) -> DataFrame:
    """``path, size, mtime_ms, language, content`` of the text files below ``root``.

    ``listed``: the paths that version control knows; without them ignore files are honoured. Denied paths and files
    above 5 MiB are never opened; binary files and those that cannot be read are left out.
    """
    rows = list_files(spark, root).where((F.col("size") <= P.MAX_FILE_BYTES) & ~P.denied("path") & ~F.col("path").rlike(r"(^|/)\.git/"))
    if listed is not None:
        rows = rows.join(spark.createDataFrame([(p,) for p in listed], "path string"), "path", "left_semi")
    elif ignore:
        rows = without_ignored(rows)
    text = with_bytes(rows).where(F.col("bytes").isNotNull() & ~is_binary(F.col("bytes")))
    return text.select("path", "size", "mtime_ms", P.language("path").alias("language"), F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"))


def ignore_pattern(line: str, folder: str = "") -> tuple[str, bool] | None:
    """A line of an ignore file in ``folder`` as a regular expression over paths, and whether it takes back."""
    line = line.rstrip("\r\n")
    if not line.strip() or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[1:] if keep else line
    line = line.rstrip() if not line.endswith("\\ ") else line
    only_folder, anchored = line.endswith("/"), "/" in line.rstrip("/")
    parts = line.strip("/").split("/")
    body = "".join("(?:.*/)?" if p == "**" else translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*") + "/" for p in parts).removesuffix("/")
    where = ("^" + translate(folder).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "/" if folder else "^") + ("" if anchored else "(?:.*/)?")
    return where + body + ("/.*$" if only_folder else "(?:/.*)?$"), keep


def without_ignored(rows: DataFrame) -> DataFrame:
    """Rows whose path no ignore file on the way to it rules out; a later rule and a deeper file win."""
    found = with_bytes(rows.where(P.basename("path") == ".gitignore")).select("path", F.make_valid_utf8(F.col("bytes").cast("string")).alias("text")).collect()  # ignore files alone
    rules = []
    for r in sorted(found, key=lambda r: (r["path"].count("/"), r["path"])):
        folder = r["path"].rpartition("/")[0]
        rules += [p for line in r["text"].split("\n") if (p := ignore_pattern(line, folder))]
    state = F.lit(False)
    for pattern, keep in rules:
        state = F.when(F.col("path").rlike(pattern), F.lit(not keep)).otherwise(state)
    return rows.where(~state)


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else None


def git_files(root: str) -> list[str] | None:
    """Tracked files and untracked ones that are not ignored; None where there is no version control."""
    out = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    return None if out is None else [p for p in out.split("\0") if p]


def git_scope(root: str) -> dict[str, object] | None:
    """``repo_root, worktree_path, branch_name, head_sha, dirty`` of a checkout."""
    top = _git(root, "rev-parse", "--show-toplevel")
    if top is None:
        return None
    common = (_git(root, "rev-parse", "--path-format=absolute", "--git-common-dir") or "").strip()
    head = (_git(root, "rev-parse", "HEAD") or "").strip() or None
    branch = (_git(root, "symbolic-ref", "--short", "-q", "HEAD") or "").strip() or "DETACHED"
    status = _git(root, "status", "--porcelain", "-z") or ""
    return {"repo_root": common.removesuffix("/.git") or top.strip(), "worktree_path": top.strip(), "branch_name": branch, "head_sha": head, "dirty": [p for _, p in porcelain(status)]}


def porcelain(status: str) -> list[tuple[str, str]]:
    """``status, path`` of each record; the old name behind a rename or copy is passed over."""
    out, records, i = [], status.split("\0"), 0
    while i < len(records):
        record = records[i]
        i += 1
        if len(record) < 4:
            continue
        out.append((record[:2], record[3:]))
        if record[0] in "RC" or record[1] in "RC":
            i += 1
    return out


def git_log(spark: SparkSession, root: str, most: int = 100) -> DataFrame:
    """``sha, subject, paths`` of the last commits."""
    out = _git(root, "log", f"-n{most}", "--name-only", "--pretty=format:%x01%H%x02%s") or ""
    rows = []
    for block in out.split("\x01")[1:]:
        head, _, names = block.partition("\n")
        sha, _, subject = head.partition("\x02")
        rows.append((sha, subject.strip(), [n.strip() for n in names.split("\n") if n.strip()]))
    return spark.createDataFrame(rows, "sha string, subject string, paths array<string>")
