"""Cutting files into chunks: by lines, or along their outermost symbols.

A chunk is closed after the line with which it reaches the limit (sizes in UTF-16 units, one more for each line's end);
the next begins with the shortest run of its last lines that reaches the overlap. Both are state machines over lines
and run in Python on Arrow batches, one file at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeseam.functions import paths as P
from codeseam.functions import text as X

MAX_CHARS, OVERLAP, STRUCTURAL_BYTES = 2000, 100, 512 * 1024
VERSION = 2
Range = tuple[int, int]


def _units(line: str) -> int:
    """The size of a line with its end."""
    return (len(line) if line.isascii() else len(line.encode("utf-16-le", "surrogatepass")) // 2) + 1


def line_ranges(lines: list[str], first: int = 1, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[Range]:
    """First and last line of each chunk of consecutive lines, of which the first has the number ``first``."""
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    sums = [0, *accumulate(_units(line) for line in lines)]
    out: list[Range] = []
    begin = 0
    for i in range(len(lines)):
        if sums[i + 1] - sums[begin] < limit:
            continue
        out.append((first + begin, first + i))
        if overlap == 0:
            begin = i + 1
            continue
        keep = i
        while keep > begin and sums[i + 1] - sums[keep] < overlap:
            keep -= 1
        begin = keep
    if begin < len(lines):
        rest = (first + begin, first + len(lines) - 1)
        if not out or out[-1] != rest:
            out.append(rest)
    return out


def outermost(symbols: list[tuple[str, str, int, int]], n_lines: int) -> list[tuple[str, str, int, int]]:
    """Symbols (name, kind, first and last line) with possible ranges that neither lie in nor cross an earlier kept one."""
    fit = [(n, k, a, min(b, n_lines)) for n, k, a, b in symbols if a > 0 and b > 0 and a <= n_lines and min(b, n_lines) >= a]
    kept: list[tuple[str, str, int, int]] = []
    for s in sorted(fit, key=lambda s: (s[2], -s[3], s[0])):
        if not kept or s[2] > kept[-1][3]:  # sorted by first line, kept ranges are disjoint
            kept.append(s)
    return kept


_LEADING = ("//", "#", "*", "/*", "<!--", "@", '"""', "'''")


def comment_start(lines: list[str], symbol_line: int, lowest: int) -> int:
    """The first line of the comments and decorators right above a symbol, not before ``lowest``."""
    start, no = symbol_line, symbol_line - 1
    while no >= lowest:
        text = lines[no - 1].strip()
        if text.endswith("*/"):
            start = no
            no -= 1
            while no >= lowest:  # back to the line where the block comment opens
                start = no
                opens = "/*" in lines[no - 1]
                no -= 1
                if opens:
                    break
        elif text.startswith(_LEADING):
            start = no
            no -= 1
        else:
            break
    return start


def structured_ranges(text: str, symbols: list[tuple[str, str, int, int]], limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, tuple | None]] | None:
    """Ranges along the outermost symbols and the gaps between them, each with its symbol; None where that fails."""
    if len(text) > STRUCTURAL_BYTES or len(text.encode("utf-8", "surrogatepass")) > STRUCTURAL_BYTES:
        return None
    lines = text.split("\n")
    out: list[tuple[int, int, tuple | None]] = []
    cursor = 1

    def add(a: int, b: int, symbol: tuple | None) -> None:
        if a <= b:
            out.extend((x, y, symbol) for x, y in line_ranges(lines[a - 1 : b], a, limit, overlap))

    for s in outermost(symbols, len(lines)):
        start = max(cursor, comment_start(lines, s[2], cursor))
        add(cursor, start - 1, None)
        add(start, s[3], s)
        cursor = s[3] + 1
    add(cursor, len(lines), None)
    ranges = [(a, b) for a, b, _ in out]
    return out if len(set(ranges)) == len(ranges) else None


def chunk_files(files: DataFrame, symbols: DataFrame | None = None, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``files`` (``file_id, index_id, path, language, content``) as rows of the chunks table.

    With ``symbols``, files of languages with a grammar are cut along them; others, too large ones and those whose
    ranges collide are cut by lines. Null contents give no chunk; an empty one gives one empty chunk.
    """
    rows = files.where(F.col("content").isNotNull()).select("file_id", "index_id", "path", "content", P.content_type(F.coalesce("language", P.language("path"))).alias("content_type"))
    if symbols is not None:
        per_file = symbols.dropDuplicates(["id"]).groupBy("file_id").agg(F.collect_list(F.struct("id", "name", "kind", "start_line", "end_line")).alias("symbols"))  # of one file
        rows = rows.join(per_file, "file_id", "left")
    else:
        rows = rows.withColumn("symbols", F.lit(None).cast("array<struct<id:string,name:string,kind:string,start_line:int,end_line:int>>"))
    schema = T.StructType(
        [
            *[rows.schema[c] for c in ("file_id", "index_id", "path", "content_type")],
            T.StructField("symbol_id", T.StringType()),
            T.StructField("start_line", T.IntegerType()),
            T.StructField("end_line", T.IntegerType()),
            T.StructField("content", T.StringType()),
            T.StructField("chunker", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, iid, path, text, kind, own in zip(*(b[c] for c in ("file_id", "index_id", "path", "content", "content_type", "symbols"))):
                lines, ranges, chunker, ids = text.split("\n"), None, "line", {}
                if own is not None and len(own) and kind == "code":
                    known = [(s["name"], s["kind"], int(s["start_line"]), int(s["end_line"])) for s in own if pd.notna(s["start_line"]) and pd.notna(s["end_line"])]
                    for s in sorted(own, key=lambda s: s["id"]):
                        if pd.notna(s["start_line"]) and pd.notna(s["end_line"]):
                            ids.setdefault((s["name"], s["kind"], int(s["start_line"]), min(int(s["end_line"]), len(lines))), s["id"])
                    ranges = structured_ranges(text, known, limit, overlap)
                    chunker = "structural" if ranges is not None else "line"
                if ranges is None:
                    ranges = [(a, z, None) for a, z in line_ranges(lines, 1, limit, overlap)]
                out.extend((fid, iid, path, kind, ids.get(s) if s else None, a, z, "\n".join(lines[a - 1 : z]), chunker) for a, z, s in ranges)
            yield pd.DataFrame(out, columns=schema.names)

    made = rows.select("file_id", "index_id", "path", "content_type", "content", "symbols").mapInPandas(cut, schema)
    return made.select(
        X.hash_id("chk_", "index_id", "path", "start_line", "end_line", length=20).alias("id"),
        "*",
        F.sha2("content", 256).alias("content_hash"),
        F.lit(VERSION).alias("chunker_version"),
    )
