"""Splitting oversized texts at natural boundaries.

Method: a text is cut into tokens (words and the white space between them), whose lengths are summed to offsets; every
token end at which something ends naturally is a boundary of some strength (blank line, line, sentence, clause, word).
For each piece the last boundary under the limit is found by binary search in the sorted array of the strongest kind
that leaves a piece of a useful size; the next piece begins a step of at most ``overlap`` back, at the start of a line
if one lies there before the cut, else of a word, else inside the word. A stretch without any boundary is cut hard at the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A stronger boundary is taken if the piece is at least this share of the limit.
LEAST_FILL = (0.5, 0.4, 0.3, 0.2, 0.0)

#: The ends that are natural, strongest first: blank line, line, sentence, clause, word.
_ENDS = (
    re.compile(r"\n[ \t\r]*\n"),
    re.compile(r"\n"),
    re.compile(r"[.!?][\"')\]]*\s+|[。！？]|[;{}]\s+"),
    re.compile(r"[,:]\s+|[、，；：]"),
    re.compile(r"\s+"),
)
_TOKEN = re.compile(r"\S+\s*|\s+")


def _boundaries(text: str) -> list[list[int]]:
    """For each kind the sorted offsets after which a piece may end."""
    return [[m.end() for m in end.finditer(text)] for end in _ENDS]


def _token_starts(text: str) -> list[int]:
    """Prefix sums of the token lengths: where each token begins."""
    starts, at = [], 0
    for token in _TOKEN.findall(text):
        starts.append(at)
        at += len(token)
    return starts


def pieces(text: str, limit: int = 2000, overlap: int = 100) -> list[tuple[int, int]]:
    """Character ranges ``[begin, end)`` of the pieces, each of at most ``limit`` characters.

    They cover the text without gaps, each begins at most ``overlap`` characters before the end of the one before it,
    and each ends later than the one before. A text within the limit is one piece; an empty text is one empty piece.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap smaller than it")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    ends, starts = _boundaries(text), _token_starts(text)
    lines = ends[1]
    out, begin, last = [], 0, 0
    while True:
        if n - begin <= limit:
            out.append((begin, n))
            return out
        top, end = begin + limit, 0
        for sorted_ends, share in zip(ends, LEAST_FILL):
            k = bisect_right(sorted_ends, top) - 1
            if k >= 0 and sorted_ends[k] > max(last, begin + share * limit):
                end = sorted_ends[k]
                break
        end = end or top
        if end < n and text[end - 1] == "\r" and text[end] == "\n":  # the mark of a line's end stays whole if it can
            end = end - 1 if end - 1 > last else end
        out.append((begin, end))
        low = max(end - overlap, begin + 1)
        step = end if not overlap else low  # inside a word that is longer than the overlap
        for natural in (lines, starts) if overlap else ():
            k = bisect_left(natural, low)
            if k < len(natural) and natural[k] < end:
                step = natural[k]
                break
        begin, last = step, end


_PIECE = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("piece_start", T.LongType()),
        T.StructField("piece_end", T.LongType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
)


def split_oversized(
    df: DataFrame,
    key: str = "id",
    content: str = "content",
    start_line: str = "start_line",
    limit: int = 2000,
    overlap: int = 100,
    oversized_only: bool = False,
) -> DataFrame:
    """Each distinct ``key`` with its text as pieces: ``key, piece_no, n_pieces, piece_start, piece_end, start_line,
    end_line, content``.

    ``piece_start`` and ``piece_end`` are character offsets in the text; lines are those of the file, of which
    ``start_line`` names the text's first (a null one counts as 1). A piece that ends with a line's end has that line
    as its ``end_line``. Rows whose key repeats come once; rows with a null text give no piece; an empty text gives
    one empty piece. Texts within the limit never leave the JVM.
    """
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("content"), F.coalesce(F.col(start_line), F.lit(1)).cast("int").alias("line")).where(
        F.col("content").isNotNull()
    )
    whole = F.length("content") <= limit

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text, line in zip(batch["key"], batch["content"], batch["line"]):
                cuts = pieces(text, limit, overlap)
                for no, (a, b) in enumerate(cuts):
                    first = line + text.count("\n", 0, a)
                    inner = text.count("\n", a, b)
                    out.append((k, no, len(cuts), a, b, first, first + inner - (inner > 0 and text[b - 1] == "\n"), text[a:b]))
            yield pd.DataFrame(out, columns=["key", *_PIECE.names])

    schema = T.StructType([rows.schema["key"], *_PIECE.fields])
    # the pieces of a repeated row are the same, so the first of them stands for all
    large = rows.where(~whole).dropDuplicates(["key"]).mapInPandas(cut, schema)
    if not oversized_only:
        breaks = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
        small = rows.where(whole).dropDuplicates(["key"]).select(
            "key",
            F.lit(0).alias("piece_no"),
            F.lit(1).alias("n_pieces"),
            F.lit(0).cast("bigint").alias("piece_start"),
            F.length("content").cast("bigint").alias("piece_end"),
            F.col("line").alias("start_line"),
            (F.col("line") + breaks - F.when(F.col("content").endswith("\n"), 1).otherwise(0)).cast("int").alias("end_line"),
            "content",
        )
        large = large.unionByName(small)
    return large.withColumnRenamed("key", key)
