"""Repetition inside single documents.

Method: suffix arrays. The words of all documents of an Arrow batch are numbered (a word of another document gets
another number, so nothing matches across documents) and their suffixes are sorted by prefix doubling on numpy arrays.
Longest common prefixes of neighbours come from the ranks of each doubling; maximal groups of neighbours whose common
prefix reaches the shortest counted run are LCP intervals, that is, the occurrences of a repeated run. All but the
first occurrence are marked, and the union of their spans gives the covered share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 5
MIN_CHARACTERS = 10
LEAST_SHARE = (3, 10)
#: The longest repeat that a document may have, in words and in characters of scripts without spaces.
MOST_WORDS, MOST_CHARACTERS = 100, 200

#: Scripts that are written without spaces between words.
_SPACELESS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}ー]"
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+(?:['’][\p{L}\p{M}\p{N}]+)*")
_CHAR = regex.compile(r"[\p{L}\p{M}\p{N}]")
_SPACELESS_RUN = regex.compile(_SPACELESS + "+")

#: Units whose suffixes are sorted together; a longer document is sorted on its own.
BLOCK = 200_000


def units(text: str) -> tuple[list[str], bool]:
    """The words of a text in one case, or its characters if more than half of them are of a script without spaces."""
    text = text.casefold()
    if not text.isascii():
        spaceless = sum(map(len, _SPACELESS_RUN.findall(text)))
        if spaceless:
            characters = _CHAR.findall(text)
            if 2 * spaceless > len(characters):
                return characters, True
    return _WORD.findall(text), False


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and for each the length of its common prefix with the one before it (0 for the first)."""
    n = len(ids)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(ids, kind="stable")
    first = np.r_[True, ids[order[1:]] != ids[order[:-1]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank], 1
    sizes = np.bincount(rank, minlength=n)
    active = np.flatnonzero(sizes[rank] > 1)
    while len(active) and step < n:
        after = active + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        place = np.arange(len(active))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_old = np.r_[True, old[1:] != old[:-1]]
        start_key = np.maximum.accumulate(np.where(new_key, place, 0))
        start_old = np.maximum.accumulate(np.where(new_old, place, 0))
        rank = rank.copy()
        rank[active] = old + start_key - start_old
        levels.append(rank)
        step *= 2
        alone = np.bincount(np.cumsum(new_key) - 1)[np.cumsum(new_key) - 1] == 1
        active = active[~alone]
    order = np.argsort(rank, kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (left < n) & (right < n)
        same = np.zeros(len(common), bool)
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        # a rank at the text's end may stand for a shorter run than 2**k; such a suffix is alone in its rank
        common += same * (1 << k)
        left, right = left + same * (1 << k), right + same * (1 << k)
    return order, np.r_[0, common]


def repeated(ids: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position whether it stands in a run that occurred before, and the longest repeat that begins there.

    ``least``: for each position the length from which a run counts (that of its document).
    """
    n = len(ids)
    order, common = suffix_array(ids)
    if n == 0:
        return np.empty(0, bool), np.empty(0, np.int64)
    interval = np.cumsum(common < least[order])  # neighbours in one LCP interval of the counted length
    earliest = np.full(interval[-1] + 1, n, np.int64)
    np.minimum.at(earliest, interval, order)
    again = order[order != earliest[interval]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, np.minimum(again + least[again], n), -1)
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(common, np.r_[common[1:], 0])
    return np.cumsum(edge[:-1]) > 0, longest


def measure(texts: list[str | None], block: int = BLOCK) -> list[tuple[int, int, int, bool]]:
    """For each text its units, the repeated ones among them, its longest repeat, and whether units are characters."""
    out: list[tuple[int, int, int, bool]] = [(0, 0, 0, False)] * len(texts)
    waiting: list[tuple[int, list[str], bool]] = []

    def flush() -> None:
        if not waiting:
            return
        sizes = np.array([len(u) for _, u, _ in waiting])
        ids = np.empty(sizes.sum(), np.int64)
        at = top = 0
        for _, words, _ in waiting:
            codes, names = pd.factorize(np.array(words, dtype=object))
            ids[at : at + len(words)] = codes + top
            at, top = at + len(words), top + len(names)
        least = np.repeat([MIN_CHARACTERS if c else MIN_WORDS for _, _, c in waiting], sizes)
        marked, longest = repeated(ids, least)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        for (i, words, c), m, x in zip(waiting, np.add.reduceat(marked.astype(np.int64), starts), np.maximum.reduceat(longest, starts)):
            out[i] = (len(words), int(m), int(x), c)
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        words, characters = units(text) if text else ([], False)
        if words:
            if held and held + len(words) > block:
                flush()
                held = 0
            waiting.append((i, words, characters))
            held += len(words)
    flush()
    return out


def measure_repetition(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, units, repeated_units, repeated_share, longest_repeat, by_characters`` for each row.

    Null, empty and blank texts, and texts without letters and digits, have 0 units and the share 0. Rows are neither
    lost nor merged.
    """
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("units", T.LongType()),
            T.StructField("repeated_units", T.LongType()),
            T.StructField("longest_repeat", T.LongType()),
            T.StructField("by_characters", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame(measure(list(batch[text])), columns=schema.names[1:])
            rows.insert(0, key, batch[key].to_numpy())
            yield rows

    found = df.select(key, text).mapInPandas(run, schema)
    share = F.when(F.col("units") > 0, F.col("repeated_units") / F.col("units")).otherwise(F.lit(0.0))
    return found.withColumn("repeated_share", share)


def beyond_limits(measured: DataFrame, share: tuple[int, int] = LEAST_SHARE, words: int = MOST_WORDS, characters: int = MOST_CHARACTERS) -> DataFrame:
    """``measured`` with ``share_beyond``, ``longest_beyond`` (the longest repeat is longer than ``words`` or ``characters``)
    and ``repetitive``, which is true if either is. A document without units is within both limits."""
    most = F.when(F.col("by_characters"), characters).otherwise(words)
    over = (F.col("units") > 0) & (F.col("repeated_units") * share[1] >= F.col("units") * share[0])
    rows = measured.withColumns({"share_beyond": over, "longest_beyond": F.col("longest_repeat") > most})
    return rows.withColumn("repetitive", F.col("share_beyond") | F.col("longest_beyond"))


def mostly_repeated(measured: DataFrame, least: tuple[int, int] = LEAST_SHARE) -> DataFrame:
    """The rows whose repeated share is at least ``least``, compared in whole numbers."""
    return beyond_limits(measured, least).where("share_beyond").select(*measured.columns)
