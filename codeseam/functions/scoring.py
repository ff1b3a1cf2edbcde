"""Numbers: ranking weights, the seeded generator, nearest-rank percentiles and bootstrap intervals."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The weight of each signal.
WEIGHTS = {"fts": 0.34, "symbol": 0.18, "graph": 0.22, "code": 0.08, "path_hit": 0.08, "exact": 0.10, "recency": 0.0}
#: Without the graph the other signals share its weight; with the index's text score alone nothing else counts.
LEXICAL = {k: 0.0 if k == "graph" else w / 0.78 for k, w in WEIGHTS.items()}
FTS_ONLY = {k: float(k == "fts") for k in WEIGHTS}
#: The order in which reasons are given, and their names.
REASONS = {"fts": "fts", "symbol": "symbol", "exact": "exact", "graph": "graph", "path_hit": "path", "code": "code", "recency": "recency"}


def redistributed(weights: dict[str, float], present: list[str]) -> dict[str, float]:
    """The weights of absent signals go to the present ones in proportion."""
    there = sum(weights[k] for k in present)
    gone = sum(w for k, w in weights.items() if k not in present)
    if not there or len(present) == len(weights):
        return dict(weights)
    return {k: w + gone * w / there if k in present else 0.0 for k, w in weights.items()}


def fused(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    w = redistributed(weights, list(signals))
    return sum((F.coalesce(c, F.lit(0.0)) * w[k] for k, c in signals.items()), F.lit(0.0))


def reasons(signals: dict[str, Column]) -> Column:
    named = [F.when(F.coalesce(signals[k], F.lit(0.0)) > 0, label) for k, label in REASONS.items() if k in signals]
    return F.array_join(F.array_compact(F.array(*named)), ",")


def rounded(value: Column) -> Column:
    """To three digits, halves upwards."""
    return F.floor(value * 1000 + 0.5) / 1000


def min_max(value: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(1.0)).otherwise((value - low) / (high - low))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def nearest_rank(values: Column, percent: float) -> Column:
    """Of an array: the sorted value at the floor of the share of its length; 0 of an empty one."""
    ordered = F.array_sort(values)
    at = F.least(F.size(ordered) - 1, F.greatest(F.lit(0), F.floor(F.lit(percent / 100) * F.size(ordered)).cast("int")))
    return F.coalesce(F.get(ordered, at), F.lit(0.0))


class Xorshift:
    """The 32-bit generator that shuffles and bootstraps are seeded with."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF or 1

    def next(self) -> float:
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        self.state = x
        return x / 0x100000000


def seeded_shuffle(values: list, seed: int) -> list:
    out, random = list(values), Xorshift(seed)
    for i in range(len(out) - 1, 0, -1):
        j = math.floor(random.next() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def percentile(values: list[float], percent: float) -> float:
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, max(0, math.floor(percent / 100 * len(ordered))))] if ordered else 0.0


def bootstrap(values: list[float], seed: int, samples: int = 500) -> tuple[float, float]:
    """The 2.5 and 97.5 percentiles of resampled means."""
    if len(values) < 2:
        return (values[0], values[0]) if values else (0.0, 0.0)
    random, n = Xorshift(seed), len(values)
    means = []
    for _ in range(samples):
        total = 0.0
        for _ in range(n):
            total += values[math.floor(random.next() * n)]
        means.append(total / n)
    return percentile(means, 2.5), percentile(means, 97.5)


INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


@F.pandas_udf(INTERVAL)
def bootstrap_interval(values: pd.Series, seed: pd.Series) -> pd.DataFrame:
    """Of an array of task metrics in the order of their tasks."""
    return pd.DataFrame([bootstrap(list(v), int(s)) for v, s in zip(values, seed)], columns=["low", "high"])
