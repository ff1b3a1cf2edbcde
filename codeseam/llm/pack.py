"""Filling containers of fixed capacity with items.

Method: best-fit decreasing. The next item, the largest left, goes to the open container with the least remaining
capacity that holds it, found by a segment tree over the remaining capacities in logarithmic time.

Sizes are whole numbers up to the capacity, so equal items are interchangeable and so are equally full containers.
The rule is therefore run over the histogram of sizes, which has at most ``capacity`` rows however many documents
there are, and moves whole groups of containers at once; its result is the same as that of placing item by item. The
items then find their places by their rank within their size. Ranks are built from counts of hashed buckets, so no
task sees more than a bucket of the items of one size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from codeseam.session import checkpointed

#: Items of one size that a task ranks at once, on average.
BUCKET_ITEMS = 200_000


class SegmentTree:
    """The remaining capacities of which there is an open container, as a set of 0..n with its least member from x."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        at += self.leaves
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def least_from(self, x: int) -> int | None:
        at = x + self.leaves
        if self.any[at]:
            return x
        while at > 1:  # up to the first ancestor with something on its right, then down its left edge
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


@dataclass(frozen=True)
class Segment:
    """The items of ``size`` with ranks ``[first, first + n)`` fill the containers from ``container`` on, ``each`` apiece."""

    size: int
    first: int
    n: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Best-fit decreasing over ``{size: items}``; also gives the number of containers."""
    tree = SegmentTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: container ranges (from, number)
    out, opened = [], 0

    def add(rest: int, start: int, number: int) -> None:
        if number:
            groups.setdefault(rest, []).append((start, number))
            tree.set(rest, True)

    for size in sorted(histogram, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError(f"no container holds an item of size {size}")
        placed, left = 0, histogram[size]
        while left:
            rest = tree.least_from(size)
            if rest is None:
                rest, each = capacity, capacity // size
                start, number = opened, -(-left // each)
                opened += number
            else:
                each = rest // size
                start, number = groups[rest].pop()
                if not groups[rest]:
                    tree.set(rest, False)
            items = min(left, number * each)
            full, more = divmod(items, each)
            out.append(Segment(size, placed, items, start, each))
            add(rest - each * size, start, full)
            if more:
                add(rest - more * size, start + full, 1)
            used = full + (more > 0)
            add(rest, start + used, number - used)
            placed, left = placed + items, left - items
    return out, opened


def pack(items: DataFrame, key: str, tokens: Column, capacity: int = 2048) -> DataFrame:
    """``key, piece_no, token_start, token_end, n_tokens, container`` for each piece of each row of ``items``.

    A row above the capacity is cut into pieces of the capacity and a rest; every other row is one piece. A row of size
    0 (null and empty texts) takes no room and has a null container. Repeated rows are items of their own. An empty
    table gives an empty result.
    """
    spark = items.sparkSession
    sized = checkpointed(items.select(F.col(key).alias("key"), tokens.alias("tokens")))  # sizes are costly, ranks need them twice
    cap = F.lit(capacity)
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / cap) - 1, F.lit(0)).cast("int"))
    pieces = sized.select("key", "tokens", F.explode(numbers).alias("piece_no")).select(
        "key",
        "piece_no",
        (F.col("piece_no") * cap).cast("bigint").alias("token_start"),
        F.least((F.col("piece_no") + 1) * cap, F.col("tokens")).cast("bigint").alias("token_end"),
    )
    pieces = pieces.withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    histogram = {r["n_tokens"]: r["count"] for r in pieces.where(F.col("n_tokens") > 0).groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    segments, _ = plan(histogram, capacity)
    buckets = max(1, -(-max(histogram.values(), default=1) // BUCKET_ITEMS))

    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece_no"), F.lit(buckets)))
    before = W.partitionBy("n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.where(F.col("n_tokens") > 0).groupBy("n_tokens", "bucket").count().select(  # capacity x buckets rows at most
        F.col("n_tokens").alias("_size"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    within = W.partitionBy("n_tokens", "bucket").orderBy("key", "piece_no")
    ranked = (
        placed.where(F.col("n_tokens") > 0)
        .withColumn("place", F.row_number().over(within) - 1)
        .join(offsets, (F.col("n_tokens") == F.col("_size")) & (F.col("bucket") == F.col("_bucket")))
        .withColumn("rank", F.col("offset") + F.col("place"))
    )
    ddl = "_of INT, first BIGINT, n BIGINT, start BIGINT, each INT"
    table = F.broadcast(spark.createDataFrame([(s.size, s.first, s.n, s.container, s.each) for s in segments], ddl))  # bounded by the capacity
    names = ["key", "piece_no", "token_start", "token_end", "n_tokens"]
    filled = ranked.join(
        table, (F.col("n_tokens") == F.col("_of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    ).select(*names, (F.col("start") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("container"))
    empty = pieces.where(F.col("n_tokens") == 0).select(*names, F.lit(None).cast(T.LongType()).alias("container"))
    return filled.unionByName(empty).withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: ``containers, items, tokens, waste_share, least_containers``. Containers are numbered from 0 without gaps."""
    used = packed.where(F.col("container").isNotNull())
    return used.agg(
        (F.coalesce(F.max("container"), F.lit(-1)) + 1).alias("containers"),
        F.count("*").alias("items"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
    ).select(
        "*",
        F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(F.lit(0.0)).alias("waste_share"),
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
    )
