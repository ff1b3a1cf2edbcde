import random
from collections import Counter

from pyspark.sql import functions as F

from codeseam.llm import pack


def best_fit_decreasing(sizes, capacity):
    rest = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rest) if r >= s]
        if fits:
            rest[min(fits)[1]] -= s
        else:
            rest.append(capacity - s)
    return sorted(rest)


def test_plan_equals_item_by_item():
    random.seed(5)
    for _ in range(300):
        capacity = random.choice([1, 2, 7, 20, 100])
        sizes = [random.randint(1, capacity) for _ in range(random.randint(0, 150))]
        segments, n = pack.plan(Counter(sizes), capacity)
        load, placed = Counter(), Counter()
        for s in segments:
            placed[s.size] += s.n
            for rank in range(s.n):
                load[s.container + rank // s.each] += s.size
        assert placed == Counter(sizes)
        assert sorted(capacity - load[i] for i in range(n)) == best_fit_decreasing(sizes, capacity)


def test_segment_tree():
    tree, there = pack.SegmentTree(37), set()
    random.seed(2)
    for _ in range(2000):
        x = random.randint(0, 37)
        tree.set(x, on := random.random() < 0.5)
        there = there | {x} if on else there - {x}
        y = random.randint(0, 37)
        assert tree.least_from(y) == min((t for t in there if t >= y), default=None)


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(pack, "BUCKET_ITEMS", 3)  # several buckets of a size
    random.seed(9)
    sizes = [0, 0, 100, 100, 101, 250, *[random.choice([1, 7, 33, 50, 60, 99]) for _ in range(200)]]
    ddl = "doc_id long, n long, container string, bucket string"
    df = spark.createDataFrame([(i // 2 if i > 190 else i, n, None, None) for i, n in enumerate(sizes)], ddl)  # some ids repeat
    out = pack.pack(df, "doc_id", F.col("n"), 100).collect()
    load = Counter()
    for r in out:
        assert r["n_tokens"] == r["token_end"] - r["token_start"]
        if r["n_tokens"]:
            load[r["container"]] += r["n_tokens"]
        else:
            assert r["container"] is None
    cut = [p for n in sizes for p in [100] * (n // 100) + ([n % 100] if n % 100 else [])]
    assert sorted(100 - x for x in load.values()) == best_fit_decreasing(cut, 100)
    assert sum(load.values()) == sum(sizes) and len(out) == len(cut) + 2
    assert [(r["piece_no"], r["token_start"], r["token_end"]) for r in sorted(out, key=lambda r: r["piece_no"]) if r["doc_id"] == 5] == [(0, 0, 100), (1, 100, 200), (2, 200, 250)]
    total = pack.fill(pack.pack(df, "doc_id", F.col("n"), 100), 100).head()
    assert total["containers"] == len(load) and total["tokens"] == sum(sizes)
    empty = pack.pack(df.limit(0), "doc_id", F.col("n"), 100)
    assert empty.count() == 0 and pack.fill(empty, 100).head()["containers"] == 0
