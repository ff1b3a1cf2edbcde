import random

from codeseam.llm import repetition as R


def brute(units, least):
    seen, marked = set(), [False] * len(units)
    for i in range(len(units) - least + 1):
        gram = tuple(units[i : i + least])
        if gram in seen:
            marked[i : i + least] = [True] * least
        seen.add(gram)
    longest = 0
    for i in range(len(units)):
        for j in range(i + 1, len(units)):
            n = 0
            while j + n < len(units) and units[i + n] == units[j + n]:
                n += 1
            longest = max(longest, n)
    return sum(marked), longest


def test_against_brute_force():
    random.seed(3)
    texts = []
    for _ in range(300):
        n, k = random.choice([0, 1, 4, 5, 6, 20, 60]), random.choice([1, 2, 3, 30])
        texts.append(" ".join(random.choice("abcdefghijklmnopqrstuvwxyzäöüß"[:k]) for _ in range(n)))
    texts += ["天地玄黄宇宙洪荒日月" * 3, "天" * 25, None, "", "  ", "?! ...", "A b, C d e. a B c d E!"]
    for text, got in zip(texts, R.measure(texts, block=500)):
        units, characters = R.units(text) if text else ([], False)
        assert got[:3] == (len(units), *brute(units, 10 if characters else 5)), text


def test_blocks_do_not_mix_documents():
    texts = ["alpha beta gamma delta epsilon zeta"] * 50
    assert all(m == 0 for _, m, _, _ in R.measure(texts))
    assert R.measure(texts, block=7) == R.measure(texts)


def test_operator(spark):
    spam = "buy this very good thing now "
    ddl = "doc_id long, text string, units string"
    rows = [(1, spam * 5, None), (2, "a text that says each thing only once", None), (3, None, None), (4, "", None), (1, spam * 5, None), (6, "word " * 100_000, None), (7, "短い文を繰り返す話。" * 20, None)]
    out = R.measure_repetition(spark.createDataFrame(rows, ddl))
    assert out.count() == len(rows)
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["units"] == 30 and by[1]["repeated_units"] == 24 and by[1]["longest_repeat"] == 24
    assert by[3]["repeated_share"] == 0.0 and by[4]["units"] == 0 and by[7]["by_characters"]
    assert {r["doc_id"] for r in R.mostly_repeated(out).collect()} == {1, 6, 7}
    assert R.measure_repetition(spark.createDataFrame([], ddl)).count() == 0


def test_limits(spark):
    ddl = "doc_id long, units long, repeated_units long, longest_repeat long, by_characters boolean, repeated_share double"
    rows = [(1, 10, 3, 3, False, 0.3), (2, 1000, 101, 101, False, 0.101), (3, 1000, 100, 100, False, 0.1), (4, 1000, 150, 150, True, 0.15), (5, 0, 0, 0, False, 0.0)]
    out = {r["doc_id"]: (r["share_beyond"], r["longest_beyond"], r["repetitive"]) for r in R.beyond_limits(spark.createDataFrame(rows, ddl)).collect()}
    no = (False, False, False)
    assert out == {1: (True, False, True), 2: (False, True, True), 3: no, 4: no, 5: no}
