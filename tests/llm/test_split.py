from hypothesis import given, settings
from hypothesis import strategies as st

from codeseam.llm import split

DDL = "id string, content string, start_line int, piece_no string, key string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n.,;{}\r漢", max_size=400), st.integers(1, 60), st.integers(0, 59))
def test_pieces_cover_and_stay_within_limits(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    cuts = split.pieces(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b - a <= limit for a, b in cuts)
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_natural_ends_come_first():
    text = "one two three.\n" * 10 + "\n" + "four five six.\n" * 10
    first = split.pieces(text, 200, 0)[0]
    assert text[: first[1]].endswith("\n\n")
    words = "word " * 100
    assert all(words[:b].endswith(" ") for _, b in split.pieces(words, 52, 10)[:-1])
    assert [b - a for a, b in split.pieces("x" * 25, 10, 0)] == [10, 10, 5]


def test_operator(spark):
    long = "".join(f"line {i}\n" for i in range(400))
    rows = [("a", long, 11, "x", "y"), ("a", long, 11, "x", "y"), ("b", "short", None, None, None), ("c", None, 1, None, None), ("d", "", 3, None, None), ("e", "z" * 4500, 1, None, None)]
    out = split.split_oversized(spark.createDataFrame(rows, DDL)).orderBy("id", "piece_no").collect()
    a = [r for r in out if r["id"] == "a"]
    assert [r["piece_no"] for r in a] == list(range(len(a))) and len(a) > 1
    for r in a:
        assert r["content"] == long[r["piece_start"] : r["piece_end"]] and len(r["content"]) <= 2000
        assert r["content"].startswith(f"line {r['start_line'] - 11}") and r["content"].rstrip().endswith(f"line {r['end_line'] - 11}")
    assert {r["id"] for r in out} == {"a", "b", "d", "e"}  # a null text gives no piece
    assert next(r for r in out if r["id"] == "d")["content"] == ""
    assert sum(r["id"] == "e" for r in out) == 3
    only = split.split_oversized(spark.createDataFrame(rows, DDL), oversized_only=True)
    assert {r["id"] for r in only.collect()} == {"a", "e"}
    assert split.split_oversized(spark.createDataFrame([], DDL)).count() == 0


def test_pieces_share_text_wherever_the_cut_is():
    """A long last line, or a long last word, does not keep pieces from sharing up to the overlap."""
    line = "word " * 60 + "\n"
    for text in (line * 20, "x" * 5000, ("y" * 150 + "\n") * 40):
        cuts = split.pieces(text, 2000, 100)
        assert all(0 < b - c <= 100 for (_, b), (c, _) in zip(cuts, cuts[1:]))
    starts = [c for c, _ in split.pieces(line * 20, 2000, 100)[1:]]
    assert all((line * 20)[c - 1] in " \n" for c in starts)  # at a word if there is one
