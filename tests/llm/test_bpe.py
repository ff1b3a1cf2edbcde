import base64
import random

import pytest

from codeseam.llm import bpe


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.BYTE_BPE_50K, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_a_merge_based_encoder(reference):
    random.seed(7)
    ours = bpe.Encoder()
    letters = "ab eEsthe'  \n\t\x1c\x85  é中ß0 9!<|endoftext|>функция"
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 80)))
        assert ours.encode(text) == reference.encode_ordinary(text), repr(text)
    for start in range(0, 0x30000, 997):
        if not 0xD800 <= start <= 0xDFFF:
            text = f"a{chr(start)} {chr(start)}b1"
            assert ours.encode(text) == reference.encode_ordinary(text), hex(start)


def test_a_small_trie_changes_nothing(reference):
    trie = bpe.Encoder()
    trie.trie.limit = 50
    text = "def tokenize(prefix_sharing, trie): return shared_prefixes_once " * 5
    assert trie.encode(text) == reference.encode_ordinary(text)


def test_operator(spark, reference):
    ddl = "doc_id long, text string, ids string"
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", None), (None, "x", None), (5, "ab" * 200_000, None)]
    out = bpe.encode_texts(spark.createDataFrame(rows, ddl)).collect()
    assert len(out) == 6
    got = {r["doc_id"]: r["ids"] for r in out}
    assert got[1] == reference.encode_ordinary("hello world") and got[2] == [] and got[3] == []
    assert reference.decode(got[5]) == "ab" * 200_000
    counts = spark.createDataFrame(rows, ddl).select("doc_id", bpe.count_tokens().alias("n")).collect()
    assert {(r["doc_id"], r["n"]) for r in counts} == {(k, len(v)) for k, v in got.items()}
    assert bpe.encode_texts(spark.createDataFrame([], ddl)).count() == 0
