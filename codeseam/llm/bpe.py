"""Encoding of texts with a byte-level BPE vocabulary.

Method: texts are cut into words by the vocabulary's pattern, and the distinct words that a block of texts adds are a
trie of their bytes, held as their sorted list. It is traversed depth-first: going from a word to the next means to go
back up to their common prefix and down again, so a prefix that words share is entered once. The state of a trie node
is the last token of the encoding of the prefix that ends there: the one entry ``t`` of the vocabulary that ends the
prefix and stays as it is next to the state of the node where ``t`` begins. A word's ids are read off by following the
states backwards from its end. Texts are then put together from the words' ids, as arrays.

This gives exactly the encoding by merges: a merge looks at two neighbours only, so tokens are the encoding of their
bytes if and only if each two neighbours are that of theirs.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

#: The pattern that cuts texts into words. White space is Unicode's White_Space property, which Python's ``\s``
#: exceeds by four control characters.
_WS = r"\p{White_Space}"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?!(?!{_WS}).)|{_WS}+"
#: The same for texts in ASCII.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Characters of words that a worker remembers with their ids, and pairs of tokens; beyond them memory begins anew,
#: which changes the speed only.
REMEMBERED_CHARACTERS = 4_000_000
REMEMBERED_PAIRS = 400_000
#: Texts are encoded in blocks of about so many characters.
BLOCK_CHARACTERS = 4_000_000


class Trie:
    """The vocabulary, and the traversal of tries of words."""

    def __init__(self, ranks: dict[bytes, int], characters: int = REMEMBERED_CHARACTERS):
        self.ranks, self.limit = ranks, characters
        self.tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in self.tokens] != list(range(len(self.tokens))):
            raise ValueError("the ranks of a vocabulary must be dense")
        self.sizes = [len(t) for t in self.tokens]
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        self._read_vocabulary()
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}  # of each word remembered
        self.characters = 0
        self.ids = np.empty(0, np.int32)  # of all of them, one after the other
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def _read_vocabulary(self) -> None:
        """An automaton over the vocabulary: after each byte its state is the longest beginning of a token that ends there."""
        self.steps: dict[int, int] = {}  # from a state (times 256) by a byte; those that fall back are added when met
        parents, token_at = [(0, 0, 0)], [-1]
        for token, text in enumerate(self.tokens):
            state = 0
            for depth, byte in enumerate(text):
                key = state << 8 | byte
                state = self.steps.get(key, 0)
                if not state:
                    state = self.steps[key] = len(parents)
                    parents.append((depth, key >> 8, byte))
                    token_at.append(-1)
            token_at[state] = token
        self.states = len(parents)
        self.fallback = [0] * self.states  # the longest other state that ends a state's bytes
        self.longest = token_at  # of a state, the longest token that ends its bytes
        self.shorter = [-1] * len(self.tokens)  # of a token, the next longest that ends its bytes
        for state in sorted(range(1, self.states), key=lambda x: parents[x][0]):
            depth, parent, byte = parents[state]
            back = self._step(self.fallback[parent], byte) if depth else 0
            self.fallback[state] = back
            if token_at[state] < 0:
                token_at[state] = token_at[back]
            else:
                self.shorter[token_at[state]] = token_at[back]

    def _step(self, state: int, byte: int) -> int:
        while state and state << 8 | byte not in self.steps:
            state = self.fallback[state]
        return self.steps.get(state << 8 | byte, 0)

    # -- which tokens stay as they are

    def _halves(self, token: int) -> tuple[bytes, bytes]:
        """The two parts whose merge forms a token of several bytes, found by the merges themselves."""
        parts = [self.tokens[token][i : i + 1] for i in range(self.sizes[token])]
        whole = len(self.tokens)
        while len(parts) > 2:
            ranked = [self.ranks.get(a + b, whole) for a, b in zip(parts, parts[1:])]
            at = ranked.index(min(ranked))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _edges(self, token: int) -> tuple[list, list]:
        """What stands at the token's left and at its right border while it is put together, as ``(bytes, born, gone)``.

        Merges come in the order of their ranks, so ranks are times: a part is born at its own rank and gone at that of
        the part it goes into; the token itself stays.
        """
        found = self.edges.get(token)
        if found is None:
            forever = len(self.tokens)
            text = self.tokens[token]
            left, right = [(text, token, forever)], [(text, token, forever)]
            if len(text) > 1:
                a, b = self._halves(token)
                left += [(t, born, min(gone, token)) for t, born, gone in self._edges(self.ranks[a])[0]]
                right += [(t, born, min(gone, token)) for t, born, gone in self._edges(self.ranks[b])[1]]
            found = self.edges[token] = (left, right)
        return found

    def stay(self, a: int, b: int) -> bool:
        """True if the tokens ``a`` and ``b`` next to each other are the encoding of their bytes.

        Each forms as if it were alone until a merge crosses the border. A part at the right border of ``a`` and one at
        the left border of ``b`` are merged if the vocabulary has both together, from the moment at which both are born,
        and before either goes into a larger part. At equal ranks the merge further left comes first.
        """
        rank = self.ranks.get
        ours = self._edges(b)[0]
        for x, x_born, x_gone in self._edges(a)[1]:
            for y, y_born, y_gone in ours:
                across = rank(x + y)
                if across is not None:
                    at = max(across, x_born, y_born)
                    if at < x_gone and at <= y_gone:
                        return False
        return True

    # -- the traversal

    def _learn(self, words: list[str]) -> None:
        """Depth-first over the trie of new words; their ids are remembered in the order of ``words``."""
        texts = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes, longest, shorter, steps, pairs = self.sizes, self.longest, self.shorter, self.steps, self.pairs
        if len(pairs) > REMEMBERED_PAIRS:
            pairs.clear()
        if len(steps) > self.states + REMEMBERED_PAIRS:
            self.steps = steps = dict(islice(steps.items(), self.states - 1))
        n = len(self.tokens)
        ids: list[int] = []
        begin, size = [0] * len(texts), [0] * len(texts)
        deepest = max(map(len, texts), default=0) + 1
        last, states = [-1] * deepest, [0] * deepest  # from the root to the present node: its token, the automaton's state
        before = b""
        for at in sorted(range(len(texts)), key=texts.__getitem__):
            text = texts[at]
            common = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                common += 1
            state = states[common]
            for end in range(common + 1, len(text) + 1):
                byte = text[end - 1]
                key = state << 8 | byte
                state = steps.get(key)
                if state is None:
                    state = steps[key] = self._step(key >> 8, byte)
                states[end] = state
                token = longest[state]  # a longer one is likelier
                while start := end - sizes[token]:
                    pair = last[start] * n + token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.stay(last[start], token)
                    if fits:
                        break
                    token = shorter[token]
                last[end] = token
            before = text
            first, end = len(ids), len(text)
            while end:
                token = last[end]
                ids.append(token)
                end -= sizes[token]
            ids[first:] = ids[first:][::-1]
            begin[at], size[at] = first, len(ids) - first
        self.begin = np.concatenate([self.begin, np.array(begin, np.int64) + len(self.ids)])
        self.size = np.concatenate([self.size, np.array(size, np.int64)])
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])

    def numbered(self, words: list[str]) -> np.ndarray:
        """The slot of each word; the trie of those that have none yet is traversed."""
        if self.characters > self.limit:
            self.clear()
        slots = self.slots
        known = len(slots)
        for w in dict.fromkeys(words):
            if w not in slots:
                slots[w] = len(slots)
        if len(slots) > known:
            new = list(islice(slots, known, None))
            self.characters += sum(map(len, new))
            self._learn(new)
        return np.fromiter(map(slots.__getitem__, words), np.int64, len(words))


class Encoder:
    def __init__(self, vocabulary: str = BYTE_BPE_50K):
        ranks = {}
        for line in Path(vocabulary).read_bytes().splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.trie = Trie(ranks)
        self._ascii = re.compile(ASCII_PATTERN).findall
        self._other = regex.compile(PATTERN, regex.DOTALL).findall

    def split(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._other(text)

    def _blocks(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block of texts the slots of all words, and the number of words of each text."""
        words: list[str] = []
        numbers: list[int] = []
        held = 0
        for text in texts:
            own = self.split(text) if text else []
            words += own
            numbers.append(len(own))
            held += len(text or "")
            if held >= BLOCK_CHARACTERS:
                yield self.trie.numbered(words), np.array(numbers)
                words, numbers, held = [], [], 0
        if numbers:
            yield self.trie.numbered(words), np.array(numbers)

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        out = [np.empty(0, np.int64)]
        for slots, numbers in self._blocks(texts):
            sums = np.r_[0, np.cumsum(self.trie.size[slots])]
            ends = np.cumsum(numbers)
            out.append(sums[ends] - sums[ends - numbers])
        return np.concatenate(out)

    def lists(self, texts: Iterable[str | None]) -> Iterator[pa.ListArray]:
        """The ids of the texts, a block of texts at a time."""
        for slots, numbers in self._blocks(texts):
            sizes = self.trie.size[slots]
            sums = np.r_[0, np.cumsum(sizes)]
            places = np.arange(sums[-1]) + np.repeat(self.trie.begin[slots] - sums[:-1], sizes)
            offsets = sums[np.r_[0, np.cumsum(numbers)]].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.trie.ids[places]))

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text; an empty list for an empty or null text. Special tokens' strings are ordinary text."""
        return [i for ids in self.lists([text]) for i in ids[0].as_py()]


@lru_cache(maxsize=2)
def encoder(vocabulary: str = BYTE_BPE_50K) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(vocabulary)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``key, ids`` for each row of ``df``; null and empty texts have an empty list. Rows are neither lost nor merged."""
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = encoder(vocabulary).lists
        for batch in batches:
            at = 0
            for ids in lists(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids], names=[key, "ids"])
                at += len(ids)

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(text: str = "text", vocabulary: str = BYTE_BPE_50K):
    """A column with the number of ids of ``text``, 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(vocabulary).counts(texts))

    return count(F.col(text))
