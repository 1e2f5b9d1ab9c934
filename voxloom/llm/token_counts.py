"""Token counts of a byte-level BPE by merging ragged arrays of pre-tokens, rank by rank.

The pre-tokens of a batch that have not been met before are held as one flat array of symbol ids with offsets. In
each round every sequence takes its own pair of lowest rank and merges all its occurrences at once, left to right;
finished sequences leave the arrays. The number of symbols that survive is the number of tokens.

The vocabulary file is read from its path by the Python workers, which keep counts of pre-tokens between batches in a
dictionary that is emptied when it is full. Texts are split by the library's pattern, after its special strings are cut out as
one token each. Work is per row: no shuffle; a batch holds a few MB of text.

Defined cases: a null text counts as empty (0 tokens); rows that repeat an id give a row each; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_CHARS = 1 << 20
PASS_SYMBOLS = 1 << 20
KEPT_WORDS = 400_000
NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and special strings of a ``tokenizers`` file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.size = len(vocab)
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        codes = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NONE)


def surviving(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Number of tokens of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = lengths.copy()
    ids = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    row = np.repeat(np.arange(len(words)), lengths)
    while len(ids):
        joined = np.append(row[1:] == row[:-1], False)
        ranks = np.full(len(ids), NONE)
        at = np.flatnonzero(joined)
        ranks[at] = vocabulary.rank(ids[at], ids[at + 1])
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(ranks, starts)
        sizes = np.diff(np.append(starts, len(ids)))
        counts[row[starts]] = sizes
        least = np.repeat(least, sizes)
        chosen = (ranks == least) & (least < NONE)
        begins = chosen & ~np.append(False, chosen[:-1])  # of runs such as a a a, every other pair is merged
        since = np.arange(len(ids)) - np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))
        merged = np.flatnonzero(chosen & (since % 2 == 0))
        ids[merged] = vocabulary.results[ranks[merged]]
        stays = least < NONE
        stays[merged + 1] = False
        ids, row = ids[stays], row[stays]
    return counts


@lru_cache(maxsize=4)
def _loaded(path: str) -> Vocabulary:
    return Vocabulary(path)


class Counter:
    """Token counts of texts, with the counts of pre-tokens met so far."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern, self.known = _loaded(path), regex.compile(pattern), {}

    def _learn(self, words: set[str]) -> None:
        """Add the counts of ``words``, all of which are needed next."""
        missing = words - self.known.keys()
        if len(self.known) + len(missing) > KEPT_WORDS:
            self.known.clear()
            missing = words
        todo, held = [], 0
        for word in missing:
            todo.append(word)
            held += len(word)
            if held >= PASS_SYMBOLS:
                self.known.update(zip(todo, surviving([w.encode() for w in todo], self.vocabulary).tolist()))
                todo, held = [], 0
        if todo:
            self.known.update(zip(todo, surviving([w.encode() for w in todo], self.vocabulary).tolist()))

    def _sum(self, words: list[str]) -> int:
        self._learn(set(words))
        return sum(map(self.known.__getitem__, words))

    def _pieces(self, text: str) -> list[str]:
        special = self.vocabulary.special
        return special.split(text) if special and special.search(text) else [text]

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of a few MB of texts; a longer text is taken in runs of its pre-tokens."""
        if sum(map(len, texts)) > 4 * BATCH_CHARS:
            return [self._long(t) for t in texts]
        lists, extra = [], []
        for text in texts:
            pieces = self._pieces(text)
            extra.append(len(pieces) - 1)
            lists.append([w for p in pieces for w in self.pattern.findall(p)] if len(pieces) > 1 else self.pattern.findall(text))
        self._learn(set().union(*lists))
        return [n + sum(map(self.known.__getitem__, words)) for n, words in zip(extra, lists)]

    def _long(self, text: str) -> int:
        pieces = self._pieces(text)
        total = len(pieces) - 1
        for piece in pieces:
            matches = (m.group() for m in self.pattern.finditer(piece))
            while words := list(islice(matches, 100_000)):
                total += self._sum(words)
        return total


def groups_of_text(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            n = [x for a, b in groups_of_text(texts) for x in counter.counts(texts[a:b])]
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.record_batch([ids, sizes, pa.array(n, pa.int64()), over], ["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean")
