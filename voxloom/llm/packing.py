"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and an end id; longer ones are cut into full pieces after a first, shorter one. Full pieces are
sequences of their own. The other pieces are dealt by a hash of their row number into blocks of about ``BLOCK`` pieces, so
that a hot source or a group of copies spreads over all blocks. Each block is a packing problem that several islands
solve: a population per island, evolved in a task, written to the shared folder after each epoch, with the best individual
of an island moving to the next one in between.

Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold duplicates of
the injected pieces, and best-fits the displaced pieces, longest first, into what is open.

Defined cases: a null text counts as empty and packs as the end id alone; rows that repeat an id are packed one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from voxloom.llm.token_counts import byte_letters, groups_of_text
from voxloom.session import stage

CAPACITY, END_ID = 1024, 2
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2048, 3, 2, 4, 10
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    Where the ids of the vocabulary follow the order of its merges, a token's id is its rank and the texts are merged by rank;
    any other file is left to the library itself.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        if ids == list(range(256, 256 + len(ids))) and spec["pre_tokenizer"] | {"trim_offsets": True} == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        } and not spec["normalizer"]:
            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
            coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            self.encode = lambda texts: [coder.encode(t, allowed_special="all") for t in texts]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self.encode = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row with their digests."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [[], [], [], [], []]
            for a, b in groups_of_text(texts):
                for doc, tokens in zip(ids[a:b], encoder.encode(texts[a:b])):
                    data = memoryview(np.array([*tokens, END_ID], "<u4").tobytes())
                    for k, (start, length) in enumerate(cut(len(tokens) + 1, capacity)):
                        row = (doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]))
                        for column, value in zip(out, row):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return rows.mapInArrow(pieces, PIECES)


class Bins:
    """Open bins by free space, for best fit."""

    def __init__(self, capacity: int):
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some, self.capacity, self.count = 0, capacity, 0

    def open(self, space: int) -> int:
        """A new bin with so much space left."""
        self.count += 1
        self._put(self.count - 1, space)
        return self.count - 1

    def _put(self, bin_: int, space: int) -> None:
        self.free[space].append(bin_)
        self.some |= 1 << space

    def fit(self, length: int) -> int:
        """The fullest bin that takes the piece, or a new one."""
        enough = self.some >> length
        if not enough:
            return self.open(self.capacity - length)
        space = length + (enough & -enough).bit_length() - 1
        bin_ = self.free[space].pop()
        if not self.free[space]:
            self.some &= ~(1 << space)
        self._put(bin_, space - length)
        return bin_


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins, out = Bins(capacity), np.empty(len(lengths), np.int32)
    for i in order.tolist():
        out[i] = bins.fit(int(lengths[i]))
    return out


def cost(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(bins, lengths)
    return len(fill), -float(np.square(fill).sum())


def crossover(lengths: np.ndarray, receiver: np.ndarray, donor: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    fill = np.bincount(donor, lengths)
    ranked = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    picked = np.zeros(len(fill), bool)
    picked[rng.sample(ranked.tolist(), max(1, len(ranked) // 2))] = True
    injected = picked[donor]
    broken = np.zeros(receiver.max() + 1, bool)
    broken[receiver[injected]] = True
    own = np.bincount(receiver, lengths)
    worst = np.argsort(own, kind="stable")[: 1 + len(own) // 50]
    broken[worst] = True  # mutation: the emptiest bins are dealt anew as well
    displaced = broken[receiver] & ~injected
    kept = ~injected & ~displaced
    _, first = np.unique(donor[injected], return_inverse=True)
    _, second = np.unique(receiver[kept], return_inverse=True)
    child = np.empty(len(lengths), np.int32)
    child[injected] = first
    child[kept] = second + (first.max() + 1 if len(first) else 0)
    bins = Bins(capacity)
    settled = injected | kept
    for space in (capacity - np.bincount(child[settled], lengths[settled])).astype(int).tolist():
        bins.open(space)
    rest = np.flatnonzero(displaced)
    for i in rest[np.argsort(-lengths[rest], kind="stable")].tolist():
        child[i] = bins.fit(int(lengths[i]))
    return child


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, size: int = POPULATION, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, best first. It is founded where it is empty."""
    rng, noise = random.Random(seed), np.random.default_rng(seed)
    while len(population) < size:
        key = -lengths * (1 + (0.05 if population else 0) * noise.standard_normal(len(lengths)))
        population.append(best_fit(lengths, np.argsort(key, kind="stable"), capacity))
    ranked = sorted(((cost(lengths, p), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])[:size]
    least, serial = math.ceil(lengths.sum() / capacity), size
    for _ in range(generations):
        if ranked[0][0][0] <= least:
            break
        one, two = rng.sample(range(size), 2)
        child = crossover(lengths, ranked[max(one, two)][2], ranked[min(one, two)][2], capacity, rng)
        serial += 1
        ranked = sorted([*ranked, (cost(lengths, child), serial, child)], key=lambda x: x[:2])[:size]
    return [x[2] for x in ranked]


def _epoch(islands: DataFrame, capacity: int, seed: int) -> DataFrame:
    """One epoch of every island: (block, island, population), the best individual first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                found = [np.array(p, np.int32) for p in (row["population"] or []) + (row["guests"] or [])]
                found = evolve(lengths, found, capacity, seed * 1_000_003 + row["block"] * 31 + row["island"])
                yield pa.RecordBatch.from_pylist(
                    [{"block": row["block"], "island": row["island"], "population": [p.tolist() for p in found], "bins": int(found[0].max()) + 1}],
                    pa.schema([("block", pa.int64()), ("island", pa.int32()), ("population", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32())]),
                )

    return islands.mapInArrow(run, "block long, island int, population array<array<int>>, bins int")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``."""
    rows = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = rows.filter(F.col("length") == capacity)
    loose = rows.filter(F.col("length") < capacity)
    blocks = max(1, math.ceil(loose.count() / block))
    dealt = loose.select(F.pmod(F.xxhash64("_row"), F.lit(blocks)).alias("block"), "length", "_row")
    items = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("length"), "_row")))
    problems = dealt.groupBy("block").agg(items.alias("items")).select(
        "block", F.transform("items", lambda x: x["_row"]).alias("rows"), F.transform("items", lambda x: -x["length"]).alias("lengths")
    )
    problems = stage(problems, "blocks")
    start = problems.select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    none = F.lit(None).cast("array<array<int>>")
    state = start.withColumns({"population": none, "guests": none}).repartition("block", "island")
    for epoch in range(epochs):
        found = stage(_epoch(state, capacity, epoch), "islands")
        if epoch + 1 < epochs:
            elite = found.select(
                "block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.slice("population", 1, 1).alias("guests")
            )
            state = start.join(found.drop("bins"), ["block", "island"]).join(elite, ["block", "island"])
    best = found.groupBy("block").agg(F.min_by(F.get("population", F.lit(0)), F.struct("bins", "island")).alias("bins"))
    placed = _places(problems.join(best, "block"))
    packed = loose.join(placed, "_row").withColumn("sequence_id", F.col("_bin") * 2).drop("_bin")
    whole = full.withColumns({"offset": F.lit(0).cast("bigint"), "sequence_id": F.col("_row") * 2 + 1})
    return packed.unionByName(whole).drop("_row")


def _places(solved: DataFrame) -> DataFrame:
    """(_row, _bin, offset) of every piece of the solved blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins, lengths = np.array(row["bins"], np.int64), np.array(row["lengths"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                begins = ends - lengths[order]
                first = np.append(True, np.diff(bins[order]) != 0)
                offsets = begins - np.maximum.accumulate(np.where(first, begins, 0))
                columns = [np.array(row["rows"], np.int64)[order], (row["block"] << 31) + bins[order], offsets]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["_row", "_bin", "offset"])

    return solved.select("block", "rows", "lengths", "bins").mapInArrow(run, "_row long, _bin long, offset long")


def packed_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(tokenised(docs, path, pattern, id_col, text_col))
