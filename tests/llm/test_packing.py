import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from voxloom.llm import packing
from voxloom.llm.packing import best_fit, cost, crossover, cut, evolve, pack, packed_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "short", "<|endoftext|> inside", "word " * 5000, "é" * 700, "x" * 4096]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(2, "short", 0)], "doc_id long, text string, length int")
    rows = packed_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    check(rows, 1024)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        want = [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cut(len(ids), 1024))]
        assert own == sorted(want * (2 if i == 2 else 1))
        assert sum(n for _, _, n, _ in set(own)) == len(ids)
    assert packed_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_cut():
    assert cut(5, 10) == [(0, 5)] and cut(10, 10) == [(0, 10)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_blocks_and_islands(spark):
    rng = random.Random(1)
    lengths = [rng.choice([rng.randint(1, 1024), 1024, rng.randint(300, 700)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i long, length long").repartition(7)
    rows = pack(df, block=500).collect()
    assert sorted((r.i, r.length) for r in rows) == sorted(enumerate(lengths))
    assert check(rows, 1024) <= math.ceil(sum(lengths) / 1024) * 1.06


def test_crossover_and_evolution():
    rng = np.random.default_rng(3)
    lengths = rng.integers(150, 500, 400)
    start = [best_fit(lengths, rng.permutation(400), 1000) for _ in range(4)]
    child = crossover(lengths, start[0], start[1], 1000, random.Random(1))
    assert np.bincount(child, lengths).max() <= 1000 and set(child) == set(range(child.max() + 1))
    found = evolve(lengths, list(start), 1000, 7, generations=60)
    assert cost(lengths, found[0]) < min(cost(lengths, p) for p in start)


def test_fallback_to_the_library(monkeypatch, tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    text = ["some text", "<|endoftext|>x"]
    want = [Tokenizer.from_file(str(other)).encode(t, add_special_tokens=False).ids for t in text]
    assert [list(x) for x in packing.Encoder(str(other), public_tokenizers.PATTERN).encode(text)] == want
