import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from voxloom.llm.byte_bpe import Codec, encode, read_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "hello world", "aaaa aaa aa a", "a" * 300, "é" * 40 + "\n\n  x", "don't we'll  it's\t\ttabs", "数字123混合abc🙂🙂 ٣",
    "<|endoftext|>", "non breaking space \x1c", "'s'S \"quoted\" \\ back", "x1y2 " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("common", [1, 1 << 10])
def test_against_the_library(spark, library, common):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1)], "doc_id long, text string, ids int")
    got = round_trip(df, PATH, public_tokenizers.PATTERN, common=common).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r.id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decode_and_empty(spark, library):
    codec = Codec(PATH, public_tokenizers.PATTERN)
    rows = [([1, 2, 50255],), ([],)]
    got = spark.createDataFrame(rows, "ids array<int>").select(codec.decode(F.col("ids")).alias("b")).collect()
    assert [bytes(r.b) for r in got] == [library.decode_bytes(ids) for ids, in rows]
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0


def test_tables_are_no_literals(spark):
    """A plan that holds merges and words as literals is printed, kept and sent with them."""
    df = spark.createDataFrame([(0, "hello wworldd"), (1, "ababaab baababab")], "doc_id long, text string")
    plan = round_trip(df, PATH, public_tokenizers.PATTERN, common=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan
    assert len(plan) < 4 << 20  # the pieces of decoding are a literal
