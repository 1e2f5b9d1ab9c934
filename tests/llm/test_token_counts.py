import public_tokenizers
import pytest
from tokenizers import Tokenizer
from voxloom.llm import token_counts as module
from voxloom.llm.token_counts import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "hello world", "a" * 1000, "aaaa aaa aa a", "é" * 77 + "\n\n  x", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>",
    "don't we'll  it's\t\ttabs", "数字123混合abc🙂🙂", "ab" * 3000, "x1y2 " * 3000, "   end ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_match_the_library(spark, library):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(0, None, 1)], "doc_id long, text string, n_tokens int")
    got = token_counts(df, PATH, public_tokenizers.PATTERN, limit=10).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r.id] or ""
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), want, want > 10)
    assert token_counts(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_small_dictionary_and_long_texts(monkeypatch, library):
    monkeypatch.setattr(module, "KEPT_WORDS", 5)
    monkeypatch.setattr(module, "PASS_SYMBOLS", 7)
    texts = [t or "" for t in TEXTS]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert Counter(PATH, public_tokenizers.PATTERN).counts(texts) == want
    monkeypatch.setattr(module, "BATCH_CHARS", 1)
    assert Counter(PATH, public_tokenizers.PATTERN).counts(texts) == want


def test_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts(docs, PATH, public_tokenizers.PATTERN).collect():
        assert r.n_tokens == len(library.encode(texts[r.id], add_special_tokens=False).ids)
