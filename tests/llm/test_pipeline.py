import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_packing import check
from tests.llm.test_suffix_dedup import brute as suffix_brute
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents():
    rng = random.Random(11)
    rows = [prose(rng, rng.randint(60, 300)) for _ in range(40)]
    passage = prose(rng, 120)
    rows += [rows[0], rows[0].replace(" ", "  "), rows[1], rows[2] + " tail", None, "", "too short", "again and again " * 60]
    rows += [prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 80) for _ in range(3)]
    return [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None, "x") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark):
    rows = spark.createDataFrame(documents(), SCHEMA)
    out = [rows.collect()]
    columns = rows.columns
    for name, function in corpus_pipeline.STAGES:
        rows = corpus_pipeline.stage(function(spark, rows, "unused"), name)
        out.append(rows.collect())
        if name != "best_fit_packing":
            assert rows.columns == columns
            assert all(r.n_chars == len(r.text) for r in out[-1])
    return out


def test_each_stage_on_its_own_input(stages):
    raw, quality, exact, near, unrepeated, _ = stages
    ids = [sorted(r.doc_id for r in s) for s in (raw, quality, exact, near)]
    assert set(ids[0]) - set(ids[1]) == {44, 45, 46, 47}
    assert set(ids[1]) - set(ids[2]) == {0, 40, 42}  # the copy with the most characters stays, then the smallest id
    want = [d for d, _, c in near_brute([(r.doc_id, r.text) for r in exact]) if d == c]
    assert ids[3] == sorted(want) and 43 not in ids[3]
    before, after = {r.doc_id: r.text for r in near}, {r.doc_id: r.text for r in unrepeated}
    for doc, size, removed, *_ in suffix_brute([(r.doc_id, r.text, "") for r in near], 400):
        assert len(after[doc].encode()) == size - removed and (removed or after[doc] == before[doc])
    assert sum(before[d] != after[d] for d in after) == 3


def test_packing_of_what_is_left(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed, sizes = stages[-1], defaultdict(int)
    for r in packed:
        sizes[r.doc_id] += r.length
    assert dict(sizes) == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[-2]}
    check(packed, 1024)
    assert max(Counter((r.doc_id, r.piece) for r in packed).values()) == 1


def test_near_copies_on_five_words(spark):
    words = [f"v{i * i}" for i in range(51)]
    edited = words[:25] + ["other"] + words[26:]
    grams = lambda size: [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (words, edited)]
    five, four = (len(a & b) / len(a | b) for a, b in (grams(5), grams(4)))
    assert 0.8 <= five < 0.85 and four < 0.85
    rows = spark.createDataFrame([(i, " ".join(w), "en", "s", 1, "x") for i, w in enumerate((words, edited, words[:20]))], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, rows, "unused").collect()) == [0, 2]


def test_passages_of_over_50_words_below_400_bytes(spark):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") + rng.choice("klmnop") * rng.randint(0, 4) + str(i) for i in range(n)) for n in (51, 60, 50, 49)]
    assert all(len(p) < 400 for p in passages)
    long = "".join(rng.choice("abcdefgh") for _ in range(450))  # one word
    texts = [f"é {prose(rng, 70)} {p} {prose(rng, 70)}" for p in [*passages, long] for _ in range(2)]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in enumerate(texts)], SCHEMA)
    after = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, rows, "unused").collect()}
    for i, p in enumerate([*passages, long]):
        for k in (2 * i, 2 * i + 1):
            if i in (2, 3):
                assert after[k] == texts[k]
            else:
                assert "".join(after[k].split()) == "".join(texts[k].replace(p, "").split())
