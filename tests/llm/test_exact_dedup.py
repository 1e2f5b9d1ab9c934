import re

import pytest
from voxloom.llm.exact_dedup import copies, deduplicate, directory

SCHEMA = "doc_id long, text string, key string"
ROWS = [
    (5, "a b c", "x"), (2, "abc", "x"), (3, "a  b c", None), (9, None, "y"), (8, "", "y"), (7, " \t\n", "z"),
    (1, "unique é", "z"), (4, "long " * 5000, "z"), (6, "long" * 5000, "z"), (None, "abc", "q"), (11, "x y", "q"),
]


def brute(rows):
    groups = {}
    for i, text, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), i is None, i))
    return {norm: (min(g)[2], len(g)) for norm, g in groups.items()}


@pytest.mark.parametrize("bits,capacity", [(64, 4096), (3, 1), (0, 4)])
def test_copies(spark, bits, capacity):
    got = copies(spark.createDataFrame(ROWS, SCHEMA), key_bits=bits, capacity=capacity).collect()
    want = brute(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]", "", next(t for i, t, _ in ROWS if i == r.id) or "")
        assert (r.keep_id, r.group_size) == want[norm]
        assert r.kept == (r.id == r.keep_id)


def test_deduplicate_keeps_columns_and_one_of_repeated_rows(spark):
    df = spark.createDataFrame(ROWS + [(5, "a b c", "x"), (3, "a  b c", None)], SCHEMA)
    kept = deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7, 11]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert copies(df).count() == 0 and deduplicate(df).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) AS key").union(spark.range(40).selectExpr("id AS key"))
    buckets = directory(keys, 64).collect()
    assert max(b.n_keys for b in buckets) <= 64 and sum(b.n_keys for b in buckets) == 3040
    assert len({b.depth for b in buckets}) > 1
    assert sum(2.0**-b.depth for b in buckets) <= 1
