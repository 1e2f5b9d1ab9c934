import pytest
from pyspark.sql import functions as F

from voxloom.functions.hashing import md5_key, uniform
from voxloom.operators import order
from voxloom.operators.scan import dense_index, earlier_min, hash_block, running_sum, value_block


@pytest.mark.parametrize("rows", [None, 7, 100000])
def test_dense_index(spark, rows):
    block = rows and value_block("id", rows)
    df = spark.range(3, 200, 3).withColumn("g", F.col("id") % 2)
    got = [r["n"] for r in dense_index(df, ["id"], "n", block=block, start=5).orderBy("id").collect()]
    assert got == list(range(5, 5 + 66))
    within = dense_index(df, ["id"], "n", within=["g"], block=block).orderBy("g", "id").collect()
    for g in (0, 1):
        numbers = [r["n"] for r in within if r["g"] == g]
        assert numbers == list(range(len(numbers)))


def test_dense_index_of_text(spark):
    df = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("k"))
    rows = dense_index(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(100))


@pytest.mark.parametrize("block_rows", [1, 4, 65536])
def test_running_sums_and_minima(spark, block_rows):
    values = [(k, i * 3, (i * 7919 + len(k) + ord(k)) % 23) for k in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(values, "k string, step bigint, v bigint")
    sums = running_sum(df, F.col("v"), "total", ["k"], "step", block_rows=block_rows)
    before = running_sum(df, F.col("v"), "total", ["k"], "step", inclusive=False, block_rows=block_rows)
    least = earlier_min(df, F.col("v"), "least", ["k"], "step", block_rows=block_rows)
    for k in ("a", "b"):
        v = [x for key, _, x in values if key == k]
        at = lambda d, c: [r[c] for r in d.where(F.col("k") == k).orderBy("step").collect()]  # noqa: B023, E731
        assert at(sums, "total") == [sum(v[: i + 1]) for i in range(40)]
        assert at(before, "total") == [sum(v[:i]) for i in range(40)]
        assert at(least, "least") == [min(v[:i]) if i else None for i in range(40)]


def test_hash_blocks_keep_the_order(spark):
    df = spark.range(500).withColumn("_draw", md5_key(1, "id"))
    block = hash_block(uniform("_draw"), 16)
    rows = dense_index(df, ["_draw"], "n", block=block).orderBy("_draw").collect()
    assert [r["n"] for r in rows] == list(range(500))


def test_keys_grow_beyond_eight_digits(spark):
    keys = order.assign_keys(spark.range(3), ["id"], 99_999_998, value_block("id")).orderBy("id").collect()
    assert [r["key"] for r in keys] == ["99999998", "99999999", "100000000"]


def test_shards_fill_up_per_split(spark):
    df = spark.range(25).withColumn("split", F.when(F.col("id") < 20, "train").otherwise("val"))
    rows = order.assign_shards(df, ["id"], 8, {"train": 2}, value_block("id", 6)).collect()
    sizes = {}
    for r in rows:
        sizes[(r["split"], r["shard"])] = sizes.get((r["split"], r["shard"]), 0) + 1
    assert sizes == {
        ("train", "shard-000002.tar"): 8, ("train", "shard-000003.tar"): 8, ("train", "shard-000004.tar"): 4,
        ("val", "shard-000000.tar"): 5,
    }


def test_split_is_stable_and_near_its_share(spark):
    one = order.split_train_val(spark.range(20000), "id", 0.1, 7)
    two = order.split_train_val(spark.range(20000).repartition(13), "id", 0.1, 7)
    assert one.join(two, ["id", "split"]).count() == 20000
    share = one.where("split = 'val'").count() / 20000
    assert abs(share - 0.1) < 4 * (0.1 * 0.9 / 20000) ** 0.5


def test_bounded_shuffle_stays_in_its_window(spark):
    moved = order.bounded_shuffle(spark.range(1000), "id", 50, 3, block_rows=64)
    gap = moved.agg(F.max(F.abs(F.col("position") - F.col("id"))), F.countDistinct("position")).first()
    assert gap[0] < 50 and gap[1] == 1000


def test_global_shuffle_is_a_permutation_that_differs_by_seed(spark):
    a = [r["position"] for r in order.global_shuffle(spark.range(300), "id", 1).orderBy("id").collect()]
    b = [r["position"] for r in order.global_shuffle(spark.range(300), "id", 2).orderBy("id").collect()]
    assert sorted(a) == sorted(b) == list(range(300)) and a != b


def test_interleave_mixes_within_waves(spark):
    df = spark.range(400).select(F.concat(F.lit("f"), F.col("id") % 5).alias("file"), F.floor(F.col("id") / 5).alias("row"))
    mixed = order.interleave_sources(df, "file", "row", seed=1, k=2, batch_rows=10)
    waves = {r["file"]: r["wave"] for r in mixed.select("file", "wave").distinct().collect()}
    assert sorted(waves.values()) == [0, 0, 1, 1, 2]
    assert mixed.count() == 400


def test_take_valid(spark):
    got = order.take_valid(spark.range(100), F.col("id") % 3 == 0, ["id"], 4).collect()
    assert [r["id"] for r in got] == [0, 3, 6, 9]
