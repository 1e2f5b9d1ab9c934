"""Properties of plans: results do not depend on partitioning, and no plan pairs or gathers rows."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from voxloom.catalog import Tables, roles
from voxloom.operators import evaluate, order, runlog, segment
from voxloom.operators.scan import SPARSE, dense_index, earlier_min, running_sum, value_block
from voxloom.plans import corpus
from voxloom.session import stage

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["packed_segments", "interleave_sources", "assign_shards", "summarize"])
def test_results_do_not_depend_on_partitions(spark, name):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("1", "4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = queries()[name](spark, FOLDER)
            found.append(sorted(map(tuple, rows.select(*sorted(rows.columns)).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and found[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frame_window_is_over_blocks(spark):
    t = Tables(spark, FOLDER)
    text = plan(segment.hysteresis(roles.frames(t)))
    windows = [line for line in text.splitlines() if "Window [last(_decided" in line]
    assert windows and all("[clip_id" in w and "_block" in w for w in windows)
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_reports_shuffle_only_after_partial_aggregation(spark):
    t = Tables(spark, FOLDER)
    text = plan(evaluate.histogram(roles.measures(t)))
    assert "partial_count" in text and "Cartesian" not in text and "NestedLoop" not in text
    grid = plan(evaluate.eval_grid(t.embeddings.select("vec_id"), ["a", "b"]))
    assert "Join" not in grid and "Exchange" not in grid


def test_limits_come_before_the_shuffle(spark):
    t = Tables(spark, FOLDER)
    rows = t.orders.selectExpr(
        "o_orderpriority AS run_id", "o_custkey AS step", "o_orderkey AS batch_no", "o_orderstatus AS metric", "o_totalprice AS value"
    )
    text = plan(runlog.validation_mean(rows))
    assert text.index("WindowGroupLimit") < text.rindex("Exchange") < text.rindex("WindowGroupLimit")
    top = plan(order.take_valid(t.documents.select("doc_id", "n_chars"), F.col("n_chars") > 5, ["doc_id"], 3))
    assert "TakeOrderedAndProject" in top


def test_scans_read_only_needed_columns(spark):
    t = Tables(spark, FOLDER)
    text = plan(order.assign_keys(t.documents.select("doc_id"), ["doc_id"], block=value_block("doc_id")))
    assert "ReadSchema: struct<doc_id:bigint>" in text and "text:string" not in text


def test_levelling_does_not_shuffle(spark):
    signals = spark.range(3).selectExpr("id AS clip_id", "8 AS sr", "array_repeat(float(0.5), 40) AS samples")
    assert "Exchange" not in plan(corpus.level_signals(signals, 2))


def test_batches_are_planned_without_the_payload(spark):
    loaded = spark.range(9).selectExpr(
        "id AS _row", "'s' AS shard", "string(id) AS key", "array_repeat(array_repeat(1, 16), 2) AS codes",
        "array_repeat(float(1), int(id)) AS audio", "100 AS sr", "CAST(NULL AS STRING) AS skip_reason",
    )
    text = plan(corpus.batch_samples(stage(loaded, "loaded"), 2, 1))
    windows = [line for line in text.splitlines() if "Window [" in line and "WindowGroup" not in line]
    assert windows and not any(re.search(r"\b(codes|audio)#", line) for line in windows)
    assert text.count("codes#") and "Cartesian" not in text and "NestedLoop" not in text


def test_levels_of_a_sparse_order(spark):
    rows = [(k, ((i * 7919 + 13) * 10**13 * (-1) ** i), float((i * 31) % 17)) for k in ("a", "b") for i in range(60 if k == "a" else 1)]
    df = spark.createDataFrame(rows, "k string, at bigint, v double")
    sums = running_sum(df, F.col("v"), "sum", ["k"], "at", levels=2)
    found = earlier_min(sums, F.col("v"), "least", ["k"], "at", levels=SPARSE)
    ranked = dense_index(found, ["at"], "n", within=["k"], block=value_block("at"))
    got = {(r["k"], r["at"]): (r["sum"], r["least"], r["n"]) for r in ranked.collect()}
    assert len(got) == len(rows)
    for k in ("a", "b"):
        total, least = 0.0, None
        for n, (_, at, v) in enumerate(sorted(r for r in rows if r[0] == k)):
            total += v
            assert got[k, at] == (total, least, n)
            least = v if least is None else min(least, v)
