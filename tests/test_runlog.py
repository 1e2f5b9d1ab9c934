from pyspark.sql import functions as F

from voxloom.operators import overlay, quality, runlog


def log_of(spark, rows):
    return spark.createDataFrame(rows, "run_id string, segment string, step bigint, epoch int, value double")


def test_running_best_restarts_with_a_segment(spark):
    rows = [("r", "1", 1, 0, 5.0), ("r", "1", 2, 0, 5.0), ("r", "1", 3, 0, float("nan")), ("r", "1", 4, 1, 4.0),
            ("r", "2", 5, 1, 9.0), ("r", "2", 6, 1, None), ("r", "2", 7, 1, 8.0)]
    for block_rows in (1, 2, 65536):
        got = runlog.running_best(log_of(spark, rows), block_rows=block_rows).orderBy("step").collect()
        assert [r["is_best"] for r in got] == [True, False, False, True, True, False, True]


def test_checkpoints_that_survive(spark):
    rows = [("r", "1", s, s // 4, float(20 - s if s < 6 else s)) for s in range(1, 9)]
    events = runlog.checkpoint_events(log_of(spark, rows), 4, 9)
    left = {r["name"]: (r["step"], r["epoch"], r["kind"]) for r in runlog.surviving_checkpoints(events).collect()}
    assert left == {
        "checkpoint-best": (6, 1, "best"),
        "checkpoint-step-3": (3, 0, "epoch_end"),
        "checkpoint-step-4": (4, 1, "periodic"),
        "checkpoint-step-7": (7, 1, "epoch_end"),
        "checkpoint-step-8": (8, 9, "final"),
    }


def test_validation_mean_counts_only_the_first_batches(spark):
    rows = [("r", 1, i, "loss", float(i)) for i in range(60)] + [("r", 2, 0, "loss", 7.0)]
    batches = spark.createDataFrame(rows, "run_id string, step int, batch_no int, metric string, value double")
    evaluations = spark.createDataFrame([("r", s, "loss") for s in (1, 2, 3)], "run_id string, step int, metric string")
    got = runlog.validation_mean(batches, evaluations=evaluations).orderBy("step").collect()
    assert [(r["value"], r["n_batches"]) for r in got] == [(24.5, 50), (7.0, 1), (0.0, 0)]


def test_hours(spark):
    rows = [("r", "1", s, 0, 1800.0) for s in range(1, 5)]
    got = runlog.cumulative_hours(log_of(spark, rows), block_rows=2).orderBy("step").collect()
    assert [r["hours"] for r in got] == [0.5, 1.0, 1.5, 2.0]


def test_overlay(spark):
    base = spark.createDataFrame(
        [("decoder.decoder.1.w", 1), ("decoder.decoder.4.w", 2), ("decoder.decoder.x.w", 3), ("encoder.decoder.9.w", 4),
         ("decoder.decoder", 5), ("decoder.pre", 6)], "name string, v int")
    delta = spark.createDataFrame([("decoder.4.w", 20), ("pre", 60), ("decoder.9.w", 90)], "name string, v int")
    got = {r["name"]: r["v"] for r in overlay.overlay(base, delta, "decoder.decoder.", 3, "decoder.").collect()}
    assert got == {"decoder.decoder.1.w": 1, "decoder.decoder.x.w": 3, "encoder.decoder.9.w": 4, "decoder.decoder": 5,
                   "decoder.decoder.4.w": 20, "decoder.pre": 60, "decoder.decoder.9.w": 90}


def test_inventory(spark):
    weights = spark.createDataFrame([("a", 30, True), ("b", 10, False)], "name string, numel bigint, trainable boolean")
    assert tuple(overlay.inventory(weights).first()) == (40, 30, 75.0)
    assert overlay.inventory(weights.where("false")).first()["trainable_percent"] is None


def test_config_drift(spark):
    schema = "run string, config map<string,string>"
    prev = spark.createDataFrame([("r", {"shard_size": "10", "seed": "1", "duration": "3", "note": None})], schema)
    cur = spark.createDataFrame([("r", {"shard_size": "20", "seed": "1", "val_percent": "2"})], schema)
    got = {r["setting"]: (r["previous"], r["current"], r["severity"]) for r in quality.config_drift(prev, cur, ["run"]).collect()}
    assert got == {"shard_size": ("10", "20", "error"), "duration": ("3", None, "warning"), "val_percent": (None, "2", "warning")}


def test_skips(spark):
    df = spark.range(10).withColumn("split", F.lit("train")).withColumn("skip_reason", F.when(F.col("id") < 3, "short"))
    assert {tuple(r) for r in quality.skip_report(df).collect()} == {("train", "short", 3), ("train", "kept", 7)}
    seen, totals = quality.observe_skips(df)
    seen.write.format("noop").mode("overwrite").save()
    assert totals.get == {"kept": 7, "skipped": 3}


def test_pending(spark):
    files = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    done = spark.createDataFrame([("a",), ("z",)], "path string")
    assert [r[0] for r in quality.pending_inputs(files, done).collect()] == ["b"]
