import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import evaluate
from voxloom.plans.report import evaluation_report
from voxloom.sinks import reports

NAN = float("nan")


def metrics_of(spark, runs):
    rows = [(c, i, m, float(v)) for c, by in runs.items() for m, vs in by.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "checkpoint string, sample_index bigint, metric string, value double")
    return df.withColumn("value", evaluate.missing_as_null("value"))


def runs():
    rng = np.random.default_rng(3)
    return {
        "base": {"mcd": rng.normal(5, 1, 40).tolist() + [NAN], "mos": [3.0] * 41, "gone": [NAN] * 41},
        "tuned": {"mcd": np.round(rng.normal(4, 2, 41)).tolist(), "mos": [3.0] * 41, "gone": [NAN] * 41},
        "wide": {"mcd": (10.0 ** rng.uniform(-30, 30, 41)).tolist(), "mos": [1.0, NAN] * 20 + [2.0], "gone": [NAN] * 41},
    }


@pytest.mark.parametrize("direct_rows,bins", [(1 << 20, 4096), (5, 32), (1, 64)])
def test_summary_is_exact(spark, direct_rows, bins):
    given = runs()
    rows = evaluate.summarize(metrics_of(spark, given), direct_rows=direct_rows, bins=bins).collect()
    assert len(rows) == 9
    for r in rows:
        valid = [v for v in given[r["checkpoint"]][r["metric"]] if not np.isnan(v)]
        assert r["n_valid"] == len(valid)
        if not valid:
            assert r["mean"] is None and r["median"] is None and r["std"] is None
            continue
        assert r["mean"] == pytest.approx(np.mean(valid)) and r["std"] == pytest.approx(np.std(valid))
        for name, q in (("p25", 25), ("median", 50), ("p75", 75)):
            assert r[name] == pytest.approx(np.percentile(valid, q), rel=1e-12)


def test_infinite_values_are_values(spark):
    given = {"a": {"m": [float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("inf")]}}
    for direct_rows, bins in ((100, 4), (1, 4)):
        r = evaluate.summarize(metrics_of(spark, given), direct_rows=direct_rows, bins=bins).first()
        assert r["median"] == 2.5 and r["n_valid"] == 6


def test_hot_value_in_a_hot_group(spark):
    values = [0.0] * 300 + list(range(1, 100)) + [1e300, -1e300]
    r = evaluate.summarize(metrics_of(spark, {"a": {"m": values}}), direct_rows=20, bins=8).first()
    assert (r["p25"], r["median"], r["p75"]) == tuple(np.percentile(values, [25, 50, 75]))


def test_approximate_summary_has_the_same_columns(spark):
    given = metrics_of(spark, runs())
    exact, quick = evaluate.summarize(given), evaluate.summarize(given, approximate=True)
    assert exact.columns == quick.columns and exact.count() == quick.count()


def test_winners(spark):
    given = runs()
    order = spark.createDataFrame([("base", 0), ("tuned", 1), ("wide", 2)], "checkpoint string, ckpt_ord int")
    best = evaluate.best_run(evaluate.summarize(metrics_of(spark, given)), order, ["mcd", "mos", "gone", "unknown"])
    got = {r["metric"]: r["checkpoint"] for r in best.collect()}
    means = {c: np.mean([v for v in by["mcd"] if not np.isnan(v)]) for c, by in given.items()}
    # The tie in mos goes to the first run.
    assert got == {"mcd": min(means, key=means.get), "mos": "base", "gone": None, "unknown": None}


def test_histogram_matches_numpy(spark):
    values = [0.0, 1.0, 1.0, 2.5, 3.0]
    got = evaluate.histogram(metrics_of(spark, {"a": {"m": [*values, NAN], "flat": [2.0, 2.0]}}), bins=6)
    for metric, vals in (("m", values), ("flat", [2.0, 2.0])):
        rows = got.where(F.col("metric") == metric).orderBy("bin").collect()
        counts, edges = np.histogram(vals, bins=6)
        assert [r["n"] for r in rows] == counts.tolist()
        assert [r["left_edge"] for r in rows] == pytest.approx(edges[:-1])
        assert sum(r["density"] * (r["right_edge"] - r["left_edge"]) for r in rows) == pytest.approx(1)


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, -50.0]
    r = evaluate.box_stats(metrics_of(spark, {"a": {"m": values}})).first()
    q1, q3 = np.percentile(values, [25, 75])
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (r["whisker_low"], r["whisker_high"]) == (min(inside), max(inside))
    assert r["n_outliers"] == len(values) - len(inside)


@pytest.mark.parametrize("points", [1, 7, 25])
def test_density(spark, points):
    values = [0.0, 1.0, 1.5, 4.0]
    got = evaluate.density_curve(metrics_of(spark, {"a": {"m": values, "flat": [3.0, 3.0]}}), points=points)
    rows = got.where("metric = 'm'").orderBy("point").collect()
    h = np.std(values, ddof=1) * len(values) ** -0.2
    grid = np.linspace(0, 4, points)
    want = [np.mean(np.exp(-0.5 * ((x - np.array(values)) / h) ** 2)) / (h * np.sqrt(2 * np.pi)) for x in grid]
    assert [r["x"] for r in rows] == pytest.approx(grid) and [r["density"] for r in rows] == pytest.approx(want)
    flat = got.where("metric = 'flat'").collect()
    assert len(flat) == points and all(r["density"] == 1.0 and r["x"] == 3.0 for r in flat)


@pytest.mark.parametrize("seed", [1, 2])
def test_density_from_bins_is_that_of_the_values(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(5, 2, 900), rng.exponential(4, 300), [40.0, 41.5]]).tolist()
    given = metrics_of(spark, {"a": {"m": values, "two": [1.0, 2.0] * 9}})
    quick = {(r["metric"], r["point"]): r["density"] for r in evaluate.density_curve(given, 60).collect()}
    exact = {(r["metric"], r["point"]): r["density"] for r in evaluate.density_curve(given, 60, exact=True).collect()}
    top = max(exact.values())
    assert quick.keys() == exact.keys() and max(abs(quick[k] - exact[k]) for k in exact) < 1e-13 * top * len(values)
    assert all(quick[k] == pytest.approx(v, rel=1e-8) for k, v in exact.items() if v > 1e-12 * top)


def test_cepstral_distance(spark):
    frame = lambda s, i, *c: (s, i, list(map(float, c)))
    schema = "sample_index bigint, frame_idx int, coef array<double>"
    pred = spark.createDataFrame([frame(1, 0, 9, 1, 2), frame(1, 1, 0, 0, 0), frame(2, 0, 1, 1, 1)], schema)
    ref = spark.createDataFrame([frame(1, 0, 0, 4, 6), frame(3, 0, 1, 1, 1)], schema)
    got = {r["sample_index"]: r["mcd"] for r in evaluate.cepstral_distance(pred, ref).collect()}
    assert got == {1: pytest.approx(10 * np.sqrt(2) / np.log(10) * 5), 2: None, 3: None}


def test_score_means_weighs_subs_equally(spark):
    rows = [("c", 1, "mpd", 1, "real", 1.0)] * 9 + [("c", 1, "mpd", 2, "real", 0.0), ("c", 1, "mpd", 2, "fake", 0.5)]
    scores = spark.createDataFrame(rows, "checkpoint string, sample_index bigint, disc string, sub int, kind string, value double")
    r = evaluate.score_means(scores).first()
    assert (r["real_score"], r["fake_score"]) == (0.5, 0.5)


def test_loudness_gap(spark):
    pairs = spark.createDataFrame([([1.0, 1.0], [0.0, 0.0]), ([0.5], [0.5])], "pred array<float>, ref array<float>")
    r = evaluate.loudness_gap(pairs).first()
    assert r["loudness_gap"] == pytest.approx(80.0**2 / 2, rel=1e-6) and r["n_pairs"] == 2


def test_grid_keeps_run_order(spark):
    grid = evaluate.eval_grid(spark.range(3), ["b", "a"]).collect()
    assert len(grid) == 6 and {(r["ckpt_ord"], r["checkpoint"]) for r in grid} == {(0, "b"), (1, "a")}
    table = spark.range(12_000).select(F.col("id").cast("string").alias("run"), (-F.col("id")).alias("place"))
    grid = evaluate.eval_grid(spark.range(3), table, "place")
    assert grid.count() == 36_000 and grid.where("ckpt_ord + int(checkpoint) != 11999").count() == 0
    assert grid.columns == ["ckpt_ord", "checkpoint", "id"]


def test_report_files(spark, folder):
    given = runs()
    order = spark.createDataFrame([("base", 0), ("tuned", 1), ("wide", 2)], "checkpoint string, ckpt_ord int")
    report = evaluation_report(metrics_of(spark, given), order, ["mcd", "mos", "gone"], folder)
    assert report.histograms.count() == 30 * 6 and report.boxes.count() == 6
    summary = spark.read.option("header", True).csv(f"{folder}/summary_table").orderBy("checkpoint").collect()
    valid = [v for v in given["base"]["mcd"] if not np.isnan(v)]
    assert summary[0]["mcd_mean"] == f"{np.mean(valid):.6f}" and summary[0]["mcd_n_valid"] == "40"
    assert summary[0]["gone_mean"] == "nan" and summary[0]["gone_n_valid"] == "nan"
    raw = spark.read.option("header", True).csv(f"{folder}/raw_metrics")
    assert raw.count() == 3 * 41 and raw.where("checkpoint = 'base' and sample_index = 40").first()["mcd"] == "nan"


def test_raw_metrics_has_one_row_per_sample(spark):
    assert reports.raw_metrics(metrics_of(spark, runs()), ["mcd"]).count() == 3 * 41
    failed = spark.createDataFrame([("a", 0, 1, "mcd", None, "E: no"), ("a", 0, 2, "mcd", 1.0, None)], "checkpoint string, ckpt_ord int, sample_index bigint, metric string, value double, error string")
    assert {(r["sample_index"], r["mcd"], r["error"]) for r in reports.raw_metrics(failed, ["mcd"]).collect()} == {(1, None, "E: no"), (2, 1.0, None)}


def test_score_means_of_many_groups(spark):
    """More groups than the session's tasks should hold, and one group of a third of the rows."""
    rows = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 'c', concat('c', id % 2)) AS checkpoint", "IF(id % 3 = 0, -1, id % 400) AS sample_index", "IF(id % 2 = 0 OR id % 3 = 0, 'mpd', 'msd') AS disc",
        "IF(id % 3 = 0, 0, id % 5) AS sub", "IF(id % 7 < 3 AND id % 400 < 300, 'real', 'fake') AS kind", "double(id % 11) AS value",
    )
    few, many = evaluate.score_means(rows), evaluate.score_means(rows, groups_a_task=20)
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    assert plain(many) == plain(few) and any(r["real_score"] is None for r in many.collect())
    tasks = many.rdd.mapPartitions(lambda part: [len(list(part))]).collect()
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions")) and max(tasks) < 60
