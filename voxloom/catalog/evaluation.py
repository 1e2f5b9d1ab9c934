"""Queries of model evaluation, run logs, configuration and overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.catalog.registry import Tables, query
from voxloom.catalog.roles import LOG_SQL, LOWER, MEASURES_SQL, METRICS, measures, run_order, train_log
from voxloom.functions import arrays
from voxloom.operators import evaluate, overlay, quality, runlog
from voxloom.operators.model import map_batches
from voxloom.plans.report import evaluate_runs, evaluation_report
from voxloom.sinks import reports


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


@query(
    "eval_grid",
    """SELECT n_name AS checkpoint, CAST(n_nationkey AS BIGINT) AS ckpt_ord, vec_id, CAST(label AS BIGINT) AS label
       FROM nation CROSS JOIN embeddings""",
)
def _(t: Tables) -> DataFrame:
    samples = t.embeddings.select("vec_id", F.col("label").cast("bigint").alias("label"))
    grid = evaluate.eval_grid(samples, t.nation.select("n_name", "n_nationkey"), order="n_nationkey")
    return grid.withColumn("ckpt_ord", F.col("ckpt_ord").cast("bigint"))


@query(
    "cepstral_distance",
    """WITH f AS (SELECT vec_id // 10 AS sample_index, vec_id % 10 AS frame_idx, embedding FROM embeddings),
       d AS (SELECT sample_index, CASE WHEN frame_idx < 5 + sample_index % 5 THEN
                sqrt(list_sum(list_transform(range(2, 65),
                     lambda i: pow(CAST(embedding[i] AS DOUBLE) - CAST(embedding[65 - i] AS DOUBLE), 2)))) END AS dist FROM f)
       SELECT sample_index, round(10 * sqrt(2) / ln(10) * avg(dist), 6) AS mcd FROM d GROUP BY sample_index""",
)
def _(t: Tables) -> DataFrame:
    """Ten vectors are the frames of a sample; the reference side has fewer, so that it is the shorter one."""
    frames = t.embeddings.select(
        F.floor(F.col("vec_id") / 10).alias("sample_index"), (F.col("vec_id") % 10).alias("frame_idx"),
        F.transform("embedding", lambda v: v.cast("double")).alias("coef"),
    )
    ref = frames.where(F.col("frame_idx") < 5 + F.col("sample_index") % 5).withColumn("coef", F.reverse("coef"))
    return rounded(evaluate.cepstral_distance(frames, ref), 6, "mcd")


@query(
    "score_means",
    """WITH s AS (SELECT l_returnflag || l_linestatus AS checkpoint, l_orderkey AS sample_index,
                         CASE WHEN l_linenumber <= 4 THEN 'mpd' ELSE 'msd' END AS disc, l_linenumber AS sub,
                         avg(l_discount) FILTER (l_suppkey % 2 = 0) AS r, avg(l_discount) FILTER (l_suppkey % 2 = 1) AS f
                  FROM lineitem GROUP BY ALL)
       SELECT checkpoint, sample_index, disc, round(avg(r), 6) AS real_score, round(avg(f), 6) AS fake_score
       FROM s GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    scores = t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("checkpoint"), F.col("l_orderkey").alias("sample_index"),
        F.when(F.col("l_linenumber") <= 4, "mpd").otherwise("msd").alias("disc"), F.col("l_linenumber").alias("sub"),
        F.when(F.col("l_suppkey") % 2 == 0, "real").otherwise("fake").alias("kind"), F.col("l_discount").alias("value"),
    )
    return rounded(evaluate.score_means(scores), 6, "real_score", "fake_score")


@query(
    "loudness_gap",
    """WITH p AS (SELECT label, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)) / 64 AS a,
                         list_sum(list_transform(embedding, lambda v: pow(CAST(v AS DOUBLE) * pow(10.0, -(vec_id % 50) / 10.0), 2))) / 64 AS b
                  FROM embeddings),
       d AS (SELECT label, pow(greatest(20 * log10(sqrt(a + 1e-8)), -80) - greatest(20 * log10(sqrt(b + 1e-8)), -80), 2) AS g
             FROM p)
       SELECT CAST(label AS BIGINT) AS label, round(avg(g), 6) AS loudness_gap, count(*) AS n_pairs FROM d GROUP BY label""",
)
def _(t: Tables) -> DataFrame:
    factor = F.pow(F.lit(10.0), -(F.col("vec_id") % 50) / F.lit(10.0))
    pairs = t.embeddings.select(
        F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("pred"),
        F.transform("embedding", lambda v: v.cast("double") * factor).alias("ref"),
    )
    return rounded(evaluate.loudness_gap(pairs, by=["label"]), 6, "loudness_gap")


def level_model():
    """A stand-in for a model: the sum of a signal and its count; refuses some clips."""

    def call(rows: list) -> list:
        done = []
        for vec_id, samples in rows:
            if vec_id % 17 == 0:
                raise ValueError("silent clip")
            done.append((float(sum(float(v) for v in samples)), len(samples)))
        return done

    return call


_MODEL_SQL = """SELECT vec_id, CASE WHEN vec_id % 17 <> 0 THEN round(list_sum(list_transform(embedding,
       lambda v: CAST(v AS DOUBLE))), 6) END AS total, CASE WHEN vec_id % 17 <> 0 THEN CAST(len(embedding) AS BIGINT) END AS n,
       CASE WHEN vec_id % 17 = 0 THEN 'ValueError: silent clip' END AS error FROM embeddings"""


@query("map_batches", _MODEL_SQL)
def _(t: Tables) -> DataFrame:
    done = map_batches(t.embeddings, level_model, ["vec_id", "embedding"], "total double, n bigint", ["vec_id"], batch=32)
    return rounded(done, 6, "total")


@query(
    "safe_metrics",
    f"""WITH r AS ({_MODEL_SQL}) SELECT CAST(label AS BIGINT) AS label, count(*) AS n_samples, count(total) AS n_valid,
        round(avg(total), 6) AS mean FROM r JOIN embeddings USING (vec_id) GROUP BY label""",
)
def _(t: Tables) -> DataFrame:
    """One row per sample whether or not its metric failed, so nothing shifts."""
    done = map_batches(t.embeddings, level_model, ["vec_id", "embedding"], "total double, n bigint", ["label"], batch=32)
    by_label = done.groupBy(F.col("label").cast("bigint").alias("label"))
    return by_label.agg(
        F.count(F.lit(1)).alias("n_samples"), F.count("total").alias("n_valid"), F.round(F.avg("total"), 6).alias("mean")
    )


def run_model():
    """A stand-in for decoding and scoring: two numbers from the run's name and the signal."""

    def call(rows: list) -> list:
        done = []
        for run, vec_id, samples in rows:
            if vec_id % 17 == 0 and run.endswith("3"):
                raise ValueError("cannot decode")
            done.append((sum(float(v) for v in samples) * len(run), float("nan") if vec_id % 5 == 0 else float(len(run))))
        return done

    return call


@query(
    "evaluate_runs",
    """WITH g AS (SELECT n_name AS checkpoint, CAST(n_nationkey AS BIGINT) AS ckpt_ord, vec_id AS sample_index, embedding,
                         vec_id % 17 = 0 AND n_name LIKE '%3' AS failed FROM nation CROSS JOIN embeddings)
       SELECT checkpoint, ckpt_ord, sample_index, 'total' AS metric, CASE WHEN NOT failed THEN round(list_sum(
              list_transform(embedding, lambda v: CAST(v AS DOUBLE))) * length(checkpoint), 6) END AS value,
              CASE WHEN failed THEN 'ValueError: cannot decode' END AS error FROM g
       UNION ALL SELECT checkpoint, ckpt_ord, sample_index, 'width', CASE WHEN NOT failed AND sample_index % 5 <> 0
              THEN CAST(length(checkpoint) AS DOUBLE) END, CASE WHEN failed THEN 'ValueError: cannot decode' END FROM g""",
)
def _(t: Tables) -> DataFrame:
    samples = t.embeddings.select(F.col("vec_id").alias("sample_index"), "embedding")
    runs = t.nation.select("n_name", "n_nationkey")
    scored = evaluate_runs(
        samples, runs, run_model, ["sample_index", "embedding"], ["total", "width"], order="n_nationkey", batch=32
    )
    return rounded(scored.withColumn("ckpt_ord", F.col("ckpt_ord").cast("bigint")), 6, "value")


@query(
    "summarize",
    f"""WITH {MEASURES_SQL} SELECT checkpoint, metric, round(mean, 4) AS mean, round(std, 4) AS std,
        round(median, 4) AS median, round(p25, 4) AS p25, round(p75, 4) AS p75, n_valid FROM stats""",
)
def _(t: Tables) -> DataFrame:
    return rounded(evaluate.summarize(measures(t)), 4, "mean", "std", "median", "p25", "p75")


_WIDE = ", ".join(
    f"round(max({s}) FILTER (metric = '{m}'), 4) AS {m}_{s}"
    if s != "n_valid"
    else f"max({s}) FILTER (metric = '{m}') AS {m}_{s}"
    for m in METRICS
    for s in evaluate.STATS
)


@query("summary_wide", f"WITH {MEASURES_SQL} SELECT checkpoint, {_WIDE} FROM stats GROUP BY checkpoint")
def _(t: Tables) -> DataFrame:
    wide = evaluate.summary_wide(evaluate.summarize(measures(t)), METRICS)
    return rounded(wide, 4, *[f"{m}_{s}" for m in METRICS for s in evaluate.STATS if s != "n_valid"])


_BEST_SQL = f"""WITH {MEASURES_SQL},
    w AS (SELECT metric, checkpoint, mean, row_number() OVER (PARTITION BY metric ORDER BY
              CASE WHEN metric IN ('price', 'tax') THEN mean ELSE -mean END, checkpoint) AS r
          FROM stats WHERE mean IS NOT NULL),
    listed AS (SELECT DISTINCT metric FROM m)
    SELECT metric, checkpoint, round(mean, 4) AS mean FROM listed LEFT JOIN (SELECT * FROM w WHERE r = 1) USING (metric)"""


@query("best_run", _BEST_SQL)
def _(t: Tables) -> DataFrame:
    winners = evaluate.best_run(evaluate.summarize(measures(t)), run_order(t), METRICS, LOWER)
    return rounded(winners, 4, "mean")


_HISTOGRAM_SQL = f"""WITH {MEASURES_SQL},
    r AS (SELECT checkpoint, metric, min(value) AS lo, max(value) AS hi, count(value) AS n,
                 (max(value) - min(value)) / 30 AS w FROM m WHERE value IS NOT NULL GROUP BY checkpoint, metric),
    c AS (SELECT checkpoint, metric, CAST(least(floor((value - lo) / w), 29) AS BIGINT) AS bin, count(*) AS c
          FROM m JOIN r USING (checkpoint, metric) WHERE value IS NOT NULL GROUP BY ALL),
    g AS (SELECT *, unnest(range(30)) AS bin FROM r)
    SELECT checkpoint, metric, bin, round(lo + bin * w, 6) AS left_edge, round(lo + (bin + 1) * w, 6) AS right_edge,
           coalesce(c, 0) AS n, round(coalesce(c, 0) / (n * w), 9) AS density
    FROM g LEFT JOIN c USING (checkpoint, metric, bin)"""


@query("histogram", _HISTOGRAM_SQL)
def _(t: Tables) -> DataFrame:
    bins = rounded(rounded(evaluate.histogram(measures(t)), 6, "left_edge", "right_edge"), 9, "density")
    return bins.withColumn("bin", F.col("bin").cast("bigint"))


_BOX_SQL = f"""WITH {MEASURES_SQL},
        f AS (SELECT checkpoint, metric, min(value) FILTER (value >= p25 - 1.5 * (p75 - p25)) AS low,
                     max(value) FILTER (value <= p75 + 1.5 * (p75 - p25)) AS high,
                     count(*) FILTER (NOT (value >= p25 - 1.5 * (p75 - p25) AND value <= p75 + 1.5 * (p75 - p25))) AS n_outliers
              FROM m JOIN stats USING (checkpoint, metric) WHERE value IS NOT NULL GROUP BY ALL)
        SELECT checkpoint, metric, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75,
               round(least(low, p25), 4) AS whisker_low, round(greatest(high, p75), 4) AS whisker_high,
               n_outliers, n_valid FROM f JOIN stats USING (checkpoint, metric)"""


@query("box_stats", _BOX_SQL)
def _(t: Tables) -> DataFrame:
    return rounded(evaluate.box_stats(measures(t)), 4, "p25", "median", "p75", "whisker_low", "whisker_high")


@query(
    "density_curve",
    f"""WITH {MEASURES_SQL},
        r AS (SELECT checkpoint, metric, min(value) AS lo, (max(value) - min(value)) / 99 AS step, count(value) AS n,
                     stddev_samp(value) * pow(count(value), -0.2) AS h
              FROM m WHERE value IS NOT NULL GROUP BY checkpoint, metric),
        d AS (SELECT checkpoint, metric, value, count(*) AS c FROM m WHERE value IS NOT NULL GROUP BY ALL),
        g AS (SELECT *, unnest(range(100)) AS point FROM r)
        SELECT checkpoint, metric, point, round(any_value(lo) + point * any_value(step), 6) AS x,
               round(ln(sum(c * exp(-0.5 * pow((value - (lo + point * step)) / h, 2))) /
                     (any_value(n) * any_value(h) * sqrt(2 * pi()))), 6) AS ln_density
        FROM g JOIN d USING (checkpoint, metric) GROUP BY checkpoint, metric, point""",
)
def _(t: Tables) -> DataFrame:
    """The logarithm, as densities differ by orders of magnitude between the metrics."""
    curve = evaluate.density_curve(measures(t))
    return curve.select(
        "checkpoint", "metric", F.col("point").cast("bigint").alias("point"), F.round("x", 6).alias("x"),
        F.round(F.log("density"), 6).alias("ln_density"),
    )


def _long(name: str, rows: DataFrame, items: dict[str, str], place: str = "CAST(NULL AS BIGINT)") -> DataFrame:
    """One of the tables of the report as (part, checkpoint, metric, place, item, value)."""
    wide = rows.selectExpr("checkpoint", "metric", f"CAST({place} AS BIGINT) AS place", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in items.items()])
    return wide.unpivot(["checkpoint", "metric", "place"], list(items), "item", "value").select(F.lit(name).alias("part"), "*")


def _long_sql(name: str, sql: str, items: dict[str, str], place: str = "CAST(NULL AS BIGINT)") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS part, checkpoint, metric, {place} AS place, '{c}' AS item, CAST({e} AS DOUBLE) AS value FROM ({sql})" for c, e in items.items()
    )


_SUMMARY_ITEMS = {c: f"round({c}, 4)" for c in ("mean", "std", "median", "p25", "p75", "n_valid")}
_BOX_ITEMS = {c: f"round({c}, 4)" for c in ("p25", "median", "p75", "whisker_low", "whisker_high", "n_outliers", "n_valid")}
_BIN_ITEMS = {"left_edge": "round(left_edge, 6)", "right_edge": "round(right_edge, 6)", "n": "n", "density": "round(density, 9)"}


@query(
    "evaluation_report",
    " UNION ALL ".join([
        _long_sql("summary", f"WITH {MEASURES_SQL} SELECT * FROM stats", _SUMMARY_ITEMS), _long_sql("winner", _BEST_SQL, {"mean": "mean"}),
        _long_sql("box", _BOX_SQL, _BOX_ITEMS), _long_sql("bin", _HISTOGRAM_SQL, _BIN_ITEMS, "bin"),
    ]),
)
def _(t: Tables) -> DataFrame:
    """All four tables of a report, one below the other."""
    report = evaluation_report(measures(t), run_order(t), METRICS)
    winners = evaluate.best_run(report.summary, run_order(t), METRICS, LOWER)
    return (
        _long("summary", report.summary, _SUMMARY_ITEMS).unionByName(_long("winner", winners, {"mean": "round(mean, 4)"}))
        .unionByName(_long("box", report.boxes, _BOX_ITEMS)).unionByName(_long("bin", report.histograms, _BIN_ITEMS, "bin"))
    )


@query(
    "raw_metrics",
    f"""WITH {MEASURES_SQL} SELECT checkpoint, sample_index,
        {", ".join(f"max(value) FILTER (metric = '{x}') AS {x}" for x in METRICS)} FROM m GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return reports.raw_metrics(measures(t), METRICS)


def _text_sql(metric: str, stat: str) -> str:
    found = f"max({stat}) FILTER (metric = '{metric}')"
    if stat == "n_valid":
        return f"CASE WHEN {found} > 0 THEN CAST({found} AS VARCHAR) ELSE 'nan' END AS {metric}_{stat}"
    return f"coalesce(printf('%.6f', {found}), 'nan') AS {metric}_{stat}"


@query(
    "summary_text",
    f"""WITH {MEASURES_SQL} SELECT checkpoint, {", ".join(_text_sql(m, s) for m in METRICS for s in evaluate.STATS)}
        FROM stats GROUP BY checkpoint""",
)
def _(t: Tables) -> DataFrame:
    return reports.summary_text(evaluate.summarize(measures(t)), METRICS)


# -- run logs -----------------------------------------------------------------------------------


@query(
    "weighted_sum",
    """SELECT o_orderkey, round(1.0 * o_totalprice / 1000 + 2.0 * (o_custkey % 7) + 45.0 * (o_orderkey % 5), 6) AS loss_total
       FROM orders""",
)
def _(t: Tables) -> DataFrame:
    parts = t.orders.select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("adv"), (F.col("o_custkey") % 7).alias("fm"),
        (F.col("o_orderkey") % 5).alias("mel"), F.lit(None).cast("double").alias("rms"),
    )
    total = arrays.weighted_sum({"adv": 1.0, "fm": 2.0, "mel": 45.0, "rms": 0.0})
    return parts.select("o_orderkey", F.round(total, 6).alias("loss_total"))


@query("every_n", "SELECT o_orderkey AS step, o_totalprice AS value FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey > 0")
def _(t: Tables) -> DataFrame:
    log = t.orders.select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("value"))
    return log.where(arrays.every_n("step", 50))


@query(
    "validation_mean",
    """WITH b AS (SELECT o_orderpriority AS run_id, o_custkey % 20 AS step, o_orderkey AS batch_no, o_totalprice AS value,
                         o_orderstatus AS metric FROM orders),
       k AS (SELECT *, row_number() OVER (PARTITION BY run_id, step, metric ORDER BY batch_no) AS r FROM b)
       SELECT run_id, step, metric, round(avg(value), 4) AS value, count(*) AS n_batches FROM k WHERE r <= 20 GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderpriority").alias("run_id"), (F.col("o_custkey") % 20).alias("step"),
        F.col("o_orderkey").alias("batch_no"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("metric"),
    )
    return rounded(runlog.validation_mean(rows, max_batches=20), 4, "value")


@query(
    "cumulative_hours",
    f"""WITH {LOG_SQL} SELECT run_id, segment, step, round(sum(value) OVER (PARTITION BY run_id, segment ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 3600, 7) AS hours FROM lg""",
)
def _(t: Tables) -> DataFrame:
    hours = runlog.cumulative_hours(train_log(t))
    return rounded(hours.select("run_id", "segment", "step", "hours"), 7, "hours")


_BEST_LOG_SQL = f"""{LOG_SQL}, bl AS (SELECT *, min(value) OVER (PARTITION BY run_id, segment ORDER BY step
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM lg)"""


@query(
    "running_best",
    f"""WITH {_BEST_LOG_SQL} SELECT run_id, segment, step, value, best_before,
        best_before IS NULL OR value < best_before AS is_best FROM bl""",
)
def _(t: Tables) -> DataFrame:
    return runlog.running_best(train_log(t)).select("run_id", "segment", "step", "value", "best_before", "is_best")


_EVENTS_SQL = f"""WITH {_BEST_LOG_SQL}, ev AS (
    SELECT run_id, segment, step, epoch, 'best' AS kind, 0 AS event_ord, 'checkpoint-best' AS name FROM bl
        WHERE best_before IS NULL OR value < best_before
    UNION ALL SELECT run_id, segment, step, epoch, 'periodic', 1, 'checkpoint-step-' || step FROM lg
        WHERE step % 100 = 0 AND step > 0
    UNION ALL SELECT run_id, segment, max(step), epoch, 'epoch_end', 2, 'checkpoint-step-' || max(step) FROM lg
        GROUP BY run_id, segment, epoch
    UNION ALL SELECT run_id, segment, max(step), 2002, 'final', 3, 'checkpoint-step-' || max(step) FROM lg
        GROUP BY run_id, segment)"""


@query("checkpoint_events", _EVENTS_SQL + " SELECT * FROM ev")
def _(t: Tables) -> DataFrame:
    events = runlog.checkpoint_events(train_log(t), 100, 2002)
    return events.withColumn("event_ord", F.col("event_ord").cast("bigint"))


@query(
    "surviving_checkpoints",
    _EVENTS_SQL + """ SELECT run_id, name, segment, step, epoch, kind FROM (SELECT *, row_number() OVER (
        PARTITION BY run_id, name ORDER BY segment DESC, step DESC, event_ord DESC) AS r FROM ev) WHERE r = 1""",
)
def _(t: Tables) -> DataFrame:
    return runlog.surviving_checkpoints(runlog.checkpoint_events(train_log(t), 100, 2002))


# -- configuration and overlay --------------------------------------------------------------------


@query(
    "config_drift",
    """WITH c AS (SELECT p_partkey AS run, unnest(['shard_size', 'seed', 'duration', 'num_frozen_decoder_modules']) AS setting,
                         unnest([CAST(p_size AS VARCHAR), p_brand, p_type, CAST(p_size % 4 AS VARCHAR)]) AS v FROM part),
       d AS (SELECT run - 1 AS run, setting, v FROM c WHERE run > 0),
       j AS (SELECT run, setting, c.v AS previous, d.v AS current FROM c FULL JOIN d USING (run, setting))
       SELECT run, setting, previous, current, CASE setting WHEN 'shard_size' THEN 'error'
              WHEN 'num_frozen_decoder_modules' THEN 'state_not_restored' ELSE 'warning' END AS severity
       FROM j WHERE previous IS DISTINCT FROM current""",
)
def _(t: Tables) -> DataFrame:
    settings = F.create_map(
        F.lit("shard_size"), F.col("p_size").cast("string"), F.lit("seed"), F.col("p_brand"),
        F.lit("duration"), F.col("p_type"),
        F.lit("num_frozen_decoder_modules"), (F.col("p_size") % 4).cast("string"),
    )
    prev = t.part.select(F.col("p_partkey").alias("run"), settings.alias("config"))
    cur = prev.where("run > 0").select((F.col("run") - 1).alias("run"), "config")
    return quality.config_drift(prev, cur, ["run"])


_WEIGHTS_SQL = """
    base AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'decoder.decoder.conv.' || p_partkey
                         WHEN p_partkey % 5 = 0 THEN 'encoder.decoder.' || p_size || '.' || p_partkey
                         ELSE 'decoder.decoder.' || p_size || '.' || p_partkey END AS name,
                    CAST(p_size AS BIGINT) AS numel, p_partkey % 3 = 0 AS trainable FROM part)"""


def weights(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    name = (
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("decoder.decoder.conv."), key))
        .when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("encoder.decoder."), size, F.lit("."), key))
        .otherwise(F.concat(F.lit("decoder.decoder."), size, F.lit("."), key))
    )
    return t.part.select(
        name.alias("name"), F.col("p_size").cast("bigint").alias("numel"), (F.col("p_partkey") % 3 == 0).alias("trainable")
    )


@query(
    "overlay",
    f"""WITH {_WEIGHTS_SQL},
        delta AS (SELECT 'decoder.decoder.' || p_size || '.' || p_partkey AS name, CAST(p_size AS BIGINT) + 1000 AS numel,
                         TRUE AS trainable FROM part WHERE p_size >= 25),
        kept AS (SELECT * FROM base WHERE NOT (starts_with(name, 'decoder.decoder.')
                    AND coalesce(try_cast(split_part(name, '.', 3) AS BIGINT) >= 30, FALSE)))
        SELECT * FROM kept WHERE name NOT IN (SELECT name FROM delta) UNION ALL SELECT * FROM delta""",
)
def _(t: Tables) -> DataFrame:
    delta = t.part.where("p_size >= 25").select(
        F.concat(F.lit("decoder."), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string")).alias("name"),
        (F.col("p_size").cast("bigint") + 1000).alias("numel"), F.lit(True).alias("trainable"),
    )
    return overlay.overlay(weights(t), delta, "decoder.decoder.", 30, "decoder.")


@query(
    "inventory",
    f"""WITH {_WEIGHTS_SQL} SELECT CAST(sum(numel) AS BIGINT) AS total,
        CAST(sum(numel) FILTER (trainable) AS BIGINT) AS trainable,
        round(sum(numel) FILTER (trainable) / sum(numel) * 100, 6) AS trainable_percent FROM base""",
)
def _(t: Tables) -> DataFrame:
    return rounded(overlay.inventory(weights(t)), 6, "trainable_percent")
