"""Model-evaluation reports over a long metrics table (checkpoint, ckpt_ord, sample_index, metric, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.arrays import indices, rms_db
from voxloom.operators.scan import dense_index
from voxloom.session import stage

# Fixed values of the report.
LOWER_IS_BETTER = ("multi_res_mel", "mcd")
STATS = ("mean", "std", "median", "p25", "p75", "n_valid")
QUARTILES = (0.25, 0.5, 0.75)
GROUP = ("checkpoint", "metric")


def missing_as_null(value: Column | str) -> Column:
    """NaN marks a missing metric at the source; inside the library missing is NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v), v)


def to_long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    long = wide.unpivot(list(ids), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.withColumn("value", missing_as_null("value"))


def eval_grid(samples: DataFrame, runs: Sequence[str] | DataFrame, order: str | None = None) -> DataFrame:
    """Every run (in the given order) for every sample, as (checkpoint, ckpt_ord, sample columns).

    A list is what a user types, so it travels as a literal array that each sample explodes. A run table of
    any length, in the order of ``order`` and then of the name, is numbered and joined on the numbers that each sample explodes.
    """
    if isinstance(runs, DataFrame):
        name = [c for c in runs.columns if c != order][0]
        keys = list(dict.fromkeys([order or name, name]))
        listed = dense_index(runs.select(*keys), keys, "ckpt_ord")
        numbered = stage(listed.select(F.col("ckpt_ord").cast("int"), F.col(name).alias("checkpoint")), "eval-runs")
        each = F.explode(indices(F.lit(numbered.count()))).alias("ckpt_ord")
        repeated = samples.select(each, *samples.columns)
        return repeated.join(numbered, "ckpt_ord").select("ckpt_ord", "checkpoint", *samples.columns)
    listed = F.array(*[F.lit(r) for r in runs])
    return samples.select(F.posexplode(listed).alias("ckpt_ord", "checkpoint"), *samples.columns)


def cepstral_distance(pred: DataFrame, ref: DataFrame, by: Sequence[str] = ("sample_index",)) -> DataFrame:
    """Mean distance in dB over the frames both sides have; the first coefficient is left out.

    Frames are dense, so the equi-join on (sample, frame) is truncation to the shorter side. A
    sample without a common frame gets NULL.
    """
    keys = [*by, "frame_idx"]
    both = pred.select(*keys, F.col("coef").alias("_p")).join(ref.select(*keys, F.col("coef").alias("_r")), keys, "full")
    squares = F.zip_with("_p", "_r", lambda a, b: (a - b) * (a - b))
    inner = F.slice(squares, 2, F.greatest(F.size(squares) - 1, F.lit(0)))
    distance = F.sqrt(F.aggregate(inner, F.lit(0.0), lambda acc, v: acc + v))
    scaled = F.lit(10.0) * F.sqrt(F.lit(2.0)) / F.log(F.lit(10.0)) * F.avg(distance)
    return both.groupBy(*by).agg(scaled.alias("mcd"))


GROUPS_A_TASK = 1 << 19
SALTS = 64


def score_means(
    scores: DataFrame, by: Sequence[str] = ("checkpoint", "sample_index"), groups_a_task: int = GROUPS_A_TASK
) -> DataFrame:
    """Mean per sub-discriminator, then the plain mean of those, as real and fake columns.

    A task holds its groups in memory, and adaptive execution may leave no more tasks than cores, so groups are counted first,
    approximately. Where these tasks would get more than ``groups_a_task`` each, rows are dealt to more tasks; a group of
    many rows is then dealt by value as well, as nothing is combined before that shuffle.
    """
    kinds = {"real": "real_score", "fake": "fake_score"}
    of = lambda k: F.when(F.col("kind") == k, F.col("value"))
    keys = [*by, "disc", "sub"]
    groups = scores.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    tasks, spark = -(-groups // groups_a_task), scores.sparkSession
    if tasks <= min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism):
        per_sub = scores.groupBy(*keys).agg(*[F.avg(of(k)).alias(c) for k, c in kinds.items()])
    else:
        salted = scores.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS))).repartition(tasks, *keys, "_salt")
        totals = [agg for k, c in kinds.items() for agg in (F.sum(of(k)).alias(c), F.count(of(k)).alias(f"_n_{c}"))]
        dealt = salted.groupBy(*keys, "_salt").agg(*totals).repartition(tasks, *by, "disc")
        mean = lambda c: F.sum(c) / F.nullif(F.sum(f"_n_{c}"), F.lit(0))
        per_sub = dealt.groupBy(*keys).agg(*[mean(c).alias(c) for c in kinds.values()])
    return per_sub.groupBy(*by, "disc").agg(*[F.avg(c).alias(c) for c in kinds.values()])


def floored_db(samples: Column | str) -> Column:
    return F.greatest(rms_db(samples), F.lit(-80.0))


def loudness_gap(pairs: DataFrame, pred: str = "pred", ref: str = "ref", by: Sequence[str] = ()) -> DataFrame:
    """Mean squared difference of the two levels in dB."""
    gap = F.pow(floored_db(pred) - floored_db(ref), F.lit(2.0))
    return pairs.groupBy(*by).agg(F.avg(gap).alias("loudness_gap"), F.count(gap).alias("n_pairs"))


# -- exact order statistics without a group on one task ------------------------------------------

DIRECT_ROWS = 1 << 20
BINS = 1 << 12


def value_span() -> list[Column]:
    """Number of values, and least and greatest finite value."""
    v = F.col("value")
    finite = F.when(~v.isin(float("inf"), float("-inf")), v)
    return [F.count(v).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")]


def order_statistics(
    values: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    direct_rows: int = DIRECT_ROWS,
    bins: int = BINS,
    span: DataFrame | None = None,
) -> DataFrame:
    """The value at each 0-based rank: (keys..., rank, value) for ``targets(keys..., rank)``.

    ``values(keys..., value)`` holds no NULL; ``span`` is ``value_span`` per key, if already at hand.
    A group of more than ``direct_rows`` rows is counted in equal bins of its range (combined
    map-side), and only the bins that hold a wanted rank are looked at again, until a group is
    small. Every row is counted, so the result is exact.
    """
    v = F.col("value")
    if span is None:
        span = stage(values.groupBy(*keys).agg(*value_span()), "value-span")
    spread = F.col("_hi") > F.col("_lo")
    widest = span.agg(F.max(F.when(spread, F.col("_n")))).first()[0] or 0
    if widest <= direct_rows:
        counts = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
        return _pick(counts, targets, keys, "value").select(*keys, "rank", "value")
    # Halves, so that the width of the full double range does not overflow.
    low, high = F.col("_lo") / 2, F.col("_hi") / 2
    share = F.when(spread, (v / 2 - low) / (high - low)).otherwise(F.lit(0.0))
    bin_no = (
        F.when(v == float("-inf"), F.lit(-1))
        .when(v == float("inf"), F.lit(bins))
        .otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))
        .cast("bigint")
    )
    level = f"_bin{len(keys)}"
    binned = values.join(span.drop("_n"), list(keys)).withColumn(level, bin_no).select(*keys, level, "value")
    counts = binned.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("_c"))
    inside = [*keys, level]
    picked = stage(_pick(counts, targets, keys, level).select(*inside, "rank", "_before"), "value-bins")
    wanted = stage(picked.select(*inside).distinct(), "value-bins")
    rest = stage(binned.join(wanted, inside, "left_semi"), "value-rest")  # later rounds read only this
    deeper = picked.select(*inside, (F.col("rank") - F.col("_before")).alias("rank"))
    found = order_statistics(rest, deeper.distinct(), inside, direct_rows, bins)
    renamed = found.withColumnRenamed("rank", "_deeper")
    back = picked.withColumn("_deeper", F.col("rank") - F.col("_before"))
    return back.join(renamed, [*inside, "_deeper"]).select(*keys, "rank", "value")


def _pick(counts: DataFrame, targets: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """The cell of a cumulative count that holds each rank, with the count before it."""
    upto = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_before", F.col("_upto") - F.col("_c"))
    ranks = targets.groupBy(*keys).agg(F.collect_set("rank").alias("_ranks"))
    held = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))
    return summed.join(ranks, list(keys)).withColumn("rank", F.explode(held))


def exact_quantiles(
    values: DataFrame,
    span: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float],
    direct_rows: int = DIRECT_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """(keys..., q array) with linear interpolation between ranks; ``span`` is ``value_span`` per key."""
    place = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_p")
    at = F.col("_p") * (F.col("_n") - 1)
    placed = span.where(F.col("_n") > 0).select(*keys, "_n", place).select(
        *keys, "_p", F.floor(at).cast("bigint").alias("_below"), F.ceil(at).cast("bigint").alias("_above"),
        (at - F.floor(at)).alias("_part"),
    )
    ranks = placed.select(*keys, F.explode(F.array("_below", "_above")).alias("rank")).distinct()
    found = order_statistics(values, ranks, keys, direct_rows, bins, span)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    low, high = F.element_at("_at", F.col("_below")), F.element_at("_at", F.col("_above"))
    mixed = F.when(low == high, low).otherwise(low + (high - low) * F.col("_part"))
    joined = placed.join(by_rank, list(keys)).select(*keys, F.struct("_p", mixed.alias("v")).alias("_q"))
    ordered = F.array_sort(F.collect_list("_q"))
    return joined.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("q"))


def summarize(
    metrics: DataFrame,
    by: Sequence[str] = GROUP,
    approximate: bool = False,
    direct_rows: int = DIRECT_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """mean, population std, median, p25, p75 and n_valid over the non-missing values.

    Groups without a value stay, with NULL statistics and n_valid 0. ``approximate`` trades exact
    quartiles for one pass.
    """
    base = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]
    n_valid = F.count("value").alias("n_valid")
    if approximate:
        q = F.percentile_approx("value", list(QUARTILES), 10_000)
        one_pass = metrics.groupBy(*by).agg(*base, q.alias("_q"), n_valid)
        return _with_quartiles(one_pass, by, "_q")
    moments = stage(metrics.groupBy(*by).agg(*base, n_valid, *value_span()), "moments")
    values = metrics.where(F.col("value").isNotNull()).select(*by, "value")
    quartiles = exact_quantiles(values, moments, by, QUARTILES, direct_rows, bins)
    return _with_quartiles(moments.join(quartiles, list(by), "left"), by, "q")


def _with_quartiles(df: DataFrame, by: Sequence[str], q: str) -> DataFrame:
    p25, median, p75 = (F.get(q, F.lit(i)) for i in range(3))
    return df.select(
        *by, "mean", "std", median.alias("median"), p25.alias("p25"), p75.alias("p75"), "n_valid"
    )


def summary_wide(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per checkpoint with a column ``{metric}_{stat}`` for each listed metric."""
    cell = lambda m, s: F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}")
    return summary.groupBy("checkpoint").agg(*[cell(m, s) for m in metrics for s in STATS])


def best_run(
    summary: DataFrame,
    order: DataFrame,
    metrics: Sequence[str],
    lower_better: Sequence[str] = LOWER_IS_BETTER,
) -> DataFrame:
    """The winning checkpoint of each metric; ties go to the earlier run; NULL where there is no data.

    ``order`` holds (checkpoint, ckpt_ord).
    """
    listed = summary.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    sign = F.when(F.col("metric").isin(*lower_better), F.lit(1.0)).otherwise(F.lit(-1.0))
    rank = F.struct(sign * F.col("mean"), F.col("ckpt_ord"))
    winners = (
        summary.where(F.col("mean").isNotNull())
        .join(order.select("checkpoint", "ckpt_ord"), "checkpoint")
        .groupBy("metric")
        .agg(F.min_by(F.struct("checkpoint", "mean"), rank).alias("_best"))
    )
    return listed.join(winners, "metric", "left").select(
        "metric", F.col("_best.checkpoint").alias("checkpoint"), F.col("_best.mean").alias("mean")
    )


def histogram(metrics: DataFrame, bins: int = 30, by: Sequence[str] = GROUP) -> DataFrame:
    """Equal bins over each group's own range; density sums to one over the range.

    A group with a single value is spread over one unit around it. Empty bins are kept.
    """
    values = metrics.where(F.col("value").isNotNull()).select(*by, "value")
    flat = F.col("_min") == F.col("_max")
    spans = stage(
        values.groupBy(*by)
        .agg(F.min("value").alias("_min"), F.max("value").alias("_max"), F.count("value").alias("_n"))
        .select(
            *by,
            F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
            F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
            "_n",
        )
        .withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins),
        "spans",
    )
    spot = F.least(F.floor((F.col("value") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counted = values.join(spans, list(by)).groupBy(*by, spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return grid.join(counted, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right_edge"),
        n.alias("n"),
        (n / (F.col("_n") * F.col("_w"))).alias("density"),
    )


def metric_values(metrics: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """The groups and values alone, as a table: what several statistics read, however the metrics came about."""
    return stage(metrics.select(*by, "value"), "metric-values")


def box_stats(metrics: DataFrame, by: Sequence[str] = GROUP, whisker: float = 1.5, summary: DataFrame | None = None) -> DataFrame:
    """Quartiles, whiskers at the furthest value within 1.5 ranges of the box, and outlier count.

    ``summary`` is :func:`summarize` of the same metrics, if already at hand.
    """
    summary = summarize(metrics, by) if summary is None else summary
    boxes = stage(summary.where(F.col("n_valid") > 0).select(*by, "median", "p25", "p75", "n_valid"), "boxes")
    reach = whisker * (F.col("p75") - F.col("p25"))
    v = F.col("value")
    low_side, high_side = v >= F.col("p25") - reach, v <= F.col("p75") + reach
    found = (
        metrics.where(v.isNotNull())
        .join(boxes, list(by))
        .groupBy(*by)
        .agg(
            F.min(F.when(low_side, v)).alias("_low"),
            F.max(F.when(high_side, v)).alias("_high"),
            F.count(F.when(~(low_side & high_side), 1)).alias("n_outliers"),
        )
    )
    # A whisker never ends inside the box.
    return boxes.join(found, list(by)).select(
        *by, "p25", "median", "p75",
        F.least("_low", "p25").alias("whisker_low"),
        F.greatest("_high", "p75").alias("whisker_high"),
        "n_outliers", "n_valid",
    )


TERMS = 12  # of the expansion of a kernel around the middle of its bin
BINS_PER_BANDWIDTH = 4


def _hermite(terms: int) -> list[list[float]]:
    """Coefficients of the probabilists' Hermite polynomials, by their recurrence."""
    rows = [[1.0], [0.0, 1.0]]
    for k in range(1, terms - 1):
        up, down = [0.0, *rows[k]], rows[k - 1]
        rows.append([c - (k * down[j] if j < len(down) else 0.0) for j, c in enumerate(up)])
    return rows[:terms]


def _expanded_sums(values: DataFrame, shape: DataFrame, by: Sequence[str], points: int) -> DataFrame:
    """(by..., point, _k): kernel sums from the moments of narrow bins.

    A kernel exp(-(z - t)^2 / 2) is exp(-z^2 / 2) times a power series in t whose factors are Hermite polynomials of z, so a bin stands for
    all its values by the sums of t^k. With t at most 1/8 bandwidth and ``TERMS`` terms what is cut off is below 1e-15 of a kernel's height.
    """
    bin_no = F.floor((F.col("value") - F.col("_min")) / F.col("_h") * BINS_PER_BANDWIDTH)
    middle = (F.col("_bin") + 0.5) / BINS_PER_BANDWIDTH  # in bandwidths from the least value
    placed = values.join(shape.where(F.col("_h") > 0).select(*by, "_min", "_step", "_h"), list(by)).withColumn("_bin", bin_no)
    t = (F.col("value") - F.col("_min")) / F.col("_h") - middle
    power = lambda k: reduce(lambda a, b: a * b, [F.col("_t")] * k, F.lit(1.0))
    moments = placed.withColumn("_t", t).groupBy(*by, "_bin").agg(
        *[F.sum(power(k)).alias(f"_m{k}") for k in range(TERMS)], F.first("_step").alias("_step"), F.first("_h").alias("_h")
    )
    hermite = _hermite(TERMS)
    # The factors of the powers of z, once for each bin.
    factor = lambda j: reduce(
        lambda a, b: a + b, [F.lit(hermite[k][j] / math.factorial(k)) * F.col(f"_m{k}") for k in range(j, TERMS) if hermite[k][j]]
    )
    factors = moments.select(*by, "_bin", "_step", "_h", *[factor(j).alias(f"_a{j}") for j in range(TERMS)])
    spread = factors.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = spread.withColumn("_z", F.col("point") * F.col("_step") / F.col("_h") - middle)
    horner = F.col(f"_a{TERMS - 1}")
    for j in reversed(range(TERMS - 1)):
        horner = horner * F.col("_z") + F.col(f"_a{j}")
    return z.groupBy(*by, "point").agg(F.sum(F.exp(F.lit(-0.5) * F.col("_z") * F.col("_z")) * horner).alias("_k"))


def _direct_sums(values: DataFrame, shape: DataFrame, by: Sequence[str], points: int, tile: int) -> DataFrame:
    """The same, each value at each point, ``tile`` neighbouring points at a time."""
    first_points = F.explode(F.sequence(F.lit(0), F.lit(points - 1), F.lit(tile))).alias("_first")
    tiled = values.join(shape.where(F.col("_h") > 0).select(*by, "_min", "_step", "_h"), list(by)).select(
        *by, "value", "_min", "_step", "_h", first_points
    )
    x = lambda j: F.col("_min") + (F.col("_first") + F.lit(j)) * F.col("_step")
    z = lambda j: (F.col("value") - x(j)) / F.col("_h")
    kernels = [F.sum(F.exp(F.lit(-0.5) * z(j) * z(j))).alias(f"_k{j}") for j in range(tile)]
    sums = tiled.groupBy(*by, "_first").agg(*kernels)
    return sums.select(
        *by, "_first", F.posexplode(F.array(*[f"_k{j}" for j in range(tile)])).alias("_j", "_k")
    ).select(*by, (F.col("_first") + F.col("_j")).alias("point"), "_k")


def density_curve(
    metrics: DataFrame, points: int = 100, by: Sequence[str] = GROUP, tile: int = 10, exact: bool = False
) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid from min to max.

    The density at a grid point is a sum over the values. They are counted in bins of a quarter bandwidth, with the moments of each, and
    the bins stand for them at the points: the work is that of the values plus bins times points. ``exact`` adds each value at
    each point. Either way all sums are combined map-side. A group with a single distinct value has density 1 at that value.
    """
    values = metrics.where(F.col("value").isNotNull()).select(*by, "value")
    shape = stage(
        values.groupBy(*by)
        .agg(
            F.min("value").alias("_min"), F.max("value").alias("_max"),
            F.count("value").alias("_n"), F.stddev_samp("value").alias("_std"),
        )
        .withColumn("_h", F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
        .withColumn("_step", (F.col("_max") - F.col("_min")) / max(points - 1, 1)),
        "shapes",
    )
    heights = _direct_sums(values, shape, by, points, tile) if exact else _expanded_sums(values, shape, by, points)
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    height = F.greatest("_k", F.lit(0.0)) / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    return grid.join(heights, [*by, "point"], "left").select(
        *by, "point", (F.col("_min") + F.col("point") * F.col("_step")).alias("x"),
        F.when(F.col("_h") > 0, F.coalesce(height, F.lit(0.0))).otherwise(F.lit(1.0)).alias("density"),
    )
