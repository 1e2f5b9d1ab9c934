"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets a target in tokens (:func:`targets`). The rates r of its documents are those closest to one copy each, in relative
entropy, that meet it: the least sum of r log r - r with sum(size * r) = target and r <= ``ceiling``. The convex dual of
that has one unknown per source, and r = min(ceiling, exp(lambda * size / mean size)). It is solved for all sources at once by
Newton steps on the logarithm of the tokens, each kept inside a shrinking bracket. Rates depend on source and size only, so documents
are counted by (source, size) once, and an iteration is one aggregate over these counts, combined before the exchange.

Copies are whole. Along the sizes of a source the running total of rates is rounded, which leaves an error of about one document of
the source; it is then settled by copies of one size at a time, the size that comes nearest first, as long as that comes nearer. The copies of equal sizes are dealt evenly over
their documents, in the order of a hash of the id.

All sums are of decimals or whole numbers, so that results do not depend on the order in which tasks end.

Defined cases: a null text has size 0, and so do texts without a word; documents of size 0 are taken once, which adds nothing; a
source without any word has target 0; a null source is a source, the last one; rows that repeat an id are dealt copies one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from voxloom.llm.text import whole
from voxloom.operators.scan import dense_index, running_sum
from voxloom.session import stage

WEIGHTS = (5, 2, 1)
CEILING = 3
TOLERANCE = 1e-9  # of a target
ROUNDS = 200  # of Newton or bisection; halving a double's bracket takes fewer
SETTLING = 24  # rounds of single copies
SIZE_BLOCK = 256


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_key(source: Column) -> Column:
    """A text that is never null and sorts as the source does, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def weighted(sources: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Adds ``weight`` to the rows of ``sources(host, ...)``: the weights in turn, by the order of ``host``."""
    listed = dense_index(sources, ["host"], "_rank")
    turn = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int")
    return listed.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)).drop("_rank")


def targets(sources: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """Adds ``target`` to ``sources(host, source_size, weight, ...)``.

    All tokens are shared by weight; a share stops at ``ceiling`` times the source, and what is over is shared again.
    """
    most, weight = ceiling * F.col("source_size"), F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    unit = None
    while True:
        full = most < F.lit(unit) * weight if unit is not None else F.lit(False)
        held, rest = sources.agg(
            F.sum(F.when(full, most).otherwise(F.lit(0)).cast("decimal(38,0)")), F.sum(F.when(~full, weight).cast("decimal(38,6)"))
        ).first()
        if not rest:
            break
        found = float(total - (held or 0)) / float(rest)
        if unit is not None and found <= unit:
            break
        unit = found
    share = F.lit(unit if unit is not None else 0.0) * weight
    return sources.withColumn("target", F.least(most.cast("double"), share))


def rates(counts: DataFrame, sources: DataFrame, ceiling: float = CEILING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, tilt) of each source: the solution of its dual.

    ``counts(host, size, n)`` has the number of documents of each size, ``sources`` their ``source_size`` and ``target``. The
    tilt of a document is exp(tilt * size / mean), ``mean`` over the documents of its source that have words.
    """
    sized = counts.where("size > 0")
    shape = sized.groupBy("host").agg(F.min("size").alias("least"), F.sum("n").alias("n"))
    share = F.col("target") / F.col("source_size")
    unit = F.col("least") / F.col("mean")
    begin = sources.where("source_size > 0").join(shape, "host").withColumn("mean", F.col("source_size") / F.col("n")).select(
        "host", "mean", "target", F.lit(0.0).alias("tilt"),
        F.when(share < 1, F.log(share) / unit).otherwise(F.lit(0.0)).alias("low"),
        F.when(share < 1, F.lit(0.0)).otherwise(F.log(F.lit(float(ceiling))) / unit).alias("high"),
        (share >= ceiling).alias("full"),
    )
    begin = begin.withColumn("tilt", F.when(F.col("full"), F.col("high")).otherwise(F.col("tilt")))
    state, done = stage(begin, "mixing-state"), []
    done.append(state.where("full").select("host", "mean", "tilt"))
    open_ = state.where("NOT full")
    tokens, tilt, target = F.col("tokens"), F.col("tilt"), F.col("target")
    for _ in range(ROUNDS):
        rate = F.exp(tilt * F.col("size") / F.col("mean"))
        mass = F.col("size") * F.col("n")
        slope = F.when(rate < ceiling, mass * F.col("size") / F.col("mean") * rate).otherwise(F.lit(0.0))
        sums = sized.join(open_, "host").groupBy("host").agg(
            F.sum((mass * F.least(rate, F.lit(float(ceiling)))).cast("decimal(38,6)")).cast("double").alias("tokens"),
            F.sum(slope.cast("decimal(38,6)")).cast("double").alias("slope"),
        )
        low = F.when(tokens < target, tilt).otherwise(F.col("low"))
        high = F.when(tokens < target, F.col("high")).otherwise(tilt)
        newton = F.round(tilt + F.log(target / tokens) * tokens / F.col("slope"), 12)
        step = open_.join(sums, "host").select(
            "host", "mean", "target", "tilt", low.alias("low"), high.alias("high"), newton.alias("newton"),
            (F.abs(tokens - target) <= tolerance * target).alias("met"),
        )
        middle = (F.col("low") + F.col("high")) / 2
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        narrow = F.col("high") - F.col("low") <= 1e-13 * (F.abs("low") + F.abs("high"))
        step = stage(step.select(
            "host", "mean", "target", F.col("tilt").alias("tried"), F.when(inside, F.col("newton")).otherwise(middle).alias("tilt"),
            "low", "high", (F.col("met") | narrow).alias("met"),
        ), "mixing-state")
        done.append(step.where("met").select("host", "mean", F.col("tried").alias("tilt")))
        open_ = step.where("NOT met").drop("met", "tried")
        if open_.isEmpty():
            break
    else:
        raise ArithmeticError("the bracket of a source did not close")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return stage(found, "mixing-rates")


def whole_copies(counts: DataFrame, solved: DataFrame, sources: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """(host, size, n, copies): how many copies the documents of a size are given together."""
    tilted = F.exp(F.coalesce(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(0.0)))
    rate = F.round(F.least(tilted, F.lit(float(ceiling))), 9).cast("decimal(12,9)")
    rated = counts.join(solved, "host", "left").select("host", "size", "n", (rate * F.col("n")).cast("decimal(38,9)").alias("wanted"))
    summed = running_sum(rated, F.col("wanted"), "before", ["host"], "size", inclusive=False, block_rows=SIZE_BLOCK)
    half = F.lit(0.5).cast("decimal(2,1)")
    rounded = F.floor(F.col("before") + F.col("wanted") + half) - F.floor(F.col("before") + half)
    base = stage(summed.select("host", "size", "n", rounded.cast("bigint").alias("copies")), "mixing-copies")

    # What rounding leaves of a target is settled by single copies.
    taken = base.groupBy("host").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    left = stage(sources.select("host", "target").join(taken, "host").select("host", (F.col("target") - F.col("taken")).alias("left")), "mixing-left")
    room = F.when(F.col("left") > 0, ceiling * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    changed = base.withColumn("more", F.lit(0).cast("bigint")).select("host", "size", "more").limit(0)
    for _ in range(SETTLING):
        now = base.join(changed, ["host", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
        gap, size = F.abs("left"), F.col("size")
        many = F.least(room, F.greatest(F.floor(gap / size), F.lit(1))).cast("bigint")
        after = F.abs(gap - many * size)
        fit = now.where("size > 0").join(left, "host").where((size < 2 * gap) & (room > 0) & (after < gap))
        pick = F.struct("size", F.when(F.col("left") > 0, many).otherwise(-many).alias("more"))
        picked = fit.groupBy("host").agg(F.min_by(pick, F.struct(after, size)).alias("pick"))
        picked = stage(picked.select("host", "pick.size", "pick.more"), "mixing-picks")
        if picked.isEmpty():
            break
        changed = stage(changed.unionByName(picked).groupBy("host", "size").agg(F.sum("more").alias("more")), "mixing-changes")
        used = picked.select("host", (F.col("size") * F.col("more")).alias("used"))
        left = stage(left.join(used, "host").select("host", (F.col("left") - F.col("used")).alias("left")), "mixing-left")
    settled = base.join(changed, ["host", "size"], "left")
    return settled.select("host", "size", "n", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING,
) -> DataFrame:
    """id, source, size, source_size, target, copies, taken of every row: how often the mix takes it."""
    rows = stage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")
    ), "mixing-sizes")
    keyed = rows.withColumn("host", source_key(F.col("source"))).withColumn("turn", F.xxhash64("id"))
    placed = stage(dense_index(keyed, ["host", "size", "turn", "id"], "place"), "mixing-places")
    counts = stage(placed.groupBy("host", "size").agg(F.count("*").alias("n"), F.min("place").alias("first")), "mixing-counts")
    sums = counts.groupBy("host").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = stage(weighted(sums, weights), "mixing-weights")
    sources = stage(targets(sources, ceiling), "mixing-targets")
    solved = rates(counts.drop("first"), sources, ceiling)
    dealt = whole_copies(counts.drop("first"), solved, sources, ceiling)
    plan = stage(
        counts.select("host", "size", "first").join(dealt, ["host", "size"]).join(sources.select("host", "source_size", "target"), "host"), "mixing-plan"
    )
    dealt_upto = lambda k: F.expr(f"(({k}) * copies) div n")
    copies = dealt_upto("place - first + 1") - dealt_upto("place - first")
    return placed.join(plan, ["host", "size"]).select(
        "id", "source", "size", "source_size", "target", copies.alias("copies")
    ).withColumn("taken", F.col("size") * F.col("copies"))
