"""The given tables in the roles of the library's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.catalog.registry import Tables
from voxloom.operators.evaluate import to_long
from voxloom.operators.scan import dense_index, value_block
from voxloom.session import stage

CHUNK, GAP = 100, 7
MIN_VOICED = 0.064
METRICS = ("quantity", "price", "discount", "tax", "absent")
LOWER = ("price", "tax")


def pieces(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("source").alias("lane"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("clip_id"),
        F.col("n_chars").alias("len"),
    )


def timeline_sql(source: str, chunk: int, gap: int) -> str:
    """CTEs ending in placed(lane, seq, clip_id, len, s, e); ``source`` selects lane, seq, clip_id, len."""
    begin = f"t.e + CASE WHEN t.e % {chunk} <> 0 THEN {gap} ELSE 0 END"
    return f"""
    WITH RECURSIVE given AS ({source}),
    p AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY seq) AS i FROM given),
    placed(lane, seq, clip_id, len, i, s, e) AS (
        SELECT lane, seq, clip_id, len, i, CAST(0 AS BIGINT), CAST(len AS BIGINT) FROM p WHERE i = 1
        UNION ALL
        SELECT p.lane, p.seq, p.clip_id, p.len, p.i, {begin}, {begin} + p.len
        FROM placed t JOIN p ON p.lane = t.lane AND p.i = t.i + 1)"""


PIECES_SQL = "SELECT source AS lane, doc_id AS seq, doc_id AS clip_id, n_chars AS len FROM documents"


def slices_sql(chunk: int) -> str:
    return f"""
    SELECT lane, chunk, clip_id, greatest(s, chunk * {chunk}) - s AS src_from,
           least(e, (chunk + 1) * {chunk}) - s AS src_to, greatest(s, chunk * {chunk}) - chunk * {chunk} AS dst_from
    FROM (SELECT *, unnest(range(s // {chunk}, (e - 1) // {chunk} + 1)) AS chunk FROM placed WHERE len > 0)"""


def frames(t: Tables) -> DataFrame:
    """Events of a user in order as the frame scores of a clip; a written table, as a scoring job leaves."""
    indexed = dense_index(t.events, ["event_id"], "frame_idx", within=["user_id"], block=value_block("event_id"), levels=0)
    scored = indexed.select(
        F.col("user_id").alias("clip_id"), "frame_idx", F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"),
        F.col("value").alias("energy"),
    )
    return stage(scored, "frames")


def rate(clip: Column) -> Column:
    return (F.lit(16000) + F.lit(8000) * (clip % 5)).cast("int")


def clips(t: Tables) -> DataFrame:
    n = t.events.groupBy(F.col("user_id").alias("clip_id")).agg(F.count(F.lit(1)).alias("_n"))
    sr = rate(F.col("clip_id"))
    return n.select("clip_id", sr.alias("sr"), (F.col("_n") * 512 / F.lit(16000) * sr).cast("bigint").alias("len"))


FRAMES_SQL = """
    fr AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx,
                  least(value / 100, 1.0) AS prob, value AS energy FROM events),
    clips AS (SELECT user_id AS clip_id, CAST(16000 + 8000 * (user_id % 5) AS BIGINT) AS sr,
                     CAST(trunc(count(*) * 512 / 16000 * (16000 + 8000 * (user_id % 5))) AS BIGINT) AS len
              FROM events GROUP BY user_id),
    hy AS (SELECT clip_id, frame_idx, prob, coalesce(last_value(
               CASE WHEN prob >= 0.5 THEN TRUE WHEN prob <= 0.35 THEN FALSE END IGNORE NULLS)
               OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               FALSE) AS voiced FROM fr),
    isl AS (SELECT clip_id, min(frame_idx) AS f_start, max(frame_idx) AS f_end
            FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS g
                  FROM hy WHERE voiced) GROUP BY clip_id, g),
    cut AS (SELECT clip_id, sr,
                   greatest(0, CAST(trunc(f_start * 512 / 16000 * sr) AS BIGINT)) AS s,
                   least(len + 2 * (sr // 2), CAST(trunc((f_end + 1) * 512 / 16000 * sr) AS BIGINT)) AS e
            FROM isl JOIN clips USING (clip_id)),
    segs AS (SELECT clip_id, sr, s, e, TRUE AS padded FROM cut WHERE e - s >= trunc(0.064 * sr)),
    whole AS (SELECT * FROM segs UNION ALL
              SELECT clip_id, sr, 0, len, FALSE FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM segs))"""


def measures(t: Tables) -> DataFrame:
    """Line items as per-sample metrics of six runs; NaN marks a missing value, one metric has none."""
    def col(name: str, alias: str) -> Column:
        return F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col(name)).alias(alias)

    wide = t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("checkpoint"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_index"),
        col("l_quantity", "quantity"), col("l_extendedprice", "price"),
        col("l_discount", "discount"), col("l_tax", "tax"), F.lit(float("nan")).alias("absent"),
    )
    return to_long(wide, ["checkpoint", "sample_index"], METRICS)


MEASURES_SQL = """
    wide AS (SELECT l_returnflag || l_linestatus AS checkpoint, l_orderkey * 10 + l_linenumber AS sample_index,
                    l_linenumber <> 7 AS ok, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
    m AS (SELECT checkpoint, sample_index, 'quantity' AS metric, CASE WHEN ok THEN l_quantity END AS value FROM wide
          UNION ALL SELECT checkpoint, sample_index, 'price', CASE WHEN ok THEN l_extendedprice END FROM wide
          UNION ALL SELECT checkpoint, sample_index, 'discount', CASE WHEN ok THEN l_discount END FROM wide
          UNION ALL SELECT checkpoint, sample_index, 'tax', CASE WHEN ok THEN l_tax END FROM wide
          UNION ALL SELECT checkpoint, sample_index, 'absent', CAST(NULL AS DOUBLE) FROM wide),
    stats AS (SELECT checkpoint, metric, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median,
                     quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, count(value) AS n_valid
              FROM m GROUP BY checkpoint, metric)"""


def run_order(t: Tables) -> DataFrame:
    """(checkpoint, ckpt_ord): the runs in the order of their names."""
    names = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("checkpoint")).distinct()
    flag = F.when(F.col("checkpoint").startswith("A"), 0).when(F.col("checkpoint").startswith("N"), 2).otherwise(4)
    return names.withColumn("ckpt_ord", flag + F.when(F.col("checkpoint").endswith("F"), 0).otherwise(1))


def train_log(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("segment"),
        F.col("o_orderkey").alias("step"), F.year("o_orderdate").alias("epoch"), F.col("o_totalprice").alias("value"),
    )


LOG_SQL = """
    lg AS (SELECT o_orderpriority AS run_id, o_orderstatus AS segment, o_orderkey AS step,
                  year(o_orderdate) AS epoch, o_totalprice AS value FROM orders)"""


def exploded(df: DataFrame, ids: list[str], samples: str) -> DataFrame:
    """One row per array element as (ids, pos, value)."""
    return df.select(*ids, F.posexplode(samples).alias("_pos", "_value")).select(
        *ids, F.col("_pos").cast("bigint").alias("pos"), F.col("_value").cast("double").alias("value")
    )


def exploded_sql(ids: str, samples: str, source: str) -> str:
    return f"""
    SELECT {ids}, pos, CAST(x[pos + 1] AS DOUBLE) AS value
    FROM (SELECT {ids}, x, unnest(range(len(x))) AS pos FROM (SELECT {ids}, {samples} AS x FROM {source}))"""


def uniform_sql(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS UBIGINT) / 4294967296.0)"
