"""Queries of corpus preparation: scalars, segmentation, loudness, assembly, order and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.catalog.registry import Tables, query
from voxloom.catalog.roles import (
    CHUNK, FRAMES_SQL, GAP, MIN_VOICED, PIECES_SQL, clips, exploded, exploded_sql, frames, pieces, slices_sql,
    timeline_sql, uniform_sql,
)
from voxloom.functions import arrays
from voxloom.operators import assemble, batches, loudness, order, quality, segment
from voxloom.operators.scan import dense_index, value_block
from voxloom.plans.segments import packed_segments, voiced_segments

# -- scalars ------------------------------------------------------------------------------------


@query(
    "nonempty_payload",
    """SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages
       WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND strlen(html) > 0""",
)
def _(t: Tables) -> DataFrame:
    payload = (
        F.when(F.col("page_id") % 7 == 0, F.lit(None))
        .when(F.col("page_id") % 11 == 0, F.lit(b""))
        .otherwise(F.col("html").cast("binary"))
    )
    rows = t.pages.select("page_id", payload.alias("payload")).where(arrays.nonempty_payload("payload"))
    return rows.select("page_id", F.length("payload").cast("bigint").alias("n_bytes"))


@query(
    "min_rate",
    """SELECT conv_id, turn, 8000 * turn AS sr, CASE WHEN 8000 * turn < 44100 THEN 'low_rate' END AS skip_reason
       FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    rated = t.conversations.select("conv_id", "turn", (F.lit(8000) * F.col("turn")).alias("sr"))
    return rated.withColumn("skip_reason", arrays.rate_skip_reason("sr"))


@query(
    "downmix",
    exploded_sql(
        "vec_id",
        "list_transform(range(1, 33), lambda i: CAST((CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 32] AS DOUBLE)) / 2 AS FLOAT))",
        "embeddings",
    ),
)
def _(t: Tables) -> DataFrame:
    channels = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return exploded(t.embeddings.select("vec_id", arrays.downmix(channels).alias("x")), ["vec_id"], "x")


@query(
    "pad_signal",
    exploded_sql(
        "vec_id",
        """list_concat(list_transform(range(4), lambda i: CAST(0 AS FLOAT)), embedding,
           list_transform(range(16 + 4), lambda i: CAST(0 AS FLOAT)))""",
        "embeddings",
    ),
)
def _(t: Tables) -> DataFrame:
    padded = arrays.pad_edges(arrays.pad_to("embedding", 80), 4)
    return exploded(t.embeddings.select("vec_id", padded.alias("x")), ["vec_id"], "x")


@query("min_codes", "SELECT doc_id, n_chars // 10 AS num_codes FROM documents WHERE n_chars // 10 >= 12")
def _(t: Tables) -> DataFrame:
    counted = t.documents.select("doc_id", F.floor(F.col("n_chars") / 10).alias("num_codes"))
    return counted.where(arrays.enough_codes("num_codes", 1.0))


@query(
    "duration_range",
    """SELECT doc_id, n_chars // 10 AS num_codes,
              CASE WHEN NOT n_chars // 10 BETWEEN 12 AND 125 THEN 'duration' END AS skip_reason FROM documents""",
)
def _(t: Tables) -> DataFrame:
    counted = t.documents.select("doc_id", F.floor(F.col("n_chars") / 10).alias("num_codes"))
    return counted.withColumn("skip_reason", arrays.duration_skip_reason("num_codes", 1.0, 10.0))


def _faded(t: Tables, steps: int) -> DataFrame:
    factor = F.pow(F.lit(10.0), -(F.col("vec_id") % steps) / F.lit(20.0))
    return t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * factor).alias("x"))


_FADED_SQL = """(SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda v:
    pow(CAST(v AS DOUBLE) * pow(10.0, -(vec_id % {steps}) / 20.0), 2))) / len(embedding)) AS rms FROM embeddings)"""


@query(
    "rms_gate_db",
    f"""SELECT vec_id, round(20 * log10(sqrt(rms * rms + 1e-8)), 6) AS db,
        20 * log10(sqrt(rms * rms + 1e-8)) >= -40 AS loud FROM {_FADED_SQL.format(steps=60)}""",
)
def _(t: Tables) -> DataFrame:
    return _faded(t, 60).select(
        "vec_id", F.round(arrays.rms_db("x"), 6).alias("db"), arrays.loud_enough_db("x", -40.0).alias("loud")
    )


@query(
    "rms_gate_amp",
    f"SELECT vec_id, round(rms, 9) AS rms, rms >= 1e-4 AS loud FROM {_FADED_SQL.format(steps=100)}",
)
def _(t: Tables) -> DataFrame:
    return _faded(t, 100).select(
        "vec_id", F.round(arrays.rms("x"), 9).alias("rms"), arrays.loud_enough_amp("x").alias("loud")
    )


@query(
    "aligned_crop",
    f"""WITH c AS (SELECT vec_id, list_concat(embedding, embedding[:64 * (label % 2)]) AS codes,
                          list_concat(embedding, list_concat(embedding, list_concat(embedding, embedding))[
                              :64 + 128 * (label % 2)]) AS audio FROM embeddings),
        d AS (SELECT *, CASE WHEN len(codes) > 75
                THEN CAST(floor({uniform_sql(11, 'vec_id')} * (len(codes) - 75)) AS BIGINT) ELSE 0 END AS start FROM c),
        e AS (SELECT vec_id, start, CASE WHEN len(codes) > 75 THEN codes[start + 1:start + 75] ELSE codes END AS codes,
                CASE WHEN len(codes) > 75 THEN audio[2 * start + 1:2 * start + 150] ELSE audio END AS audio FROM d)
        SELECT vec_id, start, len(codes) AS n_codes, len(audio) AS n_audio,
               CAST(codes[1] AS DOUBLE) AS first_code, CAST(codes[-1] AS DOUBLE) AS last_code,
               CAST(audio[1] AS DOUBLE) AS first_sample, CAST(audio[-1] AS DOUBLE) AS last_sample FROM e""",
)
def _(t: Tables) -> DataFrame:
    times = (F.lit(1) + F.col("label") % 2).cast("int")
    clip = t.embeddings.select(
        "vec_id", F.flatten(F.array_repeat("embedding", times)).alias("codes"),
        F.flatten(F.array_repeat("embedding", 2 * times)).alias("audio"), F.lit(25).alias("sr"),
    )
    cropped = clip.select("vec_id", arrays.aligned_crop("codes", "audio", "sr", 6.0, 11, "vec_id").alias("c"))
    at = lambda c, i: F.element_at(f"c.{c}", i).cast("double")
    return cropped.select(
        "vec_id", "c.start",
        F.size("c.codes").cast("bigint").alias("n_codes"), F.size("c.audio").cast("bigint").alias("n_audio"),
        at("codes", 1).alias("first_code"), at("codes", -1).alias("last_code"),
        at("audio", 1).alias("first_sample"), at("audio", -1).alias("last_sample"),
    )


@query(
    "pcm16",
    exploded_sql(
        "vec_id",
        """list_transform(embedding, lambda v: trunc(least(greatest(v * CAST(5 AS FLOAT), CAST(-1 AS FLOAT)),
           CAST(1 AS FLOAT)) * CAST(32767 AS FLOAT)))""",
        "embeddings",
    ),
)
def _(t: Tables) -> DataFrame:
    louder = F.transform("embedding", lambda v: v * F.lit(5.0).cast("float"))
    return exploded(t.embeddings.select("vec_id", arrays.pcm16(louder).alias("x")), ["vec_id"], "x")


@query(
    "align_pair",
    """SELECT vec_id, 64 AS n, round(list_sum(list_transform(range(1, 65),
                lambda i: abs(CAST(embedding[i] AS DOUBLE) - CAST(embedding[65 - i] AS DOUBLE)))), 6) AS distance
       FROM embeddings""",
)
def _(t: Tables) -> DataFrame:
    times = (F.lit(1) + F.col("label") % 3).cast("int")
    pair = t.embeddings.select(
        "vec_id", F.flatten(F.array_repeat("embedding", times)).alias("a"), F.reverse("embedding").alias("b")
    )
    a, b = arrays.align_pair("a", "b")
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)
    return pair.select("vec_id", F.size(a).alias("n"), F.round(total, 6).alias("distance"))


@query(
    "mask_tail",
    exploded_sql(
        "vec_id",
        "list_transform(range(1, 65), lambda i: CASE WHEN i <= 6 * label THEN embedding[i] ELSE 0 END)",
        "embeddings",
    ),
)
def _(t: Tables) -> DataFrame:
    masked = arrays.mask_tail("embedding", F.lit(6) * F.col("label"))
    return exploded(t.embeddings.select("vec_id", masked.alias("x")), ["vec_id"], "x")


@query(
    "pick_payload",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'wav' WHEN page_id % 3 = 0 THEN 'flac'
                            WHEN page_id % 2 = 0 THEN 'opus' END AS ext,
              CASE WHEN page_id % 5 = 0 THEN strlen(html) WHEN page_id % 3 = 0 THEN strlen(url)
                   WHEN page_id % 2 = 0 THEN strlen(html) + strlen(url) END AS n_bytes FROM pages""",
)
def _(t: Tables) -> DataFrame:
    given = lambda n, c: F.when(F.col("page_id") % n == 0, c.cast("binary"))
    members = F.create_map(
        F.lit("wav"), given(5, F.col("html")), F.lit("flac"), given(3, F.col("url")),
        F.lit("opus"), given(2, F.concat("html", "url")), F.lit("txt"), F.col("url").cast("binary"),
    )
    present = t.pages.select("page_id", F.map_filter(members, lambda k, v: v.isNotNull()).alias("members"))
    payload, ext = arrays.pick_payload("members")
    return present.select("page_id", ext.alias("ext"), F.length(payload).cast("bigint").alias("n_bytes"))


@query(
    "codes_matrix",
    """WITH c AS (SELECT vec_id, list_concat(list_transform(embedding, lambda v: CAST(trunc(CAST(v AS DOUBLE) * 1000) AS BIGINT)),
                         CASE WHEN label % 3 = 0 THEN [CAST(label AS BIGINT)] ELSE [] END) AS codes FROM embeddings),
       r AS (SELECT vec_id, codes, unnest(CASE WHEN len(codes) % 16 = 0 THEN range(len(codes) // 16)
                                               ELSE [NULL] END) AS t FROM c)
       SELECT vec_id, t, CASE WHEN t IS NULL THEN 'bad_shape' END AS skip_reason,
              CASE WHEN t IS NOT NULL THEN codes[16 * t + 1] END AS first_code,
              CASE WHEN t IS NOT NULL THEN codes[16 * t + 16] END AS last_code,
              CASE WHEN t IS NOT NULL THEN CAST(list_sum(codes[16 * t + 1:16 * t + 16]) AS BIGINT) END AS total FROM r""",
)
def _(t: Tables) -> DataFrame:
    whole = F.transform("embedding", lambda v: (v.cast("double") * 1000).cast("int"))
    extra = F.when(F.col("label") % 3 == 0, F.array(F.col("label"))).otherwise(F.array().cast("array<int>"))
    rows = t.embeddings.select("vec_id", F.concat(whole, extra).alias("codes")).select(
        "vec_id", arrays.codes_skip_reason("codes").alias("skip_reason"),
        F.posexplode_outer(arrays.codes_matrix("codes")).alias("t", "row"),
    )
    return rows.select(
        "vec_id", F.col("t").cast("bigint").alias("t"), "skip_reason",
        F.element_at("row", 1).cast("bigint").alias("first_code"),
        F.element_at("row", -1).cast("bigint").alias("last_code"),
        F.aggregate("row", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"),
    )


# -- segmentation -------------------------------------------------------------------------------


@query(
    "frame_signal",
    """WITH f AS (SELECT vec_id AS clip_id, embedding, unnest(range(7)) AS frame_idx FROM embeddings)
       SELECT clip_id, frame_idx, CASE WHEN frame_idx = 6 THEN 0 ELSE round(sqrt(list_sum(list_transform(
              embedding[10 * frame_idx + 1:10 * frame_idx + 10], lambda v: CAST(v AS DOUBLE) * v)) / 10), 6) END AS prob
       FROM f""",
)
def _(t: Tables) -> DataFrame:
    signals = t.embeddings.select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples"))
    framed = segment.frame_signal(signals, frame=10)
    return framed.select("clip_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.round("prob", 6).alias("prob"))


@query("hysteresis", f"WITH {FRAMES_SQL} SELECT clip_id, frame_idx, prob, voiced FROM hy")
def _(t: Tables) -> DataFrame:
    return segment.hysteresis(frames(t)).select("clip_id", "frame_idx", "prob", "voiced")


@query("islands", f"WITH {FRAMES_SQL} SELECT clip_id, f_start, f_end FROM isl")
def _(t: Tables) -> DataFrame:
    return segment.islands(segment.hysteresis(frames(t), keep_block=True))


@query("segments", f"WITH {FRAMES_SQL} SELECT clip_id, sr, s, e, padded FROM segs")
def _(t: Tables) -> DataFrame:
    found = segment.segments(segment.islands(segment.hysteresis(frames(t), keep_block=True)), clips(t), MIN_VOICED)
    return found.withColumn("sr", F.col("sr").cast("bigint"))


@query("segments_or_whole", f"WITH {FRAMES_SQL} SELECT clip_id, sr, s, e, padded FROM whole")
def _(t: Tables) -> DataFrame:
    found = voiced_segments(frames(t), clips(t), min_voiced=MIN_VOICED)
    return found.withColumn("sr", F.col("sr").cast("bigint"))


@query(
    "rejoin",
    f"""WITH {FRAMES_SQL} SELECT clip_id, s, e, coalesce(CAST(sum(e - s + CAST(trunc(0.1 * sr) AS BIGINT)) OVER (
        PARTITION BY clip_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS out_start
        FROM whole""",
)
def _(t: Tables) -> DataFrame:
    found = voiced_segments(frames(t), clips(t), min_voiced=MIN_VOICED)
    return segment.rejoin(found).select("clip_id", "s", "e", "out_start")


@query(
    "rejoin_payload",
    exploded_sql(
        "vec_id",
        "list_concat(p[label + 1:label + 20], [CAST(0 AS FLOAT)], p[label + 41:label + 64])",
        """(SELECT vec_id, label, list_concat(list_transform(range(8), lambda i: CAST(0 AS FLOAT)), embedding,
            list_transform(range(8), lambda i: CAST(0 AS FLOAT))) AS p FROM embeddings)""",
    ),
)
def _(t: Tables) -> DataFrame:
    signals = t.embeddings.select(F.col("vec_id").alias("clip_id"), F.lit(16).alias("sr"), F.col("embedding").alias("samples"))
    bounds = F.array(
        F.struct(F.col("label").cast("bigint").alias("s"), (F.col("label") + 20).cast("bigint").alias("e")),
        F.struct((F.col("label") + 40).cast("bigint").alias("s"), (F.col("label") + 64).cast("bigint").alias("e")),
    )
    segs = t.embeddings.select(F.col("vec_id").alias("clip_id"), F.explode(bounds).alias("b")).select(
        "clip_id", "b.s", "b.e", F.lit(True).alias("padded")
    )
    joined = segment.rejoin_payload(segs, signals)
    return exploded(joined.withColumnRenamed("clip_id", "vec_id"), ["vec_id"], "samples")


@query(
    "packed_segments",
    "WITH RECURSIVE " + FRAMES_SQL + ", seglen AS (SELECT clip_id, CAST(sum(e - s + CAST(trunc(0.1 * sr) AS BIGINT)) "
    "- max(CAST(trunc(0.1 * sr) AS BIGINT)) AS BIGINT) AS len FROM whole GROUP BY clip_id),"
    + timeline_sql(
        "SELECT 'lane' || (clip_id % 4) AS lane, clip_id AS seq, clip_id, len FROM seglen", 4800, 480
    ).replace("WITH RECURSIVE", "")
    + slices_sql(4800),
)
def flagship(t: Tables) -> DataFrame:
    lane = F.concat(F.lit("lane"), (F.col("clip_id") % 4).cast("string"))
    return packed_segments(frames(t), clips(t), lane, 4800, 480, min_voiced=MIN_VOICED)


# -- loudness -----------------------------------------------------------------------------------


@query(
    "block_energy",
    """WITH b AS (SELECT vec_id AS clip_id, embedding, unnest(range(13)) AS block_idx FROM embeddings)
       SELECT clip_id, block_idx, round(list_sum(list_transform(embedding[4 * block_idx + 1:4 * block_idx + 16],
              lambda v: CAST(v AS DOUBLE) * v)) / 16, 9) AS energy FROM b""",
)
def _(t: Tables) -> DataFrame:
    signals = t.embeddings.select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples"))
    blocks = loudness.block_energy(signals, 4)
    return blocks.select(
        "clip_id", F.col("block_idx").cast("bigint").alias("block_idx"), F.round("energy", 9).alias("energy")
    )


@query(
    "gated_loudness",
    f"""WITH {FRAMES_SQL}, g AS (SELECT clip_id, avg(energy) AS m FROM fr
            WHERE energy > 0 AND -0.691 + 10 * log10(energy) > -70 GROUP BY clip_id)
        SELECT clip_id, round(-0.691 + 10 * log10(avg(energy)), 6) AS loudness, count(*) AS n_blocks
        FROM fr JOIN g USING (clip_id)
        WHERE energy > 0 AND -0.691 + 10 * log10(energy) > -70
          AND -0.691 + 10 * log10(energy) > -0.691 + 10 * log10(m) - 10 GROUP BY clip_id""",
)
def _(t: Tables) -> DataFrame:
    found = loudness.gated_loudness(frames(t), idx="frame_idx")
    return found.select("clip_id", F.round("loudness", 6).alias("loudness"), "n_blocks")


@query(
    "normalize_gain",
    """WITH l AS (SELECT vec_id, label, embedding, CASE WHEN vec_id % 9 <> 0 THEN -0.691 + 10 * log10(list_sum(
                  list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)) / 64) END AS loudness,
                  list_max(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))) AS peak FROM embeddings),
       g AS (SELECT *, pow(10.0, (-23.0 + 4 * label - loudness) / 20.0) AS raw FROM l),
       h AS (SELECT *, CASE WHEN loudness IS NULL THEN 1.0 WHEN peak * raw >= 1 THEN pow(10.0, -1 / 20.0) / peak
                            ELSE raw END AS gain FROM g)
       SELECT vec_id, round(gain, 6) AS gain, round(CAST(CAST(peak * gain AS FLOAT) AS DOUBLE), 6) AS peak_after FROM h""",
)
def _(t: Tables) -> DataFrame:
    level = F.when(F.col("vec_id") % 9 != 0, loudness.to_loudness(arrays.mean_square("embedding")))
    levelled = t.embeddings.withColumn("loudness", level).withColumn("peak", loudness.peak("embedding"))
    # A different target per label, so that both branches of the ceiling occur.
    relative = F.col("loudness") - F.lit(4) * F.col("label")
    shifted = levelled.withColumn("gain", loudness.normalize_gain(relative, "peak"))
    # In a step of its own: inside a lambda, a name would resolve to the rounded column of the same select.
    after = shifted.withColumn("peak_after", loudness.peak(loudness.apply_gain("embedding", "gain")))
    return after.select("vec_id", F.round("gain", 6).alias("gain"), F.round("peak_after", 6).alias("peak_after"))


# -- assembly -----------------------------------------------------------------------------------

_PLACED = timeline_sql(PIECES_SQL, CHUNK, GAP)


@query("timeline", _PLACED + " SELECT lane, seq, clip_id, len, s AS \"start\", e AS \"end\" FROM placed")
def _(t: Tables) -> DataFrame:
    return assemble.timeline(pieces(t), CHUNK, GAP)


@query(
    "timeline_one_lane",
    timeline_sql("SELECT 'all' AS lane, doc_id AS seq, doc_id AS clip_id, n_chars AS len FROM documents", CHUNK, GAP)
    + " SELECT lane, seq, clip_id, len, s AS \"start\", e AS \"end\" FROM placed",
)
def _(t: Tables) -> DataFrame:
    """Everything in one lane, cut into small blocks: the path that keeps a hot lane parallel."""
    return assemble.timeline(pieces(t).withColumn("lane", F.lit("all")), CHUNK, GAP, block_rows=512, fan=8)


_HASHED = "doc_id * 1000003 % 998244353 * 1000000007"  # unique, up to 10^18, in another order


@query(
    "timeline_hashed_order",
    timeline_sql(f"SELECT 'all' AS lane, {_HASHED} AS seq, doc_id AS clip_id, n_chars AS len FROM documents", CHUNK, GAP)
    + " SELECT lane, seq, clip_id, len, s AS \"start\", e AS \"end\" FROM placed",
)
def _(t: Tables) -> DataFrame:
    """One lane in the order of widely spread ids, so that nearly every piece has a block of its own."""
    return assemble.timeline(pieces(t).withColumns({"lane": F.lit("all"), "seq": F.expr(_HASHED.replace("doc_id", "seq"))}), CHUNK, GAP)


@query("chunk_slices", _PLACED + slices_sql(CHUNK))
def _(t: Tables) -> DataFrame:
    return assemble.chunk_slices(assemble.timeline(pieces(t), CHUNK, GAP), CHUNK)


@query(
    "flush_tail",
    _PLACED + f""" SELECT lane, max(e) // {CHUNK} AS chunk, max(e) % {CHUNK} AS filled,
                          {CHUNK} - max(e) % {CHUNK} AS pad FROM placed GROUP BY lane HAVING max(e) % {CHUNK} > 0""",
)
def _(t: Tables) -> DataFrame:
    return assemble.flush_tail(assemble.timeline(pieces(t), CHUNK, GAP), CHUNK)


@query(
    "materialize_chunks",
    timeline_sql(
        """SELECT CAST(label AS VARCHAR) AS lane, vec_id AS seq, vec_id AS clip_id,
                  CAST(64 * (1 + vec_id % 3) AS BIGINT) AS len FROM embeddings""",
        100, 4,
    )
    + """, spots AS (SELECT lane, clip_id, j, s + j AS spot FROM (
             SELECT lane, clip_id, s, unnest(range(len)) AS j FROM placed)),
         filled AS (SELECT lane, spot, CAST(embedding[j % 64 + 1] AS DOUBLE) AS v
                    FROM spots JOIN embeddings ON vec_id = clip_id),
         grid AS (SELECT lane, unnest(range(100 * CAST(ceil(max(e) / 100) AS BIGINT))) AS spot FROM placed GROUP BY lane)
       SELECT lane, spot // 100 AS chunk, spot % 100 AS pos, coalesce(v, 0) AS value
       FROM grid LEFT JOIN filled USING (lane, spot)""",
)
def _(t: Tables) -> DataFrame:
    times = (F.lit(1) + F.col("vec_id") % 3).cast("int")
    signals = t.embeddings.select(
        F.col("label").cast("string").alias("lane"), F.col("vec_id").alias("seq"), F.col("vec_id").alias("clip_id"),
        (F.size("embedding") * times).cast("bigint").alias("len"),
        F.flatten(F.array_repeat("embedding", times)).alias("samples"),
    )
    placed = assemble.timeline(signals.drop("samples"), 100, 4)
    chunks = assemble.materialize_chunks(assemble.chunk_slices(placed, 100), signals, 100)
    return exploded(chunks, ["lane", "chunk"], "samples")


# -- order --------------------------------------------------------------------------------------


@query(
    "interleave_sources",
    """WITH f AS (SELECT source, (row_number() OVER (ORDER BY md5('7:' || source), source) - 1) // 3 AS wave
                  FROM (SELECT DISTINCT source FROM documents)),
       r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row FROM documents),
       b AS (SELECT doc_id, source, wave, row, row // 8 AS batch_no FROM r JOIN f USING (source))
       SELECT doc_id, wave, batch_no,
              row_number() OVER (ORDER BY wave, md5('7:' || source || ':' || batch_no), source, row) - 1 AS position
       FROM b""",
)
def _(t: Tables) -> DataFrame:
    rows = dense_index(
        t.documents.select("doc_id", "source"), ["doc_id"], "row", within=["source"], block=value_block("doc_id")
    )
    mixed = order.interleave_sources(rows, "source", "row", seed=7, k=3, batch_rows=8)
    placed = dense_index(mixed, ["wave", "batch_key", "source", "row"], "position")
    return placed.select("doc_id", "wave", "batch_no", "position")


@query(
    "global_shuffle",
    "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents",
)
def _(t: Tables) -> DataFrame:
    return order.global_shuffle(t.documents.select("doc_id"), "doc_id", 42)


@query(
    "bounded_shuffle",
    f"""SELECT doc_id, row_number() OVER (ORDER BY doc_id + CAST(floor({uniform_sql(42, 'doc_id')} * 100) AS BIGINT),
               md5('42:' || doc_id), doc_id) - 1 AS position FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return order.bounded_shuffle(t.documents.select("doc_id"), "doc_id", 100, 42)


_SPLIT_SQL = f"CASE WHEN {uniform_sql(43, 'doc_id')} < 0.1 THEN 'val' ELSE 'train' END"


@query("split_train_val", f"SELECT doc_id, {_SPLIT_SQL} AS split FROM documents")
def _(t: Tables) -> DataFrame:
    return order.split_train_val(t.documents.select("doc_id"), "doc_id", 0.1, 42)


@query(
    "assign_keys",
    """WITH k AS (SELECT doc_id, 99999500 + row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
       SELECT doc_id, n, printf('%08d', n) AS key FROM k""",
)
def _(t: Tables) -> DataFrame:
    return order.assign_keys(t.documents.select("doc_id"), ["doc_id"], 99999500, value_block("doc_id"))


@query(
    "assign_keys_hashed_order",
    f"""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASHED}) - 1 AS n FROM documents)
       SELECT doc_id, n, printf('%08d', n) AS key FROM k""",
)
def _(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", F.expr(_HASHED).alias("_spread"))
    return order.assign_keys(hashed, ["_spread"], block=value_block("_spread")).drop("_spread")


@query(
    "assign_shards",
    f"""WITH s AS (SELECT doc_id, {_SPLIT_SQL} AS split FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || doc_id), doc_id) - 1 AS n FROM s),
        i AS (SELECT doc_id, split, CASE WHEN split = 'val' THEN 3 ELSE 0 END + n // 60 AS shard_idx FROM r)
        SELECT doc_id, split, shard_idx, printf('shard-%06d.tar', shard_idx) AS shard FROM i""",
)
def _(t: Tables) -> DataFrame:
    from voxloom.functions.hashing import md5_key, uniform
    from voxloom.operators.scan import hash_block

    split = order.split_train_val(t.documents.select("doc_id"), "doc_id", 0.1, 42)
    drawn = split.withColumn("_draw", md5_key(42, "doc_id"))
    sharded = order.assign_shards(drawn, ["_draw", "doc_id"], 60, {"val": 3}, hash_block(uniform("_draw")))
    return sharded.drop("_draw")


@query(
    "skip_report",
    f"""SELECT {_SPLIT_SQL} AS split, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality'
               WHEN quality IS NULL THEN 'unlabelled' ELSE 'kept' END AS skip_reason, count(*) AS n
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    reason = (
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality")
        .when(F.col("quality").isNull(), "unlabelled")
    )
    labelled = t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("skip_reason", reason)
    return quality.skip_report(order.split_train_val(labelled, "doc_id", 0.1, 42))


@query(
    "pending_inputs",
    """SELECT DISTINCT source AS path FROM documents
       WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 15000)""",
)
def _(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("source").alias("path"))
    done = t.documents.where(F.col("n_chars") > 15000).select(F.col("source").alias("path"))
    return quality.pending_inputs(files, done)


@query(
    "take_valid",
    "SELECT source, doc_id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 5000 ORDER BY source, doc_id LIMIT 50",
)
def _(t: Tables) -> DataFrame:
    valid = F.col("n_chars").between(500, 5000)
    return order.take_valid(t.documents.select("source", "doc_id", "n_chars"), valid, ["source", "doc_id"], 50)


# -- batches ------------------------------------------------------------------------------------


@query(
    "plan_batches",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS n FROM documents)
       SELECT doc_id, n // 8 AS batch_id, n % 8 AS pos FROM r""",
)
def _(t: Tables) -> DataFrame:
    from voxloom.functions.hashing import md5_key, uniform
    from voxloom.operators.scan import hash_block

    drawn = t.documents.select("doc_id", md5_key(42, "doc_id").alias("_draw"))
    planned = batches.plan_batches(drawn, ["_draw", "doc_id"], 8, hash_block(uniform("_draw")))
    return planned.select("doc_id", "batch_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    "pad_batches",
    """WITH r AS (SELECT vec_id, vec_id // 8 AS batch_id, vec_id % 8 AS pos, 4 * (1 + label % 4) AS code_len,
                         64 * (1 + vec_id % 3) AS audio_len, embedding FROM embeddings),
       w AS (SELECT *, max(code_len) OVER (PARTITION BY batch_id) AS codes_padded,
                    max(audio_len) OVER (PARTITION BY batch_id) AS audio_padded FROM r)
       SELECT vec_id, batch_id, pos, code_len, audio_len, codes_padded, audio_padded,
              round((1 + vec_id % 3) * list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS audio_sum,
              CASE WHEN audio_len = audio_padded THEN CAST(embedding[-1] AS DOUBLE) ELSE 0 END AS last_sample,
              CASE WHEN code_len = codes_padded THEN CAST(trunc(CAST(embedding[64] AS DOUBLE) * 1000) AS BIGINT)
                   ELSE 0 END AS last_code FROM w""",
)
def _(t: Tables) -> DataFrame:
    whole = F.transform("embedding", lambda v: (v.cast("double") * 1000).cast("int"))
    repeated = lambda c, n: F.flatten(F.array_repeat(c, (F.lit(1) + n).cast("int")))
    samples = t.embeddings.select(
        "vec_id", arrays.codes_matrix(repeated(whole, F.col("label") % 4)).alias("codes"),
        repeated("embedding", F.col("vec_id") % 3).alias("audio"),
    )
    padded = batches.pad_batches(batches.plan_batches(samples, ["vec_id"], 8, value_block("vec_id")))
    big = lambda c: F.col(c).cast("bigint").alias(c)
    total = F.aggregate("audio", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return padded.select(
        "vec_id", "batch_id", big("pos"), big("code_len"), big("audio_len"),
        F.size("codes").cast("bigint").alias("codes_padded"), F.size("audio").cast("bigint").alias("audio_padded"),
        F.round(total, 6).alias("audio_sum"), F.element_at("audio", -1).cast("double").alias("last_sample"),
        F.element_at(F.element_at("codes", -1), -1).cast("bigint").alias("last_code"),
    )
