"""Pack pieces of any length into chunks of one fixed length, per lane.

A piece starts where the lane's last piece ended, after a gap unless that end is a whole number of
chunks. Whether a gap is left out depends on everything before it, so the positions are no prefix
sum. Still, one block of pieces is a function of the entry position modulo the chunk length: it
advances by a fixed amount for all entry residues but a few. Those functions compose, so a hot lane
is cut into blocks, the blocks are composed in groups of bounded size level by level, and the entry
position of every block is walked back down. Only (seq, length) metadata takes part.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.arrays import bind, zeros
from voxloom.operators.scan import BLOCK, BLOCK_ROWS, dense_index, value_block
from voxloom.session import stage

FAN = 64
SHORT = 256  # pieces of a lane that is folded inside a row
RANGE = 64  # chunks whose slices meet a signal together
GENERIC = -1  # the residue under which a block's advance for all other residues is stored
_ADVANCE = "lane string, _block bigint, residue bigint, advance bigint"
_ENTRY = "lane string, _block bigint, entry bigint"


def _advances(lengths: list[int], chunk: int, gap: int) -> dict[int, int]:
    """Advance of a block of pieces by entry residue, with a gap before each piece as the rule."""
    ends = [0]
    for n in lengths:
        ends.append(ends[-1] + n + gap)
    total = ends[-1]
    saved_after: dict[int, int] = {}  # residue of an end -> gaps left out from the nearest such end on
    special = {GENERIC: total}
    for j in range(len(lengths) - 1, -1, -1):
        saved = 1 + saved_after.get((ends[j] + gap) % chunk, 0)
        saved_after[ends[j] % chunk] = saved
        special[-ends[j] % chunk] = total - gap * saved
    return special


def _compose(first: dict[int, int], second: dict[int, int], chunk: int) -> dict[int, int]:
    step = first[GENERIC]
    both = {GENERIC: step + second[GENERIC]}
    for residue, advance in second.items():
        if residue != GENERIC:
            both[(residue - step) % chunk] = step + advance
    for residue, advance in first.items():
        if residue != GENERIC:
            both[residue] = advance + second.get((residue + advance) % chunk, second[GENERIC])
    return both


def _entries(advances: DataFrame, levels: int, chunk: int, fan: int, start: DataFrame | None) -> DataFrame:
    """Entry position of every block, from the advances of the blocks."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        at, rows = int(pdf["entry"].iloc[0]), []
        for block, found in pdf.groupby(BLOCK, sort=True):
            rows.append((pdf["lane"].iloc[0], block, at))
            residue, advance = found["residue"].to_numpy(), found["advance"].to_numpy()
            special = advance[residue == at % chunk]
            at += int(special[0] if len(special) else advance[residue == GENERIC][0])
        return pd.DataFrame(rows, columns=["lane", BLOCK, "entry"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, found in pdf.groupby(BLOCK, sort=True):
            advance = dict(zip(found["residue"].tolist(), found["advance"].tolist()))
            whole = advance if whole is None else _compose(whole, advance, chunk)
        return pd.DataFrame(
            {
                "lane": pdf["lane"].iloc[0],
                BLOCK: pdf["_parent"].iloc[0],
                "residue": list(whole),
                "advance": list(whole.values()),
            }
        )

    if levels == 0:
        begun = _with_start(advances, start)
        return begun.groupBy("lane").applyInPandas(walk, _ENTRY)
    parents = advances.withColumn("_parent", F.floor(F.col(BLOCK) / fan).cast("bigint"))
    folded = stage(parents.groupBy("lane", "_parent").applyInPandas(fold, _ADVANCE), "timeline-level")
    above = _entries(folded, levels - 1, chunk, fan, start).withColumnRenamed(BLOCK, "_parent")
    return parents.join(above, ["lane", "_parent"]).groupBy("lane", "_parent").applyInPandas(walk, _ENTRY)


def _with_start(df: DataFrame, start: DataFrame | None) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    if start is None:
        return df.withColumn("entry", zero)
    begun = df.join(start.select("lane", F.col("start").alias("entry")), "lane", "left")
    return begun.withColumn("entry", F.coalesce("entry", zero))


def _folded_lanes(blocked: DataFrame, chunk: int, gap: int, start: DataFrame | None) -> DataFrame:
    """Lanes of at most ``SHORT`` pieces, each folded in one row, without Python."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "clip_id", "len"))).alias("_pieces")
    lanes = _with_start(blocked.groupBy("lane").agg(listed), start)
    nothing = F.struct(F.col("entry").alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def place(done: Column, piece: Column) -> Column:
        begin = done["at"] + F.when(done["at"] % chunk != 0, F.lit(gap)).otherwise(F.lit(0))
        return F.struct((begin + piece["len"]).alias("at"), F.concat(done["starts"], F.array(begin)).alias("starts"))

    folded = lanes.select("lane", "_pieces", F.aggregate("_pieces", nothing, place, lambda done: done["starts"]).alias("_starts"))
    placed = F.zip_with("_pieces", "_starts", lambda p, at: F.struct(
        p["seq"].alias("seq"), p["clip_id"].alias("clip_id"), p["len"].alias("len"), at.alias("start"), (at + p["len"]).alias("end")
    ))
    return folded.select("lane", F.inline(placed))


def timeline(
    pieces: DataFrame,
    chunk: int,
    gap: int,
    start: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """Place ``pieces(lane, seq, clip_id, len)``: adds bigint ``start`` and ``end`` per lane.

    ``seq`` is an integer, unique in its lane. ``start(lane, start)`` optionally gives the position
    at which each lane goes on. A lane is cut into blocks of ``block_rows`` pieces; only lanes of
    more than one block are composed. Lanes of up to ``SHORT`` pieces are folded inside a row.
    """
    if chunk <= 0 or gap < 0:
        raise ValueError("the chunk length must be positive and the gap must not be negative")
    metadata = pieces.select(
        F.col("lane").cast("string").alias("lane"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("clip_id").cast("bigint").alias("clip_id"),
        F.col("len").cast("bigint").alias("len"),
    )
    ranked = dense_index(metadata, ["seq", "clip_id"], "_rank", within=["lane"], block=value_block("seq", block_rows))
    # Read several times below; staged, it is computed once.
    blocked = stage(ranked.withColumn(BLOCK, value_block("_rank", block_rows)).drop("_rank"), "pieces")
    sizes = blocked.groupBy("lane").agg(F.count(F.lit(1)).alias("_n"), F.max(BLOCK).alias("_top"))
    top, largest, least = sizes.agg(F.max("_top"), F.max("_n"), F.min("_n")).first()
    if (largest or 0) <= SHORT:
        return _folded_lanes(blocked, chunk, gap, start)
    folded = None
    if least <= SHORT:
        many = stage(sizes.where(F.col("_n") > SHORT).select("lane"), "large-lanes")
        folded = _folded_lanes(blocked.join(many, "lane", "left_anti"), chunk, gap, start)
        blocked = blocked.join(many, "lane", "left_semi")

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        advance = _advances(pdf.sort_values(["seq", "clip_id"])["len"].tolist(), chunk, gap)
        return pd.DataFrame(
            {
                "lane": pdf["lane"].iloc[0],
                BLOCK: pdf[BLOCK].iloc[0],
                "residue": list(advance),
                "advance": list(advance.values()),
            }
        )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["seq", "clip_id"])
        at, starts, ends = int(pdf["entry"].iloc[0]), [], []
        for n in ordered["len"].tolist():
            begin = at + (gap if at % chunk else 0)
            at = begin + n
            starts.append(begin)
            ends.append(at)
        return ordered.assign(start=starts, end=ends)[["lane", "seq", "clip_id", "len", "start", "end"]]

    entered = _with_start(blocked, start)
    if top > 0:
        levels, reach = 0, fan
        while top >= reach:
            levels, reach = levels + 1, reach * fan
        long = stage(blocked.where(F.col(BLOCK) > 0).select("lane").distinct(), "long-lanes")
        cut = blocked.join(long, "lane", "left_semi")
        advances = stage(cut.groupBy("lane", BLOCK).applyInPandas(summarize, _ADVANCE), "timeline-blocks")
        entries = _entries(advances, levels, chunk, fan, start).withColumnRenamed("entry", "_later")
        joined = entered.join(entries, ["lane", BLOCK], "left")
        entered = joined.withColumn("entry", F.coalesce("_later", "entry")).drop("_later")
    placed = entered.groupBy("lane", BLOCK).applyInPandas(
        place, "lane string, seq bigint, clip_id bigint, len bigint, start bigint, end bigint"
    )
    return placed if folded is None else placed.unionByName(folded)


def chunk_slices(placed: DataFrame, chunk: int) -> DataFrame:
    """Each piece cut at chunk borders: ``[src_from, src_to)`` of the piece goes to ``dst_from``.

    The chunks of a piece are enumerated, so overlap needs no range join.
    """
    first = F.floor(F.col("start") / chunk).cast("bigint")
    last = F.floor((F.col("end") - 1) / chunk).cast("bigint")
    spread = placed.where(F.col("len") > 0).withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("chunk") * chunk)
    stop = F.least(F.col("end"), (F.col("chunk") + 1) * chunk)
    return spread.select(
        "lane",
        "chunk",
        "clip_id",
        (begin - F.col("start")).alias("src_from"),
        (stop - F.col("start")).alias("src_to"),
        (begin - F.col("chunk") * chunk).alias("dst_from"),
    )


def flush_tail(placed: DataFrame, chunk: int) -> DataFrame:
    """The incomplete last chunk of each lane with its filled length and zero padding, if any."""
    ends = placed.groupBy("lane").agg(F.max("end").alias("_end"))
    filled = F.col("_end") % chunk
    return ends.where(filled > 0).select(
        "lane",
        F.floor(F.col("_end") / chunk).cast("bigint").alias("chunk"),
        filled.alias("filled"),
        (F.lit(chunk) - filled).alias("pad"),
    )


def silent_chunks(slices: DataFrame, chunk: int) -> DataFrame:
    """(lane, chunk, samples) of the chunks before a lane's last that no piece reaches: a gap of a chunk or more can hold one."""
    last = slices.groupBy("lane").agg(F.max("chunk").alias("_last"))
    every = last.select("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("chunk"))
    bare = every.join(slices.select("lane", "chunk").distinct(), ["lane", "chunk"], "left_anti")
    return bare.withColumn("samples", zeros(F.lit(chunk)))


def materialize_chunks(
    slices: DataFrame, signals: DataFrame, chunk: int, clip: str = "clip_id", samples: str = "samples", silent: bool = False
) -> DataFrame:
    """The samples of every chunk: exactly ``chunk`` long, zero in gaps and in the padded tail.

    The payload is joined once, here, to the slices of ``RANGE`` chunks at a time, and cut behind the join: a long
    signal is not repeated for each of its slices, and a clip that stands everywhere is still spread
    over tasks. A chunk collects at most ``chunk`` samples. ``silent`` adds the :func:`silent_chunks`.
    """
    part = F.struct("lane", "chunk", "dst_from", "src_from", "src_to").alias("_slice")
    ranges = slices.groupBy(clip, "lane", F.floor(F.col("chunk") / RANGE)).agg(F.collect_list(part).alias("_slices"))

    def piece(s: Column) -> Column:
        size = s["src_to"] - s["src_from"]
        return F.struct(
            s["lane"].alias("lane"),
            s["chunk"].alias("chunk"),
            F.struct(
                s["dst_from"].alias("dst_from"),
                (s["dst_from"] + size).alias("dst_to"),
                F.slice(samples, (s["src_from"] + 1).cast("int"), size.cast("int")).alias("part"),
            ).alias("_piece"),
        )

    joined = ranges.select(clip, "_slices").join(signals.select(clip, samples), clip)
    cut = joined.select(F.inline(F.transform("_slices", piece)))

    def fill(parts: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(parts, i - 1)["dst_to"]).otherwise(F.lit(0))
        filled = F.flatten(F.transform(parts, lambda p, i: F.concat(zeros(p["dst_from"] - before(i)), p["part"])))
        return F.concat(filled, zeros(F.lit(chunk) - F.element_at(parts, -1)["dst_to"]))

    filled = (
        cut.groupBy("lane", "chunk")
        .agg(F.array_sort(F.collect_list("_piece")).alias("_parts"))
        .select("lane", "chunk", bind(F.col("_parts"), fill).alias("samples"))
    )
    return filled.unionByName(silent_chunks(slices, chunk)) if silent else filled
