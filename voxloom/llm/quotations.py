"""Quotation linking of conversations, in DataFrame operations only.

A line's level is its number of leading ``>`` marks. A passage is a run of lines of one level above 0, normalised (marks off, lower
case, single spaces) and hashed. Originals offer the hashes of their own text: all of it, its paragraphs and its lines.
A passage links to the latest earlier turn of its conversation that offers its hash. The search is a scan over (conversation,
hash) cut into blocks of turns, so neither a hot conversation nor a hot line meets in one task, and no pairs are formed.

A passage of several lines that is found nowhere as a whole may be trimmed. It links to the latest earlier turn whose own lines
hold its lines in their order, others between them: the same scan finds for each line the latest turn that offers it, and the
earliest of these is the only turn before which none can be missed. If its lines are not in order there, the search goes on before it.

A message replies to the turn of its longest linked passage of level 1. Threads are found by pointer jumping. The position
puts threads one after the other, each message after the one it replies to.

Defined cases: a null text has no lines and stays null; messages with a null conversation or turn form a conversation or turn of
their own; repeated rows each get a row and a position; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from voxloom.functions.arrays import bind
from voxloom.llm.text import growing, joined_lines, whole, words_of
from voxloom.operators.scan import dense_index, earlier_min
from voxloom.session import stage

MARKS = r"^[ \t]*>[> \t]*"
NONE = -(1 << 62)


def _normal(line: Column) -> Column:
    return F.array_join(words_of(F.lower(line)), " ")


def _lines(text: Column) -> Column:
    """Array of (level, line without its marks)."""

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        level = F.length(marks) - F.length(F.translate(marks, ">", ""))
        return F.struct(level.alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("line"))

    return F.transform(F.split(text, "\n"), parsed)


def _passages(lines: Column) -> Column:
    """Array of (level, text) of the runs of quoted lines."""
    begins = lambda x, i: (x["level"] > 0) & ~F.coalesce(F.get(lines, i - 1)["level"] == x["level"], F.lit(False))
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), begins(x, i).alias("begins"), x["level"].alias("level")))
    starts = F.transform(F.filter(numbered, lambda x: x["begins"]), lambda x: x["at"])
    ends = F.filter(numbered, lambda x: F.coalesce(F.get(lines, x["at"] - 1)["level"] != x["level"], F.lit(True)))
    ends = F.concat(F.transform(ends, lambda x: x["at"]), F.array(F.size(lines)))

    def passage(ends_: Column):
        def of(start: Column) -> Column:
            stop = F.array_min(F.filter(ends_, lambda e: e > start))
            own = F.slice(lines, start + 1, stop - start)
            kept = F.filter(F.transform(own, lambda x: _normal(x["line"])), lambda x: x != "")
            level = F.get(lines, start)["level"].alias("level")
            return F.struct(level, F.array_join(kept, " ").alias("text"), F.transform(kept, lambda x: F.xxhash64(x)).alias("lines"))

        return of

    return bind(ends, lambda e: F.filter(F.transform(starts, passage(e)), lambda p: p["text"] != ""))


def parsed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(row, conv_id, turn, role, conv, at, own, passages, offers, lines) of each message; ``own`` is its text without quotes."""
    rows = messages.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    rows = rows.withColumns({"conv": F.coalesce("conv_id", F.lit(NONE)), "at": F.coalesce("turn", F.lit(-1))})

    def of(lines: Column) -> Column:
        own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
        return F.struct(_passages(lines).alias("passages"), own.alias("own"))

    rows = rows.withColumn("of", bind(_lines(whole(F.col("text"))), of)).withColumn("own", joined_lines(F.col("of.own")))
    parts = F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.col("of.own"))
    hashes = lambda texts: F.transform(F.filter(F.transform(texts, _normal), lambda x: x != ""), lambda x: F.xxhash64(x))
    offers = F.array_distinct(hashes(parts))
    rows = rows.withColumns({"offers": offers, "lines": hashes(F.col("of.own")), "own": F.when(F.col("text").isNotNull(), F.col("own")), "passages": F.col("of.passages")})
    return rows.drop("of", "text").withColumn("row", F.monotonically_increasing_id())


def _latest(asked: DataFrame, offers: DataFrame, keep: list[str], block_rows: int) -> DataFrame:
    """``asked(conv, hash, before, *keep)`` with ``quoted``: the latest turn before ``before`` that offers the hash, or NULL.

    ``offers(conv, hash, at)``; ``keep`` holds ``ask``, which is never NULL.
    """
    wanted = stage(asked.select("conv", "hash").distinct(), "asked")
    offered = offers.join(growing(wanted), ["conv", "hash"])
    events = asked.withColumns({"order": F.col("before") * 2, "value": F.lit(None).cast("bigint")}).unionByName(
        offered.select("conv", "hash", (F.col("at") * 2 + 1).alias("order"), (-F.col("at")).alias("value")), allowMissingColumns=True
    )
    found = earlier_min(events, F.col("value"), "_quoted", ["conv", "hash"], "order", block_rows)
    return found.filter("ask IS NOT NULL").select(*keep, "conv", (-F.col("_quoted")).alias("quoted"))


def _in_order(lines: Column, own: Column) -> Column:
    """Whether ``own`` holds ``lines`` in their order, others between them."""

    def after(at: Column, line: Column) -> Column:
        found = F.array_position(F.slice(own, at + 1, F.greatest(F.size(own) - at, F.lit(0))), line).cast("int")
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)

    return F.aggregate(lines, F.lit(0), after) >= 0


def _trimmed(left: DataFrame, rows: DataFrame, block_rows: int) -> DataFrame:
    """(ask, quoted) of the passages ``left(ask, conv, at, lines)`` whose lines an earlier turn holds in order."""
    offers = rows.select("conv", "at", F.explode(F.array_distinct("lines")).alias("hash")).distinct()
    own = rows.select("conv", F.col("at").alias("quoted"), F.col("lines").alias("own")).distinct()
    pending, found = left.withColumn("before", F.col("at")), []
    while not pending.isEmpty():
        each = pending.select("ask", "conv", "before", F.explode(F.array_distinct("lines")).alias("hash"))
        latest = _latest(each, offers, ["ask"], block_rows).groupBy("ask").agg(
            F.when(F.count("quoted") == F.count("*"), F.min("quoted")).alias("quoted")
        )
        tried = pending.join(latest.filter("quoted IS NOT NULL"), "ask")
        held = F.max(_in_order(F.col("lines"), F.col("own"))).alias("held")
        checked = tried.join(growing(own), ["conv", "quoted"]).groupBy("ask", "quoted").agg(held)
        checked = stage(checked, "trimmed")
        found.append(checked.filter("held").select("ask", "quoted"))
        pending = stage(
            pending.join(checked.filter("NOT held").select("ask", "quoted"), "ask").withColumn("before", F.col("quoted")).drop("quoted"), "trimmed-left"
        )
    return reduce(DataFrame.unionByName, found) if found else left.select("ask", F.col("at").alias("quoted")).limit(0)


def links(rows: DataFrame, block_rows: int = 65536) -> DataFrame:
    """(row, conv, at, level, chars, quoted) of every passage that is found; ``quoted`` is the turn it was taken from."""
    quotes = rows.select("row", "conv", "at", F.posexplode("passages").alias("place", "p"))
    quotes = stage(quotes.select(
        F.struct("row", "place").alias("ask"), "row", "conv", "at", "p.level", F.length("p.text").alias("chars"), F.xxhash64("p.text").alias("hash"), "p.lines"
    ), "quotes")
    offers = rows.select("conv", "at", F.explode("offers").alias("hash")).distinct()
    whole_ = _latest(quotes.select("ask", "conv", "hash", F.col("at").alias("before")), offers, ["ask"], block_rows)
    whole_ = stage(whole_.filter("quoted IS NOT NULL").select("ask", "quoted"), "whole-links")
    left = quotes.filter(F.size("lines") > 1).join(whole_.select("ask"), "ask", "left_anti")
    trimmed = _trimmed(stage(left.select("ask", "conv", "at", "lines"), "unlinked"), rows, block_rows)
    return quotes.join(whole_.unionByName(trimmed), "ask").select("row", "conv", "at", "level", "chars", "quoted")


def _roots(parents: DataFrame) -> DataFrame:
    """(conv, at, root, depth) of the messages that reply to another one."""
    now = stage(parents.select("conv", "at", F.col("up").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        higher = growing(now.select("conv", F.col("at").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more")))
        step = stage(now.join(higher, ["conv", "root"], "left"), "threads")
        if step.filter("next IS NOT NULL").isEmpty():
            return now
        now = step.select("conv", "at", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def conversations(messages: DataFrame, block_rows: int = 65536, **columns: str) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, thread, depth, position, n_quotes, n_linked, text without quotes."""
    rows = stage(parsed(messages, **columns), "messages")
    found = stage(links(rows, block_rows), "quotations")
    best = F.max(F.struct("chars", "quoted")).alias("b")
    replies = stage(found.filter("level = 1").groupBy("row", "conv", "at").agg(best).select("row", "conv", "at", F.col("b.quoted").alias("up")), "replies")
    roots = stage(_roots(replies.groupBy("conv", "at").agg(F.max("up").alias("up"))), "roots")
    counts = found.groupBy("row").agg(F.count("*").alias("linked"))
    out = rows.join(growing(replies.select("row", "up")), "row", "left").join(growing(roots), ["conv", "at"], "left").join(growing(counts), "row", "left")
    out = out.select(
        "row", "conv", "conv_id", "turn", "role", F.col("up").alias("reply_to"), F.coalesce("root", "at").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "at", F.size("passages").alias("n_quotes"),
        F.coalesce("linked", F.lit(0)).cast("int").alias("n_linked"), F.col("own").alias("text"),
    )
    placed = dense_index(out, ["thread", "at", "row"], "position", within=["conv"])
    return placed.drop("row", "conv", "at")
