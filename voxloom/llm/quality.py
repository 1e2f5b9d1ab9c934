"""Quality rules with the frequency of lines across documents, in DataFrame operations only.

One pass over the texts keeps what the rules need: counts, and one (digest, number of words) per line that has a word.
Lines are normalised (lower case, single spaces) and hashed by md5. For each host (the ``source`` column) the distinct
documents of a line are counted; documents are told apart by a digest of all their lines in order, so that only true copies
count once. A line in more than ``max(least, share * distinct documents of the host)`` documents is removed. A document of which less than ``left`` of its words remain is depleted and rejected.

Nothing is grouped by document over exploded words: repeated windows are found inside the row by sorting 64-bit hashes of
its three-word windows. A hot host or line is counted map-side before the exchange.

Defined cases: a null text has no words and fails the base rules; a null source is a host of its own; rows that
repeat an id and text get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from voxloom.functions.arrays import bind, indices
from voxloom.llm.text import any_columns, growing, joined_lines, same, whole, without_white, words_of
from voxloom.session import discard, scratch, stage

SYMBOLS = "#*$%&|<>"  # fixed value


@dataclass(frozen=True)
class LineLimits:
    least: int = 10  # a line in at most so many documents of a host stays
    share: float = 0.05  # and so does one in at most this share of them
    left: float = 0.5  # of the words of a document must remain


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array."""

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twice = lambda x, j: same(F.get(s, j - 1)["h"], x["h"]) | same(F.get(s, j + 1)["h"], x["h"])
            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def total(starts: Column) -> Column:
            own = F.transform(starts, lambda p, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), p - F.get(starts, j - 1))))
            return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)

        found = bind(bind(pairs, marked), total)
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(found)

    def of(w: Column) -> Column:
        grams = F.transform(indices(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(bind(grams, covered))

    return bind(words, of)


def line_digest(line: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words_of(F.lower(line)), " ")))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: without_white(x) != "")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, text_key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines) of each row."""
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    lines = bind(lines_with_words(F.col("text")), lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
        F.transform(x, lambda y: F.struct(line_digest(y).alias("line"), F.size(words_of(y)).alias("words"))).alias("lines"),
    ))
    counts = bind(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("words"), repeated_words(w).alias("repeated")
    ))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    return rows.select(
        "id", F.xxhash64("text").alias("text_key"), "host", F.length(without_white(F.col("text"))).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"), counts.alias("counts"), lines.alias("found"),
    ).select(
        "id", "text_key", "host", F.col("counts.words").alias("n_words"), "word_chars", "n_symbols",
        F.col("found.dup").alias("n_dup_lines"), F.col("counts.repeated").alias("n_repeat_words"), F.col("found.lines").alias("lines"),
    )


def frequent_lines(measured: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line, n_docs) of the lines above the limit of their host."""
    document = F.md5(F.array_join(F.transform("lines", lambda x: F.hex(x["line"])), ""))
    own = F.array_distinct(F.transform("lines", lambda x: x["line"]))
    once = stage(measured.select("host", document.alias("document"), own.alias("own")).dropDuplicates(["host", "document"]), "distinct-documents")
    counted = once.select("host", F.explode("own").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    hosts = once.groupBy("host").agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "_host")
    likely = counted.filter(F.col("n_docs") > limits.least)
    over = F.col("n_docs") > F.greatest(F.lit(float(limits.least)), F.col("host_docs") * limits.share)
    return likely.join(hosts, same(F.col("host"), F.col("_host"))).filter(over).select("host", "line", "n_docs")


def _hits(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, text_key, host, pos, line, words) of each line to be removed; once for repeated rows."""
    rows = measured.select("id", "text_key", "host", F.posexplode("lines").alias("pos", "at"))
    rows = rows.select("id", "text_key", "host", "pos", "at.line", "at.words")
    often = frequent.select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    on = same(F.col("host"), F.col("_host")) & (F.col("line") == F.col("_line"))
    return rows.join(often, on).drop("_host", "_line").dropDuplicates(["id", "text_key", "host", "pos"])


def _verdicts(measured: DataFrame, hits: DataFrame, limits: LineLimits) -> DataFrame:
    lost = hits.groupBy("id", "text_key", "host").agg(F.sum("words").alias("words"), F.count("*").alias("lines_removed"))
    lost = lost.select(*[F.col(c).alias(f"_{c}") for c in lost.columns])
    on = [same(F.col(c), F.col(f"_{c}")) for c in ("id", "text_key", "host")]
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("_words", F.lit(0)).cast("bigint")
    depleted = F.col("n_words") - gone < F.lit(limits.left) * F.col("n_words")
    return measured.join(lost, on, "left").select(
        "id", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("_lines_removed", F.lit(0)).cast("bigint").alias("lines_removed"), gone.alias("words_removed"),
        base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """One row per row of ``docs`` with its measures, what the line limits remove, and whether it is kept."""
    measured = stage(measures(docs, id_col, text_col, host_col), "measures")
    frequent = stage(frequent_lines(measured, limits), "frequent")
    return _verdicts(measured, _hits(measured, frequent), limits)


@any_columns
def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept rows with all their columns, the frequent lines removed from their text (null stays null)."""
    with scratch() as inner:
        measured = stage(measures(docs, id_col, text_col, host_col), "measures")
        hits = stage(_hits(measured, stage(frequent_lines(measured, limits), "frequent")), "hits")
    rejected = _verdicts(measured, hits, limits).filter(~F.col("kept")).select("id", "text_key", "host").distinct()
    cuts = hits.groupBy("id", "text_key", "host").agg(F.collect_set("line").alias("cuts"))
    marks = stage(
        cuts.withColumn("gone", F.lit(False)).unionByName(rejected.withColumn("gone", F.lit(True)), allowMissingColumns=True)
        .groupBy("id", "text_key", "host").agg(F.max("gone").alias("_gone"), F.first("cuts", ignorenulls=True).alias("_cuts"))
        .withColumnsRenamed({"id": "_id", "text_key": "_key", "host": "_host"}), "marks",
    )
    discard(docs.sparkSession, inner)
    text = whole(F.col(text_col))
    on = same(F.col(id_col), F.col("_id")) & (F.xxhash64(text) == F.col("_key")) & same(F.col(host_col).cast("string"), F.col("_host"))
    left = bind(F.col("_cuts"), lambda c: joined_lines(F.filter(
        F.split(text, "\n"), lambda x: (without_white(x) == "") | ~F.array_contains(c, line_digest(x))
    )))
    cleaned = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(left)
    rows = docs.join(growing(marks), on, "left").filter(~F.coalesce("_gone", F.lit(False)))
    return rows.withColumn(text_col, cleaned).select(*docs.columns)
