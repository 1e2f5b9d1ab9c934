"""Exact deduplication with an extendible-hash index on shared files, in DataFrame operations only.

Index entries (hash key, document, length, digest) are written to the shared folder, without texts. A directory of
key prefixes is grown over the distinct keys: buckets that hold more than ``capacity`` keys are split by one
more bit, round by round, and the directory doubles with each round. A bucket is a range of keys and has one owner task.

Texts are compared by their bytes: they are grouped by (key, text, length), which combines the copies that a map task
holds before the exchange, so a group of copies of any size travels as a few rows per map task. The owner of a bucket
chains the different texts of one key (a hash collision) in the order of their SHA-256, without the texts. The directory thus
no longer carries the comparison: it only says which owner chains a key, and the result would be the same without it.

Defined cases: a null text counts as empty; a null id sorts after all other ids; rows that repeat an id and
its text are counted one by one, all carry the same result, and :func:`deduplicate` returns one of them; an
empty table gives an empty result; further columns are kept by :func:`deduplicate` and ignored by :func:`copies`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from voxloom.llm.text import any_columns, growing, same, whole, without_white
from voxloom.session import discard, scratch, stage

KEY_BITS = 64
CAPACITY = 4096  # distinct keys in a bucket


def _prefix(key: Column, depth: int) -> Column:
    return F.lit(0).cast("bigint") if depth == 0 else F.shiftrightunsigned(key, KEY_BITS - depth)


def _normalised(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    """(id, chars, norm, key) of each row. ``key_bits`` below 64 forces collisions, for tests."""
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("chars"), without_white(text).alias("norm"))
    mask = (-1 << (KEY_BITS - key_bits)) if key_bits else 0
    return rows.withColumn("key", F.xxhash64("norm").bitwiseAND(F.lit(mask).cast("bigint")))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Buckets (prefix, depth, n_keys) such that each holds at most ``capacity`` of the distinct ``key`` values.

    The first directory has about one slot per ``capacity`` keys. Every round splits the overfull buckets only.
    """
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / capacity)))
    left, done = keys.select("key"), []
    while True:
        counts = stage(left.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(F.count("*").alias("n_keys")), "slots")
        done.append(counts.filter(F.col("n_keys") <= capacity).withColumn("depth", F.lit(depth)))
        overfull = counts.filter(F.col("n_keys") > capacity)
        if overfull.isEmpty():
            return stage(reduce(DataFrame.unionByName, done), "directory")
        left = stage(left.withColumn("prefix", _prefix(F.col("key"), depth)).join(overfull, "prefix", "left_semi").select("key"), "overfull")
        depth += 1


def with_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Adds ``bucket``: the first slot of the key's bucket in the directory of the greatest depth."""
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    free = F.lit(depth) - F.col("depth")
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    last = first + F.pow(F.lit(2), free).cast("bigint") - 1
    slots = buckets.select(first.alias("bucket"), F.explode(F.sequence(first, last)).alias("slot"))
    return rows.withColumn("slot", _prefix(F.col("key"), depth)).join(slots, "slot").drop("slot")


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS, capacity: int = CAPACITY
) -> DataFrame:
    """One row per row of ``docs``: id, key, chars, keep_id, keep_chars, group_size, kept, text_sha256.

    Of equal texts (white space removed) the row with the most code points, then the smallest id, is kept.
    """
    rows = _normalised(docs, id_col, text_col, key_bits)
    entries = stage(rows.select("id", "key", "chars", F.unhex(F.sha2("norm", 256)).alias("digest")), "index")
    keys = stage(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    # Equal bytes meet here; a group of copies has been combined in each map task before.
    pages = rows.groupBy("key", "norm", "chars").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    pages = pages.select("key", F.unhex(F.sha2("norm", 256)).alias("digest"), "chars", "n", "least")
    shared = with_bucket(keys.filter("n > 1").select("key"), directory(keys, capacity))
    owned = stage(pages, "pages").join(shared, "key")
    chain = F.dense_rank().over(Window.partitionBy("bucket", "key").orderBy("digest"))
    best = F.max_by(F.struct("least", "chars"), "chars")
    classes = owned.withColumn("chain", chain).groupBy("bucket", "key", "chain", "digest").agg(
        F.sum("n").alias("group_size"), best.alias("best")
    )
    classes = classes.select(
        "key", "digest", F.col("best.least").alias("keep_id"), F.col("best.chars").alias("keep_chars"), "group_size"
    )
    found = entries.join(growing(stage(classes, "classes")), ["key", "digest"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    keep_chars = F.when(alone, F.col("chars")).otherwise(F.col("keep_chars"))
    return found.select(
        "id", "key", "chars", keep_id.alias("keep_id"), keep_chars.alias("keep_chars"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (same(F.col("id"), keep_id) & (F.col("chars") == keep_chars)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@any_columns
def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    with scratch() as inner:
        verdict = copies(docs, id_col, text_col, **options)
    verdict = stage(verdict, "verdict")
    discard(docs.sparkSession, inner)
    gone = verdict.filter(~F.col("kept")).select(
        F.col("id").alias("_id"), F.col("text_sha256").alias("_digest"), F.col("chars").alias("_chars")
    ).distinct()
    text = whole(F.col(text_col))
    digest = F.sha2(without_white(text), 256)
    on = same(F.col(id_col), F.col("_id")) & (digest == F.col("_digest")) & (F.length(text) == F.col("_chars"))
    stays = docs.join(growing(gone), on, "left_anti")
    repeated = verdict.filter("kept").groupBy("id", "text_sha256").count().filter("count > 1")
    if repeated.isEmpty():
        return stays
    return stays.withColumn("_digest", digest).dropDuplicates([id_col, "_digest"]).drop("_digest")
