"""Byte-level BPE by higher-order functions: a ranked fold over the bytes of distinct words, and decoding.

A rank file maps byte strings to ranks, which are also the ids. For every token and every cut of it into two tokens, its
merges hold the symbol of the left id before the right one, in ``BUCKETS`` small maps, so that a look-up reads one of them. A symbol
is one long: the rank of its merge with the next symbol and its own id, from high to low bits. A word starts as the symbols of its bytes.
The least symbol is the next to be joined with its follower; of equal ones, the leftmost. Least symbols of equal rank are equal: their
merges cover the same bytes, and bytes that nothing has crossed yet come to the same two ids wherever they stand.
A step of the fold joins that pair and looks up only the two pairs it changes.

A word that is itself a token is that token. The tokens and the ``COMMON`` most frequent of the other words of the table, folded
once, are a dictionary, whose size is bounded by the file and that parameter; words beyond it are folded where they stand, so
every word gets its ids whichever side it is on, and no text is shuffled. Only word counts are, after being combined in each map task.
Merges and dictionary are one staged row, which the plan reads as a scalar subquery: a literal of that size would be held, printed
and sent as objects, on the driver and for each task.

Defined cases: a null text counts as empty (no ids); rows that repeat an id give a row each; an empty table gives an empty
result; other columns are ignored. Words are split by Java's regular expressions with Unicode classes, whose
character tables are those of the Java version. A vocabulary has fewer than 2^17 ids and holds every single byte.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from voxloom.functions.arrays import bind, indices
from voxloom.llm.text import whole
from voxloom.session import stage

ID_BITS = 17
BUCKETS = 1 << ID_BITS  # no fewer than ids: a bucket and a right id then name one left id
SPREAD = 40_503  # odd, so that left ids stay apart
WORD_BUCKETS = 1 << 16
COMMON = 1 << 17
NO_RANK = (1 << ID_BITS) - 1  # above every rank: the symbol does not join the next one


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 byte string and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":"))), kind)


def _bucketed(entries: DataFrame, buckets: int) -> DataFrame:
    """One row, ``table``: an array of ``buckets`` maps, of the (bucket, key, value) rows; as large as these, which are bounded."""
    held = entries.groupBy("bucket").agg(F.collect_list(F.struct("key", "value")).alias("entries"))
    every = entries.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(held, "bucket", "left")
    filled = F.coalesce("entries", F.array().cast(held.schema["entries"].dataType))
    in_order = F.array_sort(F.collect_list(F.struct("bucket", filled.alias("entries"))))
    return every.agg(F.transform(in_order, lambda b: F.map_from_entries(b["entries"])).alias("table"))


def _word_bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(WORD_BUCKETS - 1).cast("bigint"))


class Codec:
    """Encoding and decoding expressions for one rank file."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        if max(ranks.values(), default=0) >= NO_RANK:
            raise ValueError(f"ids must be below {NO_RANK}")
        self.pattern = "(?U)" + pattern
        self.merges: list[tuple[int, int, int]] = []
        self.tokens: list[tuple[str, list[int]]] = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges.append(((left * SPREAD + right) % BUCKETS, right, rank << ID_BITS | left))
            try:
                self.tokens.append((token.decode(), [rank]))
            except UnicodeDecodeError:
                pass  # part of a character, never a whole word
        self.bytes = _literal([ranks[bytes([b])] for b in range(256)], "array<bigint>")
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.hex()
        self.pieces = _literal(pieces, "array<string>")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def merge_table(self, spark: SparkSession) -> DataFrame:
        """One row, ``merges``: the symbol of a left id before a right one, by bucket and right id."""
        entries = stage(spark.createDataFrame(self.merges, "bucket bigint, key bigint, value bigint"), "merges")
        return stage(_bucketed(entries, BUCKETS).withColumnRenamed("table", "merges"), "merge-table")

    def fold(self, word: Column, merges: Column, byte_ids: Column) -> Column:
        """Ids of one word; merges and byte ids are bound once by the caller."""
        long = lambda n: F.lit(n).cast("bigint")
        id_of = lambda symbol: symbol.bitwiseAND(long(NO_RANK))

        def symbol(own: Column, following: Column, own_id: Column, following_id: Column) -> Column:
            """The symbol of ``own`` before ``following``, which is null at the end of the word; a bucket needs their low bits only."""
            bucket = (own * long(SPREAD) + following).bitwiseAND(long(BUCKETS - 1))
            return F.coalesce(F.try_element_at(merges[bucket], following_id), own_id.bitwiseOR(long(NO_RANK << ID_BITS)))

        def step(state: Column, _: Column) -> Column:
            def merge(least: Column, at: Column) -> Column:
                """``at`` counts from 1."""
                joined = F.shiftright(least, ID_BITS)
                before, after = F.get(state, at - 2), F.get(state, at + 1)
                merged = symbol(joined, after, joined, id_of(after))
                rest = F.slice(state, at + 2, F.size(state))
                return F.when(at == 1, F.concat(F.array(merged), rest)).otherwise(F.concat(
                    F.slice(state, F.lit(1), at - 2), F.array(symbol(before, joined, id_of(before), joined), merged), rest,
                ))

            return bind(F.array_min(state), lambda least: F.when(least >= long(NO_RANK << ID_BITS), state).otherwise(
                bind(F.array_position(state, least).cast("int"), lambda at: merge(least, at))
            ))

        def start(ids: Column) -> Column:
            following = lambda i: F.get(ids, i + 1)
            return F.transform(ids, lambda own, i: symbol(own, following(i), own, following(i)))

        characters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")  # one for each byte
        ids = F.transform(characters, lambda c: F.get(byte_ids, F.ascii(c)))
        folded = bind(ids, lambda ids: F.aggregate(indices(F.size(ids) - 1), start(ids), step))
        return F.transform(folded, lambda s: id_of(s).cast("int"))

    def decode(self, ids: Column) -> Column:
        """Bytes of the pieces of ``ids``, one after the other."""
        return bind(self.pieces, lambda pieces: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))


def common_words(rows: DataFrame, codec: Codec, merges: DataFrame, count: int = COMMON) -> DataFrame:
    """(word, ids): the most frequent distinct words of a ``text`` column that are no tokens; at most ``count``."""
    words = rows.select(F.explode(codec.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    tokens = rows.sparkSession.createDataFrame([(word,) for word, _ in codec.tokens], "word string")  # bounded by the file
    top = stage(words.join(tokens, "word", "left_anti").orderBy(F.desc("n"), "word").limit(count).select("word"), "common-words")
    ids = bind(F.col("merges"), lambda merges: bind(codec.bytes, lambda own: codec.fold(F.col("word"), merges, own)))
    return top.select("word", merges.scalar().alias("merges")).select("word", ids.alias("ids"))


def _dictionary(rows: DataFrame, codec: Codec, merges: DataFrame, common: int) -> DataFrame:
    """One row, ``known``: the ids of tokens and common words, by bucket and word."""
    tokens = rows.sparkSession.createDataFrame(codec.tokens, "word string, ids array<int>")
    words = stage(tokens.union(common_words(rows, codec, merges, common)), "known-words")
    entries = words.select(_word_bucket(F.col("word")).alias("bucket"), F.col("word").alias("key"), F.col("ids").alias("value"))
    return stage(_bucketed(entries, WORD_BUCKETS).withColumnRenamed("table", "known"), "dictionary")


def _encoded(docs: DataFrame, codec: Codec, id_col: str, text_col: str, common: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    merges = codec.merge_table(docs.sparkSession)
    known = _dictionary(rows, codec, merges, common)

    def ids_of(known: Column, merges: Column, byte_ids: Column) -> Column:
        ids = lambda word: F.try_element_at(known[_word_bucket(word)], word)
        return F.flatten(F.transform(codec.words(F.col("text")), lambda word: F.coalesce(ids(word), codec.fold(word, merges, byte_ids))))

    ids = bind(F.col("merges"), lambda m: bind(codec.bytes, lambda own: bind(F.col("known"), lambda k: ids_of(k, m, own))))
    # Each table is read once below, so that the optimizer puts it in the place of its column.
    return rows.select("*", merges.scalar().alias("merges"), known.scalar().alias("known")).select("id", "text", ids.alias("ids"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """(id, text, ids) of each row."""
    return _encoded(docs, Codec(path, pattern), id_col, text_col, common)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    codec = Codec(path, pattern)
    found = _encoded(docs, codec, id_col, text_col, common)

    def digests(ids: Column) -> Column:
        listed = F.array_join(ids.cast("array<string>"), ",")
        return F.struct(
            F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
            F.sha2(codec.decode(ids), 256).alias("decoded_sha256"),
        )

    return found.select("id", bind(F.col("ids"), digests).alias("of")).select("id", "of.*")

