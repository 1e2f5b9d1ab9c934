"""Jaccard join of documents on word n-grams, as a blocked product of the sparse document by n-gram matrix.

1. Documents with equal sets are one class; everything after works on classes.
2. The columns of a row are ordered by a fixed rank: n-grams that are frequent come last, others by hash. Two sets that are
   similar enough share at least ``floor_`` of their first columns (the prefix), whose number follows from the size
   of the set alone. Only prefixes are multiplied. Classes with fewer shared columns than their size needs are dropped.
3. Each column has a pivot, the class whose columns are the most shared. Its row is compared with all others of the column, which
   joins most members of a large group of near copies in one pass, linear in the size of the matrix.
4. Columns that still hold several components are multiplied block by block: rows are dealt into blocks of at
   most ``BLOCK_ROWS``, one task accumulates the overlap counts of two blocks and discards pairs within one component, pairs
   whose sizes cannot be similar, and pairs below the overlap that their sizes ask of the prefixes.
5. Surviving pairs are compared on whole sets. Components of the links are found by passing on the smallest label.

No component is cut: a pair is either compared, in one component already, or below a bound that every link meets. Pairs within
one component are not all compared, so this gives components only, neither the linked pairs nor a number of links per document. The
frequent n-grams only set the order, so their number is bounded (``HOT``) without an effect on the result.
Sets are told apart by 64-bit hashes of n-grams and of whole sets.

Defined cases: null, empty and white texts have an empty set, are linked with nothing and are their own component; a null id takes
part and is never the smallest id while another is there; rows that repeat an id give a row each, and :func:`deduplicate`
tells them apart by a 64-bit hash of their text; an empty table gives an empty result; other columns are ignored by :func:`components` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from voxloom.llm.shingles import Shingler, pieces
from voxloom.llm.text import any_columns, growing, same, whole
from voxloom.session import discard, scratch, stage

SIZE, PART, OF = 4, 85, 100  # words in an n-gram; similarity PART / OF
HOT = 1 << 17
OFTEN = 3  # times in some MB of text, to be counted as frequent
BLOCK_ROWS = 512
NO_SIG = 0


def overlap(n: Column, m: Column, part: int) -> Column:
    """Least common part of two similar sets of sizes n and m: part / (OF + part) of the sum, rounded up."""
    return F.ceil((n + m) * part / (OF + part) - F.lit(1e-9))


def floor_(n):
    """Least number of prefix columns shared with a set that is not smaller."""
    return 1 + n // 24


def prefix_length(n: int, part: int) -> int:
    return min(n, n - -(-part * n // OF) + floor_(n))


class Rows:
    """The matrix rows of texts: ordered columns, with frequent n-grams last."""

    def __init__(self, size: int, hot: np.ndarray, level: np.ndarray):
        self.shingler, self.hot, self.level = Shingler(size), hot, level

    def columns(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(set hash, sorted columns) of each text; columns are 63 bits: level, then hash."""
        for grams in self.shingler.runs(texts):
            sig = int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else NO_SIG
            out = (grams >> np.uint64(8)).astype(np.int64)
            if len(self.hot) and len(grams):
                at = np.minimum(np.searchsorted(self.hot, grams), len(self.hot) - 1)
                out |= np.where(self.hot[at] == grams, self.level[at], 0) << 56
            yield sig, np.sort(out)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(F.col(text_col))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.encode(text, "UTF-8").alias("data"), F.xxhash64(text).alias("text_key"))


def frequent(texts: DataFrame, size: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams and their levels (logarithm of how many documents were counted); at most ``hot``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for part in pieces(batch.column(0)):
                grams, n = np.unique(np.concatenate(list(shingler.runs(part))), return_counts=True)
                often = n >= OFTEN
                yield pa.record_batch([pa.array(grams[often].view(np.int64)), pa.array(n[often])], ["gram", "n"])

    counted = texts.select("data").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "gram").limit(hot).toPandas()
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], (1 + np.log2(top["n"].to_numpy(np.float64)[order]).astype(np.int64)).clip(1, 100)


def matrix(texts: DataFrame, size: int, part: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, text_key, sig, n, prefix) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Rows(size, *hot)
        for batch in batches:
            ids, keys, done = batch.column(0), batch.column(2), 0
            for piece in pieces(batch.column(1)):
                sigs, ns, prefixes = [], [], []
                for sig, columns in reader.columns(piece):
                    sigs.append(sig)
                    ns.append(len(columns))
                    prefixes.append(columns[: prefix_length(len(columns), part)])
                ends = np.cumsum([0, *map(len, prefixes)])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                own = [c.slice(done, len(piece)) for c in (ids, keys)]
                yield pa.record_batch([*own, pa.array(sigs, pa.int64()), pa.array(ns, pa.int32()), lists], ["id", "text_key", "sig", "n", "prefix"])
                done += len(piece)

    return texts.mapInArrow(rows, "id long, text_key long, sig long, n int, prefix array<long>")


def whole_sets(texts: DataFrame, size: int, hot: tuple[np.ndarray, np.ndarray], wanted: DataFrame) -> DataFrame:
    """(sig, columns) of the wanted (id, sig), from their texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Rows(size, *hot)
        for batch in batches:
            sigs, done = batch.column(0).to_pylist(), 0
            for piece in pieces(batch.column(1)):
                found = [(s, c) for w, (s, c) in zip(sigs[done:], reader.columns(piece)) if w == s]
                done += len(piece)
                yield pa.record_batch([pa.array([s for s, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["sig", "columns"])

    joined = texts.join(growing(wanted.withColumnRenamed("id", "_id")), same(F.col("id"), F.col("_id"))).select("sig", "data")
    return joined.mapInArrow(rows, "sig long, columns array<long>").dropDuplicates(["sig"])


def links(pairs: DataFrame, sets: DataFrame, part: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    left = sets.select(F.col("sig").alias("a"), F.col("columns").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("columns").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return pairs.join(growing(left), "a").join(growing(right), "b").filter(OF * common >= part * union).select("a", "b")


def labels(found: DataFrame) -> DataFrame:
    """(sig, label) of all ends of the links (a, b); the label is the smallest sig of the component."""
    ends = stage(found.select("a", "b").union(found.select("b", "a")).filter("a != b").distinct(), "links")
    now = stage(ends.groupBy(F.col("a").alias("sig")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = ends.join(now.withColumnsRenamed({"sig": "b", "label": "near"}), "b").groupBy(F.col("a").alias("sig")).agg(F.min("near").alias("near"))
        step = stage(now.join(near, "sig").select("sig", "label", F.least("label", "near").alias("next")), "labels")
        jump = step.select(F.col("sig").alias("next"), F.col("next").alias("far"))
        step = stage(step.join(jump, "next").select("sig", "label", F.least("next", "far").alias("next")), "labels")
        now = step.select("sig", F.col("next").alias("label"))
        if step.filter("label != next").isEmpty():
            return now


def _needed(n: Column, part: int) -> Column:
    """Columns of its prefix that a class must share with others to have a link."""
    return F.lit(1) + F.floor(F.ceil(n * part / OF - F.lit(1e-9)) / 24)


def _pivot_pairs(cells: DataFrame) -> DataFrame:
    """(a, b, hits): the pivot of each column with the other rows of that column, and in how many columns."""
    best = F.max(F.struct("weight", "sig")).alias("p")
    pivots = cells.groupBy("key").agg(best, F.count("*").alias("rows")).filter("rows > 1")
    pivots = stage(pivots.select("key", F.col("p.sig").alias("a")), "pivots")
    met = cells.select("key", F.col("sig").alias("b")).join(growing(pivots), "key").filter("a != b")
    return met.groupBy("a", "b").agg(F.count("*").alias("hits"))


def _within_bounds(pairs: DataFrame, rows: DataFrame, part: int) -> DataFrame:
    """The pairs whose sizes and shared prefix columns allow a link; ``rows`` has sig, n, k, last, keys."""
    sides = [rows.select(F.col("sig").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "k", "last", "keys")]) for s in "ab"]
    joined = pairs.join(growing(sides[0]), "a").join(growing(sides[1]), "b")
    least = overlap(F.col("n_a"), F.col("n_b"), part)
    rest = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a") - F.col("k_a")).otherwise(F.col("n_b") - F.col("k_b"))
    need = F.greatest(least - rest, F.lit(1) + F.floor(F.least("n_a", "n_b") / 24))
    fits = OF * F.least("n_a", "n_b") >= part * F.greatest("n_a", "n_b")
    return joined.filter(fits).filter(F.size(F.array_intersect("keys_a", "keys_b")) >= need).select(*pairs.columns)


def _open_cells(cells: DataFrame, part: int) -> DataFrame:
    """The cells of columns with several labels, without classes that share too few such columns."""
    for _ in range(2):  # dropping a class may close a column; twice is enough to be worth it
        mixed = cells.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
        cells = stage(cells.join(growing(stage(mixed, "mixed")), "key"), "open-cells")
        some = cells.groupBy("sig").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
        some = some.filter(F.col("shared") >= _needed(F.col("n"), part)).select("sig")
        cells = cells.join(growing(stage(some, "enough")), "sig")
    return stage(cells, "open-cells")


def _blocks(cells: DataFrame, pivots: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """(sig, block): rows that meet the pivots of one component most often are dealt into blocks of about ``rows``."""
    of_pivot = known.withColumnsRenamed({"sig": "a", "label": "group"})
    met = pivots.join(of_pivot, "a", "left").select(F.col("b").alias("sig"), F.coalesce("group", "a").alias("group"), "hits")
    met = met.groupBy("sig", "group").agg(F.sum("hits").alias("hits")).groupBy("sig").agg(F.max(F.struct("hits", "group")).alias("m"))
    own = cells.select("sig", "label").distinct().join(met, "sig", "left")
    linked = F.when(F.col("label") != F.col("sig"), F.col("label"))
    own = stage(own.select("sig", F.coalesce(linked, F.col("m.group"), "sig").alias("group")), "groups")
    sizes = own.groupBy("group").agg(F.ceil(F.count("*") / rows).alias("parts"))
    return own.join(sizes, "group").select("sig", F.xxhash64("group", F.pmod(F.xxhash64("sig"), F.col("parts"))).alias("block"))


def _product(cells: DataFrame, part: int) -> DataFrame:
    """Pairs (a, b) of different components that meet the bounds; ``cells`` has key, sig, n, k, last, label, block."""
    held = cells.groupBy("key", "block").agg(F.count("*").alias("rows"))
    held = stage(held, "held")
    left, right = held.select("key", F.col("block").alias("one")), held.select("key", F.col("block").alias("two"))
    meetings = left.join(growing(right), "key").filter("one <= two")
    rows = cells.withColumnRenamed("block", "own").join(meetings, "key").filter("own = one OR own = two")
    schema = "a long, b long"

    def multiply(block: list[np.ndarray]) -> list[np.ndarray]:
        (one, *_), (two, *_), key, sig, n, k, last, label, own = block
        _, first, code = np.unique(sig, return_index=True, return_inverse=True)
        size, rest, last_, label_, own_ = n[first], (n - k)[first], last[first], label[first], own[first]
        rows_ = [np.flatnonzero(own_ == b) for b in (one, two)]
        place = np.zeros(len(first), np.int64)
        for r in rows_:
            place[r] = np.arange(len(r))
        counts = np.zeros((len(rows_[0]), len(rows_[1])), np.int32)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        for run in np.split(order, starts[1:]):  # one column of the matrix
            a, b = run[own[run] == one], run[own[run] == two]
            counts[np.ix_(place[code[a]], place[code[b]])] += 1
        x, y = np.nonzero(counts)
        i, j = rows_[0][x], rows_[1][y]
        least = -(-part * (size[i] + size[j]) // (OF + part))
        short = np.where(last_[i] <= last_[j], rest[i], rest[j])
        need = np.maximum(least - short, np.minimum(floor_(size[i]), floor_(size[j])))
        ok = (label_[i] != label_[j]) & (counts[x, y] >= need) & (OF * np.minimum(size[i], size[j]) >= part * np.maximum(size[i], size[j]))
        if one == two:
            ok &= i < j
        names = sig[first]
        return [names[i[ok]], names[j[ok]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solved():
            found = multiply([np.concatenate(c) for c in zip(*held)])
            return pa.record_batch([pa.array(c, pa.int64()) for c in found], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(9)]
            new = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            for piece in zip(*(np.split(c, new) for c in columns)):
                if held and (held[0][0][0], held[0][1][0]) != (piece[0][0], piece[1][0]):
                    yield solved()
                    held = []
                if len(piece[0]):
                    held.append(piece)
        if held:
            yield solved()

    dealt = rows.select("one", "two", "key", "sig", "n", "k", "last", "label", "own").repartition("one", "two")
    return dealt.sortWithinPartitions("one", "two").mapInArrow(run, schema).distinct()


def _represented(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, part: int = PART, hot: int = HOT, rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, text_key, n, best) of each row of ``docs``; ``best`` is the smallest (no_id, id, text_key) of its component, null without words."""
    texts = _texts(docs, id_col, text_col)
    order = frequent(texts, size, hot)
    members = stage(matrix(texts, size, part, order), "matrix")
    classes = members.filter("n > 0").groupBy("sig").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix")
    )
    classes = stage(classes, "classes")
    spread = classes.select("sig", F.explode("prefix").alias("key"))
    columns = spread.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key")
    shared = spread.join(growing(stage(columns, "columns")), "key").groupBy("sig").agg(F.collect_list("key").alias("keys"))
    info = classes.select("sig", "n", F.size("prefix").alias("k"), F.array_max("prefix").alias("last"))
    rows_ = stage(shared.filter(F.size("keys") > 0).join(info, "sig").filter(F.size("keys") >= _needed(F.col("n"), part)), "rows")
    cells = rows_.select("sig", "n", "k", "last", (F.size("keys") / F.col("k")).alias("weight"), F.explode("keys").alias("key"))

    pivots = stage(_pivot_pairs(cells), "pivot-pairs")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        wanted = stage(classes.select("sig", F.col("least.id").alias("id")).join(ends, "sig"), "wanted")
        return stage(links(pairs.select("a", "b"), stage(whole_sets(texts, size, order, wanted), "sets"), part), name)

    first = similar(stage(_within_bounds(pivots, rows_, part), "bounded-pairs"), "first-links")
    known = stage(labels(first), "known")
    named = cells.drop("weight").join(growing(known), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    left = _open_cells(named, part)
    left = stage(left.join(growing(stage(_blocks(left, pivots, known, rows), "blocks")), "sig"), "blocked")
    second = similar(stage(_product(left, part), "pairs"), "second-links")

    known = stage(labels(first.union(second)), "components")
    least = known.join(classes.select("sig", "least"), "sig").groupBy("label").agg(F.min("least").alias("best"))
    joined = known.join(least, "label").select("sig", "best")
    of_class = classes.select("sig", "least").join(joined, "sig", "left").select("sig", F.coalesce("best", "least").alias("best"))
    found = members.select("id", "text_key", "sig", "n").join(growing(stage(of_class, "of-class")), "sig", "left")
    return found.select("id", "text_key", "n", "best")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``docs``; sets are linked at a similarity of ``part`` percent."""
    found = _represented(docs, id_col, text_col, **options)
    return found.select("id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("best.id", "id").alias("component_id"))


@any_columns
def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, of the smallest id and then text key, with all its columns; one of repeated rows."""
    with scratch() as inner:
        found = _represented(docs, id_col, text_col, **options)
    found = stage(found, "components")
    discard(docs.sparkSession, inner)
    first = same(F.col("id"), F.col("best.id")) & (F.col("text_key") == F.col("best.text_key"))
    gone = found.filter("best IS NOT NULL").filter(~first).select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    on = same(F.col(id_col), F.col("_id")) & (F.xxhash64(whole(F.col(text_col))) == F.col("_key"))
    stays = docs.join(growing(gone), on, "left_anti")
    repeated = found.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return stays if repeated.isEmpty() else stays.dropDuplicates([id_col, text_col])
