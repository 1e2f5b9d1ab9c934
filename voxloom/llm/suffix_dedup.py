"""Removal of repeated byte strings with anchored suffixes that are sorted deep-shallow.

Every string of ``length`` bytes holds one anchor: its smallest k-gram by hash, the leftmost among equals. Equal strings
have equal anchors at equal places, so only suffixes that begin at an anchor need sorting, one in about 170 positions, and
each stands for the run of strings that chose it (its context: the bytes of all these strings).

1. One pass over the texts writes the anchors: hash, digest of the context, place. No text is moved.
2. Anchors whose hash is alone are dropped. Contexts that occur twice or more are repeated as a whole; copies, however many, are
   told by that and counted map-side.
3. One representative of each different context of a shared anchor is cut out of its text. Suffixes from the anchor on, and
   backwards from it, are sorted: multikey quicksort to a shallow depth, then blind tries for the groups that are still
   equal. Neighbours' common prefixes in the two orders give the common strings of any two contexts. An anchor with more than
   ``GROUP`` contexts is not brought together: its strings are compared by 128-bit digests, spread by digest.
4. The repeated strings of a context cover one stretch around its anchor. Stretches are joined to all occurrences, and
   the bytes they cover are removed.

Passages of so many words are found in the same way: each word (a run of bytes that are not white space) becomes a code of
``CODE`` bytes, so that all runs of that many words have one length. Spans of codes are cut back to whole words.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose nothing; rows that repeat an id and text
repeat each other; an empty table gives an empty result; :func:`deduplicate` keeps other columns, and drops the bytes
of a character that is cut in two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from voxloom.llm.shingles import Shingler
from voxloom.llm.text import any_columns, growing, whole
from voxloom.session import discard, scratch, stage

LENGTH = 400
GRAM = 64
SHALLOW = 32
GROUP = 1024
SEGMENT = 1 << 20
CODE = 8  # bytes that stand for a word
NO_ID = -(1 << 63)
ANCHORS = "id long, text_key long, anchor long, context long, at int, before int, after int"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & 0xFFFFFFFFFFFFFFFF
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the anchors of texts, a few MB at a time."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.byte = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def _grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: n + 1 - self.gram]) * self.down[: n + 1 - self.gram]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, first string, last string) of each anchor. ``ends``: where the text of each byte ends."""
        strings = len(data) - self.length + 1
        none = np.zeros(0, np.int64)
        if strings <= 0:
            return none, none, none, none
        grams = self._grams(data)
        low = np.uint64((1 << 24) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, have = self.length - self.gram + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        places = (least & low).astype(np.int64)
        starts = np.arange(strings)
        starts = starts[starts + self.length <= ends[:strings]]
        if not len(starts):
            return none, none, none, none
        places = places[starts]
        new = np.append(True, (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        at = places[first]
        return at, grams[at].view(np.int64), starts[first], starts[last]

    def rows(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, anchor, context, place, before, after) for all anchors of the texts."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            for a in range(0, max(1, len(text) - self.length + 1), SEGMENT):
                piece = text[a : a + SEGMENT + self.length - 1]
                if len(piece) < self.length:
                    continue
                held.append((i, a, piece))
                size += len(piece)
                if size >= SEGMENT:
                    yield from self._held(held)
                    held, size = [], 0
        yield from self._held(held)

    def _held(self, held: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        joined = b"".join(p for _, _, p in held)
        lengths = np.array([len(p) for _, _, p in held], np.int64)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(held)), lengths)
        data = np.frombuffer(joined, np.uint8)
        at, anchors, first, last = self.find(data, ends[owner] if len(held) else data)
        begins = ends - lengths
        for p, h, a, b in zip(at.tolist(), anchors.tolist(), first.tolist(), last.tolist()):
            k = owner[a]
            before, after = p - a, b + self.length - p
            digest = hashlib.blake2b(joined[a : b + self.length] + before.to_bytes(4, "little"), digest_size=8).digest()
            yield held[k][0], h, int.from_bytes(digest, "little", signed=True), held[k][1] + p - int(begins[k]), before, after


def multikey_quicksort(strings: list[bytes], depth: int = SHALLOW) -> list[int]:
    """Order of the strings; groups that are equal to the shallow depth are ordered by a blind trie."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        rows, at = todo.pop()
        if len(rows) <= 1:
            out.extend(rows)
            continue
        if at >= depth:
            out.extend(BlindTrie(strings, rows).order())
            continue
        keys = {i: strings[i][at : at + 8] for i in rows}
        pivot = keys[rows[len(rows) // 2]]
        less, same, more = [], [], []
        for i in rows:
            (less if keys[i] < pivot else more if keys[i] > pivot else same).append(i)
        if len(pivot) < 8:  # the strings end here
            todo += [(more, at), (same, depth) if len(same) > 1 else (same, at), (less, at)]
        else:
            todo += [(more, at), (same, at + 8), (less, at)]
    return out


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are equal."""
    top = min(len(a), len(b))
    if a[known:top] == b[known:top]:
        return top
    low, high = known, top
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """A trie that stores only where strings part: a node has a depth and a branch for each byte found there (-1: end)."""

    def __init__(self, strings: list[bytes], rows: list[int]):
        self.strings = strings
        self.root: list = ["leaf", [rows[0]]]
        for row in rows[1:]:
            self._insert(row)

    def _byte(self, row: int, depth: int) -> int:
        s = self.strings[row]
        return s[depth] if depth < len(s) else -1

    def _insert(self, row: int) -> None:
        node = self.root
        while node[0] == "node":  # blind: looks at the bytes of branches only
            node = node[2].get(self._byte(row, node[1])) or next(iter(node[2].values()))
        leaf = node[1][0]
        depth = common_prefix(self.strings[row], self.strings[leaf])
        if depth == len(self.strings[row]) == len(self.strings[leaf]):
            node[1].append(row)
            return
        node = self.root
        while node[0] == "node" and node[1] < depth:
            node = node[2][self._byte(row, node[1])]
        if node[0] == "node" and node[1] == depth:
            node[2][self._byte(row, depth)] = ["leaf", [row]]
            return
        node[:] = ["node", depth, {self._byte(leaf, depth): list(node), self._byte(row, depth): ["leaf", [row]]}]

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node[0] == "leaf":
                out.extend(node[1])
            else:
                todo.extend(node[2][b] for b in sorted(node[2], reverse=True))
        return out


def prefixes(strings: list[bytes]) -> np.ndarray:
    """Matrix of the lengths of common prefixes, from the sorted order and its neighbours."""
    order = multikey_quicksort(strings)
    n = len(order)
    near = np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])], np.int32)
    out = np.zeros((n, n), np.int32)
    for i in range(n - 1):
        out[i, i + 1 :] = np.minimum.accumulate(near[i:])
    out += out.T
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return out[np.ix_(back, back)]


def repeated_stretches(contexts: list[bytes], before: list[int], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """For each context the bytes before and after its anchor that its repeated strings cover."""
    right = [c[b:] for c, b in zip(contexts, before)]
    left = [c[:b][::-1] for c, b in zip(contexts, before)]
    if len(contexts) == 2:
        r, l = common_prefix(*right), common_prefix(*left)  # noqa: E741
        return [(l, r)] * 2 if l + r >= length else [None] * 2
    r, l = prefixes(right), prefixes(left)  # noqa: E741
    long = r + l >= length
    np.fill_diagonal(long, False)
    r, l, some = np.where(long, r, 0).max(1), np.where(long, l, 0).max(1), long.any(1)  # noqa: E741
    return [(int(a), int(b)) if s else None for a, b, s in zip(l, r, some)]


class Words:
    """Texts as strings of codes, one 64-bit hash for each run of bytes that are not white space."""

    def __init__(self):
        self.shingler = Shingler(1, lower=False)

    def codes(self, text: bytes) -> bytes:
        return self.shingler.words([text])[0].astype("<u8").tobytes()

    def places(self, text: bytes, spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans of codes as spans of the text, from whole words to whole words."""
        _, _, start, end = self.shingler.words([text])
        found = [(-(-a // CODE), b // CODE) for a, b in spans_]
        return [(int(start[a]), int(end[b - 1])) for a, b in found if a < b]


def _reader(words: bool):
    return Words().codes if words else bytes


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(F.col(text_col))
    return docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), "_key": F.xxhash64(text), "_data": F.encode(text, "UTF-8")})


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """The anchors of all texts, or of their ``words`` as codes (schema ``ANCHORS``)."""
    least = 2 * (length // CODE) - 1 if words else length
    rows = _keyed(docs, id_col, text_col).select("_id", "_key", "_data").filter(F.octet_length("_data") >= least)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, read = Anchors(length, gram), _reader(words)
        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out: list[list] = [[] for _ in range(7)]
            done = 0
            while done < len(texts):  # a few MB of texts at a time
                part, size = [], 0
                while done + len(part) < len(texts) and size < SEGMENT:
                    part.append(read(texts[done + len(part)].as_py()))
                    size += len(part[-1])
                for i, *found in finder.rows(part):
                    for column, value in zip(out, (ids[done + i], keys[done + i], *found)):
                        column.append(value)
                done += len(part)
                yield _batch(ANCHORS, out)
                out = [[] for _ in range(7)]

    return rows.mapInArrow(find, ANCHORS)


def _contexts(docs: DataFrame, wanted: DataFrame, words: bool) -> DataFrame:
    """(anchor, context, before, size, data) of the wanted representatives; one text is read once."""
    schema = "anchor long, context long, before int, crowd long, data binary"
    rows = docs.select("_id", "_key", "_data").join(growing(wanted), ["_id", "_key"]).select("_data", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(words)
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                text, rows = read(text.as_py()), wanted.as_py()
                out = [[w[c] for w in rows] for c in ("anchor", "context", "before", "crowd")]
                yield _batch(schema, [*out, [text[w["at"] - w["before"] : w["at"] + w["after"]] for w in rows]])

    return rows.mapInArrow(cut, schema)


STRETCHES = "anchor long, context long, before int, after int"


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Stretches of the contexts of each anchor, sorted in the task that owns the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(group):
            anchor, names, before, data = group
            found = repeated_stretches(data, before, length) if len(data) > 1 else [None]
            return [(anchor, n, *f) for n, f in zip(names, found) if f]

        group, out = None, []
        for batch in batches:
            for anchor, name, before, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if group is None or group[0] != anchor:
                    out += solved(group) if group else []
                    group = (anchor, [], [], [])
                if not group[1] or group[1][-1] != name:  # repeated rows give a context twice
                    group[1].append(name)
                    group[2].append(before)
                    group[3].append(data)
            if len(out) > 10000:
                yield _batch(STRETCHES, list(zip(*out)))
                out = []
        out += solved(group) if group else []
        if out:
            yield _batch(STRETCHES, list(zip(*out)))

    rows = contexts.select("anchor", "context", "before", "data")
    return rows.repartition("anchor").sortWithinPartitions("anchor", "context").mapInArrow(run, STRETCHES)


def _crowded(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many contexts: strings meet by digest, counted map-side."""
    schema = "anchor long, context long, before int, string binary"

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, name, before, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                n = len(data) - length + 1
                digests = [hashlib.blake2b(data[i : i + length] + anchor.to_bytes(8, "little", signed=True), digest_size=16).digest() for i in range(n)]
                yield _batch(schema, [[anchor] * n, [name] * n, list(range(before, before - n, -1)), digests])

    rows = stage(contexts.mapInArrow(strings, schema), "strings")
    twice = stage(rows.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string"), "twice")
    found = rows.join(twice, "string").groupBy("anchor", "context")
    return found.agg(F.max("before").alias("before"), (F.lit(length) - F.min("before")).alias("after"))


def spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, words: bool = False
) -> DataFrame:
    """(_id, _key, spans) of the texts that hold repeated strings; spans are (from, to) in bytes (of codes: ``words``) and may overlap."""
    found = stage(anchors(docs, id_col, text_col, length, gram, words), "anchors")
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    shared = stage(shared.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "shared")
    shared = stage(found.join(growing(shared), "anchor"), "shared-anchors")  # a plain join of two tables: a hot anchor is split

    contexts = stage(shared.groupBy("anchor", "context", "mixed").agg(
        F.count("*").alias("n"), F.first(F.struct("id", "text_key", "at", "before", "after")).alias("of")
    ), "contexts")
    copied = contexts.filter("n > 1").select("anchor", "context", "of.before", "of.after")
    mixed = contexts.filter("mixed")
    crowds = stage(mixed.groupBy("anchor").agg(F.count("*").alias("crowd")), "crowds")
    one = F.struct("anchor", "context", "of.at", "of.before", "of.after", "crowd")
    wanted = mixed.join(crowds, "anchor").groupBy(F.col("of.id").alias("_id"), F.col("of.text_key").alias("_key")).agg(F.collect_list(one).alias("wanted"))
    cut = stage(_contexts(_keyed(docs, id_col, text_col), stage(wanted, "wanted"), words), "cut")
    near = _sorted_groups(cut.filter(F.col("crowd") <= group), length)
    far = cut.filter(F.col("crowd") > group)
    parts = copied.unionByName(near)
    if not far.isEmpty():
        parts = parts.unionByName(_crowded(far, length))
    cover = parts.groupBy("anchor", "context").agg(F.max("before").alias("l"), F.max("after").alias("r"))
    span = F.struct((F.col("at") - F.col("l")).alias("a"), (F.col("at") + F.col("r")).alias("b"))
    hits = shared.join(growing(stage(cover, "cover")), ["anchor", "context"]).select("id", "text_key", span.alias("span"))
    return hits.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("span").alias("spans"))


def _written_spans(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """:func:`spans` as a table, without the tables of the search."""
    with scratch() as inner:
        found = spans(docs, id_col, text_col, **options)
    found = stage(found, "spans")
    discard(docs.sparkSession, inner)
    return found


def merged(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans_):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remaining(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _keyed(docs, id_col, text_col).join(growing(found.withColumnRenamed("spans", "_spans")), ["_id", "_key"], "left")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, text of each row; ``text`` is what remains, without characters that are cut in two."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_col, text_col = "doc_id", "text"
    rows = _with_spans(docs, _written_spans(docs, id_col, text_col, **options), id_col, text_col)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [[] for _ in range(6)], 0
            for doc, data, found in zip(*(batch.column(i) for i in range(3))):
                data = data.as_py()
                runs = merged([(s["a"], s["b"]) for s in found.as_py() or []])
                left = _remaining(data, runs)
                row = (doc.as_py(), len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"))
                for column, value in zip(out, row):
                    column.append(value)
                size += len(left)
                if size >= 4 * SEGMENT:
                    yield _batch(schema, out)
                    out, size = [[] for _ in range(6)], 0
            yield _batch(schema, out)

    return rows.select(F.col(id_col).cast("bigint"), "_data", "_spans").mapInArrow(remove, schema)


@any_columns
def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, **options) -> DataFrame:
    """The rows with all their columns, without the repeated bytes; ``words``: nor runs of so many words or more that repeat."""
    none = F.array().cast("array<struct<a:int,b:int>>")
    found = _written_spans(docs, id_col, text_col, **options)
    if words:
        runs = _written_spans(docs, id_col, text_col, length=words * CODE, words=True).withColumnRenamed("spans", "runs")
        found = found.join(growing(runs), ["_id", "_key"], "full")
    else:
        found = found.withColumn("runs", none)
    rows = _with_spans(docs, found, id_col, text_col)

    @F.pandas_udf("string")
    def kept(data, found, runs):
        reader, out = Words(), []
        for d, f, r in zip(data, found, runs):
            own = [(s["a"], s["b"]) for s in f]
            if len(r):
                own += reader.places(d, [(s["a"], s["b"]) for s in r])
            out.append(_remaining(d, merged(own)).decode("utf-8", "ignore"))
        return type(data)(out, dtype=object)

    unchanged = F.col("_spans").isNull() & F.col("runs").isNull()
    left: Column = F.when(unchanged, F.col(text_col)).otherwise(kept("_data", F.coalesce("_spans", none), F.coalesce("runs", none)))
    return rows.withColumn(text_col, left).select(*docs.columns)
