"""Merkle manifest of a corpus as a tree of SHA-256 midstates, built and folded in blocks.

Leaves are digests in a dense order within their group. Every ``FAN`` consecutive nodes become one, until a group has one
node, its subroot; the subroots, in the order of their groups, become the root in the same way. A parent keeps a copy of its hash
state before each child slot. A fold then takes up the state of the matching slot with the replaced child and reads only the
siblings to its right, and so on to the root.

``FAN ** height`` consecutive nodes of a group are one block, of any group however hot, and a task holds one block at a time. A
block grows ``height`` levels; block tops are the nodes of the next round, so a group of n leaves takes log(n) / (height * log(FAN)) rounds.
On the way down each block is told what stands beside its top on every level to the root, so that its leaves are folded where
they are. Hash states are not moved between tasks: a task makes those of its own block, and those above it from the left siblings.

Defined cases: a null field is ``-``; a null id sorts first and is never tampered with; a null group is a group and
sorts first; rows that repeat an id sort by their leaf and have a place each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from voxloom.functions.arrays import bind
from voxloom.llm.text import same
from voxloom.operators.scan import dense_index
from voxloom.session import stage

FAN = 3
HEIGHT = 6  # levels that a task grows at once
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROWS = 4096  # rows of an output batch


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    return bind(value.cast("string"), lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """A text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit(""))


# -- inside a task -------------------------------------------------------------------------------


def grow(digests: list[bytes], levels: int) -> tuple[list[list[bytes]], list[list]]:
    """Nodes of each level, and for each node below the top the state of its parent before its slot."""
    nodes, slots = [digests], []
    for _ in range(levels):
        own, above = [], []
        for first in range(0, len(nodes[-1]), FAN):
            state = hashlib.sha256()
            for child in nodes[-1][first : first + FAN]:
                own.append(state.copy())
                state.update(child)
            above.append(state.hexdigest().encode())
        slots.append(own)
        nodes.append(above)
    return nodes, slots


def siblings(nodes: list[list[bytes]], levels: int, place: int) -> Iterator[tuple[bytes, bytes]]:
    """On each level the joined digests left and right of the node above ``place`` in its run."""
    for level in range(levels):
        first = place - place % FAN
        run = nodes[level]
        yield b"".join(run[first:place]), b"".join(run[place + 1 : first + FAN])
        place //= FAN


def resume(steps, digest: bytes) -> bytes:
    """Fold ``digest`` upwards: ``steps`` are (state before its slot, digests to its right) of each level."""
    for state, right in steps:
        folded = state.copy()
        folded.update(digest)
        folded.update(right)
        digest = folded.hexdigest().encode()
    return digest


def levels_of(count: int, height: int) -> int:
    """Levels that a block of a tree with ``count`` nodes grows."""
    levels = 0
    while count > 1 and levels < height:
        count, levels = -(-count // FAN), levels + 1
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """(marker, rows) of each block; the rows of a task are sorted by tree, block and place, the marker first."""
    marker, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["pos"] is None:
                if marker is not None:
                    yield marker, rows
                marker, rows = row, []
            else:
                rows.append(row)
    if marker is not None:
        yield marker, rows


def _each_block(
    rows: DataFrame, markers: DataFrame, use: Callable[[dict, list[dict]], list[tuple]], schema: str
) -> DataFrame:
    """``use(marker, rows)`` of every block; ``markers`` hold (tree, block) and what the block has to know."""
    dealt = rows.unionByName(markers, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    names = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for marker, block in _blocks(batches):
            held += use(marker, block)
            if len(held) >= _ROWS:
                yield pa.record_batch([list(c) for c in zip(*held)], schema=arrow)
                held = []
        if held:
            yield pa.record_batch([list(c) for c in zip(*held)], schema=arrow)

    return dealt.mapInArrow(run, names)


# -- the tree ------------------------------------------------------------------------------------


def _block_of(rows: DataFrame, height: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / FAN**height).cast("bigint"))


def _rounds(nodes: DataFrame, counts: DataFrame, height: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Grow every tree to one node: the nodes (tree, pos, digest) of each round, the counts (tree, n) of each round, and the tops.

    ``counts`` has the number of nodes of every tree. A tree ends in the round in which it is one block.
    """
    size = FAN**height
    levels, sizes, tops = [nodes], [counts], []

    def top(marker: dict, rows: list[dict]) -> list[tuple]:
        grown, _ = grow([r["digest"].encode() for r in rows], levels_of(marker["n"], height))
        return [(marker["tree"], marker["block"], grown[-1][0].decode())]

    while True:
        nodes, counts = levels[-1], sizes[-1]
        plain = _block_of(nodes.select("tree", "pos", "digest"), height)
        up = stage(_each_block(plain, _block_markers(counts, height), top, "tree string, pos bigint, digest string"), "merkle-nodes")
        last = counts.where(F.col("n") <= size).select("tree")
        tops.append(up.join(last, "tree", "left_semi").select("tree", "digest"))
        rest = counts.where(F.col("n") > size).select("tree", F.ceil(F.col("n") / size).cast("bigint").alias("n"))
        if rest.isEmpty():
            break
        sizes.append(stage(rest, "merkle-counts"))
        levels.append(up.join(rest.select("tree"), "tree", "left_semi"))
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return levels, sizes, stage(found, "merkle-tops")


def _block_markers(counts: DataFrame, height: int) -> DataFrame:
    last = F.floor((F.col("n") - 1) / FAN**height).cast("bigint")
    return counts.select("tree", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"), "n")


def _paths(levels: list[DataFrame], sizes: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """(tree, block, n, path) of the blocks of the first round.

    ``above`` (tree, path) is what stands beside the top of each tree; a path alternates the digests left and right of
    a node, from its own level to the root.
    """

    def down(marker: dict, rows: list[dict]) -> list[tuple]:
        levels = levels_of(marker["n"], height)
        nodes, _ = grow([r["digest"].encode() for r in rows], levels)
        above = marker["path"]
        return [
            (marker["tree"], r["pos"], [s.decode() for pair in siblings(nodes, levels, i) for s in pair] + above)
            for i, r in enumerate(rows)
        ]

    size, known = FAN**height, None
    for nodes, counts in zip(reversed(levels), reversed(sizes)):
        ends = counts.where(F.col("n") <= size).join(above, "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "n", "path")
        if known is not None:
            inner = known.withColumnRenamed("pos", "block").join(counts.where(F.col("n") > size), "tree")
            ends = ends.unionByName(inner.select("tree", "block", "n", "path"))
        if nodes is levels[0]:
            return ends
        plain = _block_of(nodes.select("tree", "pos", "digest"), height)
        known = stage(_each_block(plain, ends, down, "tree string, pos bigint, path array<string>"), "merkle-paths")
    raise AssertionError("a tree has at least one round")


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Verify every leaf of ``leaves(tree, id, leaf, altered)`` against the root of all.

    ``tree`` is a :func:`group_key`, ``altered`` the digest of what the row holds now, null where it is untouched.
    Returns id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    placed = stage(dense_index(leaves, ["id", "leaf"], "pos", within=["tree"]), "merkle-leaves")
    counts = stage(placed.groupBy("tree").agg(F.count("*").alias("n")), "merkle-counts")
    nodes = placed.select("tree", "pos", F.col("leaf").alias("digest"))
    levels, sizes, subroots = _rounds(nodes, counts, height)

    listed = stage(dense_index(subroots, ["tree"], "pos"), "merkle-subroots")
    forest = listed.select(F.lit("").alias("tree"), "pos", "digest")
    one = stage(forest.groupBy("tree").agg(F.count("*").alias("n")), "merkle-counts")
    top_levels, top_sizes, root = _rounds(forest, one, height)
    begin = root.select("tree", F.array().cast("array<string>").alias("path"))
    blocks = _paths(top_levels, top_sizes, begin, height)

    def beside(marker: dict, rows: list[dict]) -> list[tuple]:
        levels = levels_of(marker["n"], height)
        nodes, _ = grow([r["digest"].encode() for r in rows], levels)
        path = lambda i: [s.decode() for pair in siblings(nodes, levels, i) for s in pair]
        return [(r["pos"], path(i) + marker["path"]) for i, r in enumerate(rows)]

    beside_tops = stage(_each_block(_block_of(forest, height), blocks, beside, "pos bigint, path array<string>"), "merkle-paths")
    above = listed.select("tree", "pos").join(beside_tops, "pos").select("tree", "path")

    top_row = root.first()  # one digest; none for an empty table
    ends = _paths(levels, sizes, above, height).join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    ends = ends.withColumn("root", F.lit(top_row["digest"] if top_row else None).cast("string"))
    kind = placed.schema["id"].dataType.simpleString()

    def fold(marker: dict, rows: list[dict]) -> list[tuple]:
        levels = levels_of(marker["n"], height)
        nodes, slots = grow([r["leaf"].encode() for r in rows], levels)
        upper, path = [], [s.encode() for s in marker["path"]]
        for left, right in zip(path[::2], path[1::2]):
            upper.append((hashlib.sha256(left), right))
        rest = b"".join(path)
        found = []
        for place, row in enumerate(rows):
            steps, proof, at = [], hashlib.sha256(), place
            for level, (left, right) in enumerate(siblings(nodes, levels, place)):
                steps.append((slots[level][at], right))
                proof.update(left + right)
                at //= FAN
            proof.update(rest)
            folded = resume(steps + upper, (row["altered"] or row["leaf"]).encode()).decode()
            found.append((row["id"], row["leaf"], marker["subroot"], marker["root"], proof.hexdigest(), folded, folded == marker["root"]))
        return found

    rows = _block_of(placed.select("tree", "pos", "id", "leaf", "altered"), height)
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _each_block(rows, ends, fold, schema)


def document_leaves(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "source", now: dict[str, Column] | None = None, touched: Column | None = None
) -> DataFrame:
    """(tree, id, leaf, altered) of each row; the first field is its id.

    ``now`` replaces the values of some fields where ``touched`` holds, as in a copy of the corpus that has been tampered with.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    altered = F.lit(None).cast("string")
    if now:
        altered = F.when(touched, leaf_digest([now.get(c, F.col(c)) for c in fields]))
    return docs.select(group_key(F.col(group_col)).alias("tree"), F.col(fields[0]).alias("id"), leaf.alias("leaf"), altered.alias("altered"))


def lines_joined_audit(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``docs``, checked against a copy whose texts have lost their line ends where crc32(id) is even."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    joined = F.translate("text", "\n", "")
    return manifest(document_leaves(docs, now={"text": joined}, touched=same(even, F.lit(True))), height)
