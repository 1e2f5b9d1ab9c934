"""Trie of conversation prefixes, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of turns. It is known by its depth and a 127-bit polynomial hash over the SHA-256 of its turns; such hashes
compose, so a conversation of any length is hashed in blocks of ``BLOCK`` turns: what a block does to a hash is found
for each block by itself, and the blocks of a conversation are then chained.

Subtree sums (:func:`rollup`) take rounds that are logarithmic in the number of turns, however deep the trie is. The mass of a node is the
number of (conversation, depth) pairs at and below it, which one grouping gives. In each component the deepest node with at
least half the mass is its centroid. Removing it leaves the components of its children and the one above, each of at most
half the mass. The total of what lay at and below the centroid is its own sum, and is added to the nodes on its path to the
top of the component, which the rows of one of its conversations list; their mass falls by that of the centroid. Components of at
most ``BOUND`` nodes are split further in the same way inside one task.

Defined cases: rows without a conversation id belong to none and are left out; a null role or text counts as empty; turns
of equal number (null first) are ordered by the digest of role and text, so repeated rows are turns of their own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from voxloom.llm.text import whole
from voxloom.operators.scan import dense_index
from voxloom.session import stage

BLOCK = 4096  # turns of a conversation in one block
BOUND = 4096  # nodes of a component that one task takes
CHUNK = 8192  # ids in one piece of a list
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix").digest()[:16], "big") % PRIME
ROOT = b""
_ROWS = 8192


def _after(state: int, digest: bytes) -> int:
    return (state * BASE + int.from_bytes(digest, "big") + 1) % PRIME


def _node(depth: int, state: int) -> bytes:
    return depth.to_bytes(8, "big") + state.to_bytes(16, "big") if depth else ROOT


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)


# -- conversations -------------------------------------------------------------------------------


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, chars): the turns of every conversation in order, from 1, with a digest of role and text."""
    role, text = whole(F.col(role_col)), whole(F.col(text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("bigint").alias("chars")
    )
    return dense_index(rows, ["turn", "digest"], "pos", within=["conv"], start=1).select("conv", "pos", "digest", "chars")


def shared_starts(turns: DataFrame, family: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does: (conv, depth, digest, chars) and (conv, n_turns).

    Conversation c takes the first h turns of conversation c - c % ``family``, if it exists, and then its own after its first h; h is
    crc32(c) % (``most`` + 1). ``turns`` are :func:`numbered_turns`.
    """
    own = stage(turns, "trie-turns")
    sizes = stage(own.groupBy("conv").agg(F.max("pos").alias("n")), "trie-sizes")
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    wanted = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), heads.alias("h"))
    lent = sizes.select(F.col("conv").alias("base"), F.col("n").alias("lent"))
    plan = wanted.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0)))).select("conv", "base", "n", "h", "lent")
    plan = stage(plan, "trie-plan")
    first = own.where(F.col("pos") <= most).withColumnRenamed("conv", "base")
    begin = first.join(plan.select("conv", "base", "h"), "base").where(F.col("pos") <= F.col("h"))
    rest = own.join(plan.select("conv", "h", "lent"), "conv").where(F.col("pos") > F.col("h"))
    rows = begin.select("conv", F.col("pos").alias("depth"), "digest", "chars").unionByName(
        rest.select("conv", (F.col("lent") + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars")
    )
    lengths = plan.select("conv", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("bigint").alias("n_turns"))
    return stage(rows, "trie-rebuilt"), stage(lengths, "trie-lengths")


# -- nodes ---------------------------------------------------------------------------------------


def lineage(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, depth, node, parent, chars) of every conversation at every depth from the root."""
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / block).cast("bigint"))
    long = rows.join(lengths.where(F.col("n_turns") > block).select("conv"), "conv", "left_semi")
    step_schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("state", pa.binary())])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv, at), group in groupby(_rows_of(batches), key=lambda r: (r["conv"], r["block"])):
                n = state = 0
                for row in group:
                    n, state = n + 1, _after(state, row["digest"])
                yield conv, at, n, state.to_bytes(16, "big")

        return _batched(each(), step_schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv, group in groupby(_rows_of(batches), key=lambda r: r["conv"]):
                state = 0
                for row in group:
                    yield conv, row["block"], 0, state.to_bytes(16, "big")  # what the block begins with
                    state = (state * pow(BASE, row["n"], PRIME) + int.from_bytes(row["state"], "big")) % PRIME

        return _batched(each(), step_schema)

    kinds = "conv bigint, block bigint, n bigint, state binary"
    ordered = long.select("conv", "block", "depth", "digest").repartition("conv", "block").sortWithinPartitions("conv", "block", "depth")
    inner = stage(ordered.mapInArrow(steps, kinds), "trie-steps")
    begins = stage(inner.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(chain, kinds), "trie-begins")

    node_schema = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, group in groupby(_rows_of(batches), key=lambda r: (r["conv"], r["block"])):
                state = 0
                for row in group:
                    if row["depth"] is None:
                        state = int.from_bytes(row["state"], "big")
                        continue
                    above, state = state, _after(state, row["digest"])
                    depth = row["depth"]
                    yield row["conv"], depth, _node(depth, state), _node(depth - 1, above), row["chars"]

        return _batched(each(), node_schema)

    marked = rows.unionByName(begins.select("conv", "block", "state"), allowMissingColumns=True)
    marked = marked.repartition("conv", "block").sortWithinPartitions("conv", "block", "depth")
    below = marked.mapInArrow(walk, "conv bigint, depth bigint, node binary, parent binary, chars bigint")
    tops = lengths.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("chars"))
    return stage(below.unionByName(tops), "trie-lineage")


def nodes_of(lines: DataFrame, lengths: DataFrame) -> DataFrame:
    """(node, parent, depth, rep, n_convs, chars, mass, n_children) of every node; ``rep`` is its smallest conversation."""
    below = (F.col("n_turns") - F.col("depth") + 1).alias("below")
    found = lines.join(lengths, "conv").select("node", "parent", "depth", "conv", "chars", below).groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("rep"), F.count("*").alias("n_convs"),
        F.max("chars").alias("chars"), F.sum("below").alias("mass"),
    )
    found = stage(found, "trie-nodes")
    children = found.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return stage(found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "trie-nodes")


# -- subtree sums --------------------------------------------------------------------------------


def split_component(top: int, parent: list[int], children: list[list[int]], mass: list[int], weights: list[list[int]]) -> list[list[int]]:
    """Subtree sums of each weight of a component in memory, by its centroids."""
    sums = [[0] * len(w) for w in weights]
    tops = [top]
    while tops:
        top = tops.pop()
        total, centroid = mass[top], top
        while True:
            heavy = next((x for x in children[centroid] if 2 * mass[x] >= total), None)
            if heavy is None:
                break
            centroid = heavy
        inside, reach = [centroid], 0
        while reach < len(inside):
            inside += children[inside[reach]]
            reach += 1
        path, at = [centroid], centroid
        while at != top:
            at = parent[at]
            path.append(at)
        for own, weight in zip(sums, weights):
            found = sum(weight[x] for x in inside)
            for x in path:
                own[x] += found
        for x in path[1:]:
            mass[x] -= mass[centroid]
        if centroid != top:
            children[parent[centroid]].remove(centroid)
            tops.append(top)
        tops += children[centroid]
        children[centroid] = []
    return sums


def rollup(nodes: DataFrame, lines: DataFrame, weights: Sequence[str], bound: int = BOUND) -> DataFrame:
    """(node, *weights): the sum of each weight over the subtree of every node.

    ``nodes(node, parent, depth, rep, mass, *weights)`` is one tree from ``ROOT``; ``lines(conv, depth, node, parent)`` lists the
    nodes above any node with ``conv`` = its ``rep``.
    """
    names = list(weights)
    sums = [f"sum_{w}" for w in names]
    active = nodes.select("node", "parent", "depth", "rep", "mass", *names, *[F.lit(0).cast("bigint").alias(s) for s in sums], F.lit(ROOT).alias("comp"))
    active = stage(active, "trie-active")
    held, done = [], []
    while True:
        shape = active.groupBy("comp").agg(F.count("*").alias("n"), F.max("mass").alias("total"), F.min("depth").alias("top"))
        shape = stage(shape, "trie-components")
        large = shape.where(F.col("n") > bound)
        held.append(active.join(shape.where(F.col("n") <= bound).select("comp"), "comp", "left_semi"))
        if large.isEmpty():
            break
        split = stage(active.join(large.select("comp", "total", "top"), "comp"), "trie-large")
        heavy = split.where(2 * F.col("mass") >= F.col("total"))
        chosen = heavy.groupBy("comp").agg(F.max_by(F.struct("node", "depth", "rep", "mass", "top"), "depth").alias("c"))
        chosen = stage(chosen.select("comp", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "depth", "rep", "mass", "top")]), "trie-centroids")
        # Where a node lies: under which child of the centroid, or above.
        placed = split.drop("total", "top").join(chosen, "comp")
        beside = placed.where(F.col("depth") <= F.col("c_depth")).withColumns({"child": F.lit(None).cast("binary")})
        deeper = placed.where(F.col("depth") > F.col("c_depth")).join(
            lines.select(F.col("conv").alias("rep"), (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("x"), F.col("parent").alias("over")),
            ["rep", "c_depth"],
        )
        under = F.when(F.col("over") == F.col("c_node"), F.col("x"))
        deeper = deeper.withColumn("child", under).drop("x", "over")
        placed = stage(beside.unionByName(deeper.select(*beside.columns)), "trie-placed")
        centre = F.col("node") == F.col("c_node")
        totals = placed.where(centre | F.col("child").isNotNull()).groupBy("comp").agg(*[F.sum(w).alias(f"t_{w}") for w in names])
        totals = stage(chosen.join(totals, "comp"), "trie-totals")
        adds = totals.join(lines.select(F.col("conv").alias("c_rep"), "depth", "node"), "c_rep").where(
            (F.col("depth") < F.col("c_depth")) & (F.col("depth") >= F.col("c_top"))
        ).select("node", F.col("c_mass").alias("less"), *[f"t_{w}" for w in names])
        own = placed.where(centre).select("node", "comp", *sums).join(totals.select("comp", *[f"t_{w}" for w in names]), "comp")
        done.append(own.select("node", *[(F.col(s) + F.col(f"t_{w}")).alias(w) for s, w in zip(sums, names)]))
        rest = placed.where(~centre).join(adds, "node", "left")
        added = [(F.col(s) + F.coalesce(f"t_{w}", F.lit(0))).alias(s) for s, w in zip(sums, names)]
        mass = (F.col("mass") - F.coalesce("less", F.lit(0))).alias("mass")
        active = stage(
            rest.select("node", "parent", "depth", "rep", mass, *names, *added, F.coalesce("child", "comp").alias("comp")), "trie-active"
        )

    small = held[0]
    for more in held[1:]:
        small = small.unionByName(more)
    schema = pa.schema([("node", pa.binary()), *[(w, pa.int64()) for w in names]])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, group in groupby(_rows_of(batches), key=lambda r: r["comp"]):
                rows = list(group)  # at most ``bound`` nodes, the top first
                at = {r["node"]: i for i, r in enumerate(rows)}
                parent = [at.get(r["parent"], -1) for r in rows]
                children: list[list[int]] = [[] for _ in rows]
                for i, p in enumerate(parent):
                    if p >= 0:
                        children[p].append(i)
                found = split_component(0, parent, children, [r["mass"] for r in rows], [[r[w] for r in rows] for w in names])
                for i, r in enumerate(rows):
                    yield r["node"], *[r[s] + own[i] for s, own in zip(sums, found)]

        return _batched(each(), schema)

    kinds = ", ".join(["node binary", *[f"{w} bigint" for w in names]])
    out = small.repartition("comp").sortWithinPartitions("comp", "depth").mapInArrow(inside, kinds)
    for rows in done:
        out = out.unionByName(rows)
    return stage(out, "trie-sums")


def joined_ids(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, ends_sha256) of ``rows(node, conv)``: SHA-256 of the ids of each node, ascending, with commas between.

    Pieces of lists are written where range partitioning puts their ids; the hash of a node then reads these few pieces in order.
    """
    piece_schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    hash_schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for node, group in groupby(_rows_of(batches), key=lambda r: r["node"]):
                ids: list[int] = []
                for row in group:
                    ids.append(row["conv"])
                    if len(ids) == chunk:
                        yield node, ids[0], ",".join(map(str, ids))
                        ids = []
                if ids:
                    yield node, ids[0], ",".join(map(str, ids))

        return _batched(each(), piece_schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for node, group in groupby(_rows_of(batches), key=lambda r: r["node"]):
                state, comma = hashlib.sha256(), b""
                for row in group:
                    state.update(comma + row["ids"].encode())
                    comma = b","
                yield node, state.hexdigest()

        return _batched(each(), hash_schema)

    listed = rows.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pieces, "node binary, first bigint, ids string")
    return listed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashes, "node binary, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK, bound: int = BOUND) -> DataFrame:
    """One row per node of ``turns(conv, depth, digest, chars)``, whose ``lengths(conv, n_turns)`` list every conversation.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    lines = lineage(turns, lengths, block)
    nodes = nodes_of(lines, lengths)
    weighted = nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars"),
    })
    sums = rollup(weighted, lines, ["n_leaves", "saved_tokens"], bound)
    last = lines.join(lengths, "conv").where(F.col("depth") == F.col("n_turns")).select("node", "conv")
    ends = stage(joined_ids(last), "trie-ends")
    above = nodes.select(F.col("node").alias("parent"), F.col("rep").alias("parent_conv_id"))
    return (
        nodes.join(sums, "node").join(ends, "node", "left").join(above, "parent", "left").select(
            F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def conversations_trie(conversations: DataFrame, block: int = BLOCK, bound: int = BOUND) -> DataFrame:
    """The trie of conversations that begin as the first of their hundred does."""
    return trie(*shared_starts(numbered_turns(conversations)), block, bound)
