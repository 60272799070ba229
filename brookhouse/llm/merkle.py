"""A Merkle manifest of a dataset, built by appending leaves whose witnesses grow with the trees.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group form a tree, and the roots of the groups form one tree
above. A witness is the list of siblings that folds a leaf into the root, so any row can be proven without the others.

1. Leaves are hashed where they are read and get their place in the group from ranges (llm.order), not from one task per group.
2. Each aligned block of 1024 leaves is a stream of appends. A new leaf is an open subtree of one; two open subtrees of equal
   height close into one. The partial witnesses of the members of either side are extended by the root of the other. At the
   end of the tree, lonely subtrees are raised level by level.
3. The roots of the blocks are appended to the next layer in the same way, 1024 at a time, until one root is left: a hundred
   million rows have three layers. A leaf's witness is that of its place in its block, then that of its block, and so on up.

So a task holds one block of at most 1024 witnesses, however large a group is.

Fields and nodes are hashed as the text of the contract: see `leaf` and `H`. Digests travel as 32 bytes.

Defined results: a null field is '-'; a null group is a group of its own, the first one; rows with a null key are first in
their group; rows with equal keys are ordered by their leaf, and equal rows each have a leaf, in any order; an empty table gives an
empty table; extra columns are left alone (columns named like the results are replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .order import in_order

BLOCK_BITS = 10
RESULTS = ("leaf", "subroot", "root", "witness", "turns", "proof")
DIGESTS = pa.list_(pa.binary())


def H(*digests: bytes) -> bytes:
    """SHA-256 over digests as lowercase hex text, concatenated."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf(*fields: Column) -> Column:
    """The digest of a row: of each field '-' if null, else its UTF-8 byte count, ':' and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


class Forest:
    """Open subtrees of one block, smallest last, with the partial witnesses of their members."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, list[list[bytes | None]]]] = []
        self.witnesses: list[list[bytes | None]] = []

    def append(self, digest: bytes) -> None:
        witness: list[bytes | None] = []
        self.witnesses.append(witness)
        self._close(0, digest, [witness])

    def _close(self, height: int, digest: bytes, members: list[list[bytes | None]]) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, earlier = self.open.pop()
            for w in earlier:
                w.append(digest)
            for w in members:
                w.append(left)
            digest, members, height = H(left, digest), earlier + members, height + 1
        self.open.append((height, digest, members))

    def finish(self, height: int) -> bytes:
        """Raise lonely subtrees until one of the given height is left; its root."""
        while len(self.open) > 1 or self.open[0][0] < height:
            level, digest, members = self.open.pop()
            for w in members:
                w.append(None)
            self._close(level + 1, H(digest), members)
        return self.open[0][1]


def _layer(nodes: DataFrame, label: str) -> DataFrame:
    """Append every block of `nodes` (tree, n, pos, digest): the same rows with `witness` inside the block and its `top`."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, forest = None, [], Forest()

        def finished() -> pa.RecordBatch:
            n = rows[0][1]
            # A block of a larger tree is raised to the full height of a block; a tree of one block ends at one node.
            height = BLOCK_BITS if n > 1 << BLOCK_BITS else (n - 1).bit_length()
            top = forest.finish(height)
            tree, sizes, places, digests = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.string()), pa.array(sizes, pa.int64()), pa.array(places, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(forest.witnesses, DIGESTS), pa.array([top] * len(rows), pa.binary())],
                ["tree", "n", "pos", "digest", "witness", "top"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("tree", "n", "pos", "digest")], strict=True):
                here = row[0], row[2] >> BLOCK_BITS
                if here != block and rows:
                    yield finished()
                    rows, forest = [], Forest()
                block = here
                rows.append(row)
                forest.append(row[3])
        if rows:
            yield finished()

    block = F.shiftright("pos", BLOCK_BITS)
    streams = nodes.select("tree", "n", "pos", "digest").repartition(F.col("tree"), block).sortWithinPartitions("tree", "pos")
    return stored(streams.mapInArrow(grow, "tree string, n bigint, pos bigint, digest binary, witness array<binary>, top binary"), label)


def grow_trees(nodes: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """Trees over `nodes` (tree, n nodes in the tree, pos, digest): the nodes with their whole `witness`, and each tree's `root`.

    `largest` is the greatest n.
    """
    layers = [_layer(nodes, "appended")]
    while largest > 1 << BLOCK_BITS:
        largest = -(-largest >> BLOCK_BITS)
        below = layers[-1].filter(F.col("pos").bitwiseAND((1 << BLOCK_BITS) - 1) == 0)
        # A tree that already is one root has no further layer.
        blocks = below.filter(F.col("n") > 1 << BLOCK_BITS).select(
            "tree", F.shiftright(F.col("n") + ((1 << BLOCK_BITS) - 1), BLOCK_BITS).alias("n"),
            F.shiftright("pos", BLOCK_BITS).alias("pos"), F.col("top").alias("digest"))
        layers.append(_layer(blocks, "appended"))
    # From the top layer down, blocks hand their witness and the root to their members.
    whole = layers[-1].withColumn("root", F.when(F.col("n") <= 1 << BLOCK_BITS, F.col("top")))
    for lower in reversed(layers[:-1]):
        upper = whole.select("tree", F.col("pos").alias("block"), F.col("witness").alias("above"), F.col("root").alias("over"))
        joined = lower.withColumn("block", F.shiftright("pos", BLOCK_BITS)).join(upper, ["tree", "block"], "left")
        whole = joined.select(
            "tree", "n", "pos", "digest", F.concat("witness", F.coalesce("above", F.array().cast("array<binary>"))).alias("witness"),
            "top", F.coalesce("over", "top").alias("root"))
    return whole.select("tree", "pos", "digest", "witness", "root"), whole.filter("pos = 0").select("tree", "root")


def manifest(frame: DataFrame, group: str, key: str, fields: list[str], carry: list[str] | None = None) -> DataFrame:
    """The rows of `frame` with leaf, subroot, root (binary), witness, turns and proof.

    `witness` holds the siblings up to the root, null where a node has none; bit i of `turns` is set if sibling i stands left.
    `proof` is the SHA-256 over the siblings that exist. `carry` names the columns to return, all by default; texts that are
    only hashed need not travel.
    """
    kept = [c for c in (frame.columns if carry is None else carry) if c not in RESULTS]
    leaves = stored(frame.select(
        F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"), F.col(key).alias("key"),
        leaf(*[F.col(c) for c in fields]).alias("digest"), F.monotonically_increasing_id().alias("copy")), "leaves")
    placed = in_order(leaves, "tree", [F.col("key"), F.col("digest"), F.col("copy")], "placed")
    sizes = stored(leaves.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    nodes, subroots = grow_trees(placed.join(sizes, "tree"), largest)

    subroots = stored(subroots.select(F.lit("").alias("one"), F.col("tree").alias("name"), F.col("root").alias("digest")), "subroots")
    n_groups = subroots.count()
    ordered = in_order(subroots, "one", [F.col("name")], "groups").withColumn("n", F.lit(n_groups).cast("bigint"))
    tops, _ = grow_trees(ordered.withColumnRenamed("one", "tree"), n_groups)
    tops = ordered.select("name", "pos", F.col("digest").alias("subroot")).join(tops.select("pos", "witness", "root"), "pos")
    tops = tops.select(F.col("name").alias("tree"), F.col("pos").alias("turn"), F.col("witness").alias("last"), "root", "subroot")

    out = placed.select("row", "tree", "pos").join(nodes.select("tree", "pos", "digest", "witness"), ["tree", "pos"]).join(tops, "tree")
    return out.select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("digest").alias("leaf"), "subroot", "root",
        F.concat("witness", "last").alias("witness"), F.expr("shiftleft(turn, size(witness)) | pos").alias("turns"),
        proof(F.concat("witness", "last")).alias("proof"))


def proof(witness: Column) -> Column:
    """The SHA-256 of the siblings of a witness, as hex text, from the leaf upwards."""
    return F.unhex(F.sha2(F.array_join(F.transform(F.filter(witness, lambda d: d.isNotNull()), lambda d: F.lower(F.hex(d))), "").cast("binary"), 256))


def fold(frame: DataFrame, leaf: str, into: str = "folded") -> DataFrame:
    """The root that the digest in `leaf` gives with the witness of its row, as a binary column `into`."""
    kept = [f for f in frame.schema.fields if f.name != into]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for digest, witness, turns in zip(*[batch.column(c).to_pylist() for c in (leaf, "witness", "turns")], strict=True):
                for level, sibling in enumerate(witness):
                    if sibling is None:
                        digest = H(digest)
                    else:
                        digest = H(sibling, digest) if turns >> level & 1 else H(digest, sibling)
                roots.append(digest)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(roots, pa.binary())], [*names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return frame.mapInArrow(run, f"{schema}, `{into}` binary")
