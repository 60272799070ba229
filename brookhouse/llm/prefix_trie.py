"""The prefix trie of conversations: what sharing equal beginnings saves.

Conversations that begin with the same turns share a path of the trie. For every node: its members, children and leaves, the
code points saved below it by keeping each prefix once, and a digest of the conversations that end there.

1. Turns get their place in the conversation, and every prefix a 128-bit name: a running xor of hashes of (depth, role, text),
   made by ranges (llm.order), so no task holds a whole conversation.
2. Grouping by name gives the nodes, their members and their smallest member. Along a path without branches or ends both stay
   the same, so (smallest member, number of members) names a run of nodes. There are fewer than two runs per conversation,
   however long it is, and only runs go into the trie.
3. Runs with at most `shard_convs` members are light. The topmost light runs are the roots of treelets, which are dealt
   over shards together with the runs above them, the spine. So a shard holds some `shard_convs` conversations in all.
4. Each shard encodes its trie as balanced parentheses (llm.parens): findclose delimits the subtree of a run, the rank of leaf
   pairs counts its leaves, and cumulative arrays over depth-first order give its savings.
5. The spine is shared between shards. A spine run's own savings count in one of them, its owner; then the shards' sums are
   added up by run. Nodes take their values from their run and their place in it.

Defined results: turns ascend by turn (null first), then role and text; a null role or text is empty; rows without a conversation
id belong to no conversation and make no node; equal rows are turns of their own; an empty table has no node, not even a
root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold, stored
from .order import in_order
from .parens import encode

# Fixed by the contract: conversations of one hundred share the first turns of the first of them, fewer than HEADS.
FAMILY = 100
HEADS = 6
# Ranges are cut by the beginnings of role and text; the sort inside goes by the whole.
RANGE_CHARS = 64

NAME = ["depth", "run_a", "run_b"]
RUN = ["conv_id", "n_convs"]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation with its `length`; the rebuilt turns: conv_id, depth from 1, t1, t2, n code points, last)."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumns({
        "t1": F.xxhash64("role", "text"), "t2": F.xxhash64("text", F.lit(7), "role"), "n": F.length("text").cast("bigint"),
    })
    ranges = [F.col("turn"), F.substring("role", 1, RANGE_CHARS), F.substring("text", 1, RANGE_CHARS)]
    turns = in_order(
        turns, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], "turns", ranges=ranges, drop=("turn", "role", "text"))

    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = stored(own.select("conv_id", "own", family.alias("base"), fold(F.col("conv_id"), HEADS).alias("head")), "own")
    bases = own.filter("conv_id = base").select("base", F.col("own").alias("base_own"))
    taken = F.least(F.col("head"), F.coalesce("base_own", F.lit(0)))
    convs = own.join(bases, "base", "left").select(
        "conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))
    convs = stored(convs, "convs")

    kept = turns.join(convs.select("conv_id", "head", "taken", "length"), "conv_id").filter("pos >= head")
    kept = kept.select("conv_id", (F.col("taken") + F.col("pos") - F.col("head") + 1).alias("depth"), "t1", "t2", "n", "length")
    heads = turns.filter((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "taken", "length"), "base").filter("pos < taken")
    heads = heads.select("conv_id", (F.col("pos") + 1).alias("depth"), "t1", "t2", "n", "length")
    rows = kept.union(heads)
    return convs, rows.select("conv_id", "depth", "t1", "t2", "n", (F.col("depth") == F.col("length")).alias("last"))


def joined_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 over the conversations of each node (depth, run_a, run_b, conv_id), ascending and joined by commas.

    Ranges of (node, id) are sorted and written out as text in parallel; one task per node then hashes the pieces
    in order, as SHA-256 asks for, and holds one piece at a time.
    """
    parted = ends.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.column_stack([batch.column(c).to_numpy() for c in NAME])
            ids = batch.column("conv_id").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]).any(1)]))
            text = batch.column("conv_id").cast(pa.string()).to_pylist()
            pieces = [",".join(text[a:b]) for a, b in zip(begin, [*begin[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(name[begin, i]) for i in range(3)], pa.array(ids[begin]), pa.array(pieces)], [*NAME, "least", "piece"])

    names = "depth bigint, run_a bigint, run_b bigint"
    pieces = parted.select(*NAME, "conv_id").mapInArrow(write, f"{names}, least bigint, piece string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for *name, piece in zip(*[batch.column(c).to_pylist() for c in (*NAME, "piece")], strict=True):
                if name != node:
                    if node is not None:
                        done.append((*node, running.hexdigest()))
                    node, running = name, hashlib.sha256(piece.encode())
                else:
                    running.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip((*NAME, "ends_sha256"), d, strict=True)) for d in done])
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*NAME, "ends_sha256"), (*node, running.hexdigest()), strict=True))])

    sorted_pieces = pieces.repartition(*NAME).sortWithinPartitions(*NAME, "least")
    return sorted_pieces.mapInArrow(digest, f"{names}, ends_sha256 string")


def shard_sums(shard: pd.DataFrame) -> pd.DataFrame:
    """Leaves, savings and children of every run of one shard."""
    names = pd.MultiIndex.from_frame(shard[["conv_id", "n_convs"]])
    # The root has no parent; no run has 0 members, so nothing is found for it.
    above = names.get_indexer(pd.MultiIndex.from_frame(shard[["parent_id", "parent_n"]].fillna(0).astype(np.int64)))
    trie, order = encode(above)
    opens = trie.opens()
    closes = trie.find_close(opens)
    weight = np.concatenate([[0], np.cumsum(shard["weight"].to_numpy()[order])])
    inside = trie.opened[closes] - trie.opened[opens]
    at = np.arange(len(order))
    owned = shard["owned"].to_numpy()
    has_parent = above >= 0
    children = np.bincount(above[has_parent], owned[has_parent], len(shard))[order].astype(np.int64)
    return pd.DataFrame({
        "conv_id": shard["conv_id"].to_numpy()[order], "n_convs": shard["n_convs"].to_numpy()[order],
        "n_leaves": trie.leaves[closes] - trie.leaves[opens], "saved": weight[at + inside] - weight[at], "children": children,
    })


def prefix_trie(conversations: DataFrame, shard_convs: int = 20_000) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = rebuilt(conversations)
    rows = rows.select("conv_id", "depth", F.xxhash64("t1", "t2", "depth").alias("a"), F.xxhash64("depth", "t2", F.lit(3), "t1").alias("b"), "n", "last")
    paths = in_order(rows, "conv_id", [F.col("depth")], "paths", add=("n",), xor=("a", "b")).drop("pos")

    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    up = [(F.col("depth") - 1).alias("up_depth"), F.col("run_a").bitwiseXOR(F.col("a")).alias("up_a"), F.col("run_b").bitwiseXOR(F.col("b")).alias("up_b")]
    nodes = paths.groupBy(*NAME, *up, "n", "run_n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    spark = conversations.sparkSession
    root = spark.createDataFrame([(0, 0, 0, None, None, None, 0, 0, total["least"], total["n"])] if total["n"] else [], nodes.schema)
    nodes = stored(nodes.union(root), "nodes")
    ends = paths.filter("last").select(*NAME, "conv_id").union(
        convs.filter("length = 0").select(*[F.lit(0).cast("bigint").alias(c) for c in NAME], "conv_id"))
    digests = joined_digests(ends)

    runs = nodes.groupBy(*RUN).agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("n").alias("chars"),
        F.min_by(F.struct("up_depth", "up_a", "up_b", (F.col("run_n") - F.col("n")).alias("before")), "depth").alias("up"))
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("run_a").alias("up_a"), F.col("run_b").alias("up_b"),
                           F.col("conv_id").alias("parent_id"), F.col("n_convs").alias("parent_n"))
    runs = stored(runs.select(*RUN, "top", "bottom", "chars", "up.*"), "chains").join(parents, ["up_depth", "up_a", "up_b"], "left")
    weight = (F.col("n_convs") - 1) * F.col("chars")
    runs = stored(runs.select(*RUN, "top", "bottom", "before", "parent_id", "parent_n", weight.alias("weight")), "runs")

    if total["n"] <= shard_convs:
        shards = runs.select(F.lit(0).cast("bigint").alias("shard"), *RUN, "parent_id", "parent_n", "weight", F.lit(True).alias("owned"))
    else:
        shards = _shards(paths, nodes, runs, total["least"], total["n"], shard_convs)
    sums = shards.groupBy("shard").applyInPandas(shard_sums, "conv_id bigint, n_convs bigint, n_leaves bigint, saved bigint, children bigint")
    merged = sums.groupBy(*RUN).agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved", "children")])
    runs = stored(runs.join(merged, RUN), "merged")

    nodes = nodes.select(*NAME, "conv_id", "n_convs", (F.col("run_n") - F.col("n")).alias("above")).join(runs, RUN)
    inner = F.col("depth") < F.col("bottom")
    nodes = nodes.select(
        *NAME, "conv_id", "n_convs", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent_id")).alias("parent_conv_id"),
        F.when(inner, 1).otherwise(F.col("children")).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("above") - F.col("before"))).alias("saved_tokens"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(digests, NAME, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def _shards(paths: DataFrame, nodes: DataFrame, runs: DataFrame, least: int, n_convs: int, shard_convs: int) -> DataFrame:
    """Runs by shard: every light run in the shard of its treelet, every spine run in all shards that hold runs below it."""
    n_shards = -(-n_convs // shard_convs)

    def dealt(*key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(n_shards))

    heavy = stored(nodes.filter(F.col("n_convs") > shard_convs).select(*NAME, F.col("conv_id").alias("run_id"), F.col("n_convs").alias("run_n_convs")), "heavy")
    marked = stored(paths.select("conv_id", *NAME).join(heavy, NAME, "left"), "marked")
    # The first light node of a path is the root of its treelet.
    light = marked.filter(F.col("run_id").isNull()).groupBy("conv_id").agg(F.min_by(F.struct(*NAME), "depth").alias("name"))
    light = light.select("conv_id", dealt("name.depth", "name.run_a", "name.run_b").alias("shard"))
    # A heavy run without children is a leaf that only its members' own paths lead to; the smallest one's stands for it.
    inner = runs.select(F.col("parent_id").alias("conv_id"), F.col("parent_n").alias("n_convs")).filter("conv_id is not null").distinct()
    leaves = runs.filter(F.col("n_convs") > shard_convs).join(inner, RUN, "left_anti").select("conv_id", dealt("conv_id").alias("shard"))
    home = stored(light.union(leaves), "home")

    below = runs.filter(F.col("n_convs") <= shard_convs).join(home, "conv_id").select("shard", *RUN, "parent_id", "parent_n", "weight", F.lit(True).alias("owned"))
    spine = marked.filter(F.col("run_id").isNotNull()).join(home, "conv_id").select("shard", F.col("run_id").alias("conv_id"), F.col("run_n_convs").alias("n_convs"))
    # The root is above everything; conversations have no row for it.
    spine = spine.union(home.select("shard").distinct().select("shard", F.lit(least).cast("bigint").alias("conv_id"), F.lit(n_convs).cast("bigint").alias("n_convs")))
    spine = stored(spine.distinct(), "spine")
    owner = spine.groupBy(*RUN).agg(F.min("shard").alias("owner"))
    spine = spine.join(owner, RUN).join(runs, RUN)
    owned = F.col("shard") == F.col("owner")
    spine = spine.select("shard", *RUN, "parent_id", "parent_n", F.when(owned, F.col("weight")).otherwise(0).alias("weight"), owned.alias("owned"))
    return below.union(spine)
