"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are folded into one with a count first. Each table cuts the space by `bits` random hyperplanes; vectors on
the same side of all of them share a bucket, and all pairs in a bucket are compared by their exact cosine in double
precision. The number of bits follows the largest label, so that a bucket holds about BUCKET vectors whatever the size
of the data; the number of tables then follows from `recall`, the chance that a pair with a cosine just at
the threshold shares at least one bucket (closer pairs have more).

A link that several tables find counts in the first of them only, which both ends can tell from their
signatures. So a bucket gives counts and a spanning forest, never its pairs. A bucket with more than
BLOCK vectors is cut into blocks that meet pairwise in cells of their own, so no task holds more than two blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different length do not link; equal rows link with each other; a null id comes
back with no link; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .components import components

BUCKET = 64
BLOCK = 1024
SHARD_ROWS = 20_000


def plan(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for a largest label of so many distinct vectors."""
    bits = max(1, min(30, round(math.log2(max(largest, 2) / BUCKET)) if largest > BUCKET else 1))
    same_side = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same_side ** bits)))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One number per vector and table."""
    planes = np.random.default_rng((seed, x.shape[1])).normal(size=(x.shape[1], tables * bits))
    sides = (x @ planes >= 0).reshape(len(x), tables, bits)
    return sides @ (1 << np.arange(bits, dtype=np.int64))


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row that it can reach."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        lower = np.where(reach, label, len(label)).min(1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = 0.93, recall: float = 0.9999, seed: int = 17,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(F.col("v"))
    # Two hashes, 96 bits, stand for a vector with its label.
    rows = rows.withColumn("k", F.when(usable, F.xxhash64("label", "v"))).withColumn("k2", F.hash("v", "label"))
    single = stored(
        rows.filter("k is not null").groupBy("k", "k2", "label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    keys = single.select("k", "k2", "id", "copies")

    largest = single.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold, recall)

    def hashed(batches):
        for batch in batches:
            if len(batch):
                size = batch["v"].map(len).to_numpy()
                for n in np.unique(size):
                    part = batch[size == n]
                    found = signatures(np.stack(part["v"].to_list()), bits, tables, seed)
                    yield pd.DataFrame({"id": part["id"], "label": part["label"], "size": int(n), "signatures": list(found)})

    signed = single.select("id", "label", "v").mapInPandas(hashed, "id bigint, label string, size int, signatures array<bigint>")
    bucket = stored(signed.select("id", F.xxhash64("label", "size").alias("group"), F.posexplode("signatures").alias("t", "s")), "buckets")
    # Buckets of one vector link nothing; large ones are dealt into blocks, every pair of blocks into a cell.
    sizes = bucket.groupBy("group", "t", "s").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "sizes")
    in_cells = bucket.join(sizes, ["group", "t", "s"])
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    in_cells = in_cells.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    total = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_ROWS))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    in_cells = in_cells.select(
        "id", "t", "mine", low.alias("low"), high.alias("high"), F.xxhash64("group", "t", "s", low, high).alias("cell"))
    in_cells = in_cells.withColumn("shard", F.pmod("cell", F.lit(shards)))
    in_cells = in_cells.join(single.select("id", "v", "copies"), "id")

    def compare(shard: pd.DataFrame) -> pd.DataFrame:
        out_id, out_n, out_root = [], [], []
        shard = shard.sort_values(["cell", "id"], kind="stable")
        cell = shard["cell"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        ids, copies, mine = shard["id"].to_numpy(), shard["copies"].to_numpy(), shard["mine"].to_numpy()
        ts, low, high, vs = shard["t"].to_numpy(), shard["low"].to_numpy(), shard["high"].to_numpy(), shard["v"].to_numpy()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            x = np.stack(vs[a:b])
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            linked = (x @ x.T) / np.outer(norm, norm) >= threshold
            np.fill_diagonal(linked, False)
            if low[a] != high[a]:
                linked &= mine[a:b][:, None] != mine[a:b][None, :]
            if not linked.any():
                continue
            root = _forest(linked)
            i, j = np.nonzero(linked)
            if ts[a]:
                known = signatures(x, bits, tables, seed)[:, :ts[a]]
                fresh = np.concatenate([
                    ~(known[i[p:p + 100_000]] == known[j[p:p + 100_000]]).any(1) for p in range(0, len(i), 100_000)])
                i, j = i[fresh], j[fresh]
            n = np.bincount(i, copies[a:b][j], b - a).astype(np.int64)
            use = (n > 0) | (root != np.arange(b - a))
            out_id.append(ids[a:b][use])
            out_n.append(n[use])
            out_root.append(ids[a:b][root[use]])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pd.DataFrame({"id": join(out_id), "n": join(out_n), "root": join(out_root)})

    found = stored(in_cells.groupBy("shard").applyInPandas(compare, "id bigint, n bigint, root bigint"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found, "id", "root").withColumnRenamed("node", "id")
    result = keys.join(counts, "id", "left").join(parts, "id", "left").select(
        "k", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "k", "k2").join(result, ["k", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
