"""Jaccard self-join of word-shingle sets by a token-group matrix.

Similar documents are put into groups, a group keeps the union of its members' tokens (its row of the token-group matrix), and
a query document can have a partner in a group only if enough of its tokens are in that union. So a query opens only
the groups whose bound reaches the threshold, and only there its exact similarity to the members is computed.

1. Documents with equal sets form a class; from here on a class is one document.
2. Signatures: the token space is cut into more parts than two similar sets can have differing tokens, so that at least one
   part is the same in both; the signature of a part is the hash of all its tokens. Sets with over about SAMPLED tokens
   do this on a fixed hash range of the token space. Small sets do it several times over. A pair at the threshold
   has no common signature with a chance below 1e-9. Sizes are cut into levels, and a set near the upper end of its level
   signs for the next one too, since its partners may be there.
3. Groups: a class belongs to the smallest class it shares a signature with, the leader.
4. All leaders are queries to their groups. A member that its leader links with has its place.
5. Members that their leader does not link with query their own group, and a class queries the other groups with which it
   shares a signature (of a pair of groups, the one with the larger number asks).
6. Links become components.

Groups are cut into blocks of at most BLOCK members with a union each, so no task holds a whole hot group; the queries of a group are cut likewise. A cell of a
block of queries and a block of members yields a spanning forest of its links, not its links. Members linked to their leader never
query their own group, so a group of thousands of near copies costs one look per member, not one per pair.

Equality of tokens, sets and parts is that of 64-bit hashes. Defined results: null, empty and word-less texts have no
shingles and link with nothing; equal rows link; null ids count as rows but are never the smallest; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .anchors import mixed
from .common import stored
from .components import components
from .shingles import shingles

PARTS = 48
BLOCK = 256
SHARD_ROWS = 4000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Signer:
    """Signatures of a token set for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        # Two sets with |x| + |y| tokens in all that reach the threshold differ in at most `differ` of them.
        self.differ = (den - num) / (den + num)
        self.sampled = PARTS / (2 * self.differ)

    def levels(self, n: int) -> list[int]:
        level = n.bit_length() - 1
        return [level, level + 1] if n * self.den >= self.num * 2 ** (level + 1) else [level]

    def sign(self, tokens: np.ndarray) -> np.ndarray:
        found = []
        for level in self.levels(len(tokens)):
            most = 2 ** (level + 1) - 1
            n_parts = min(PARTS, int(self.differ * 2 * most) + 1)
            use = tokens
            if most > self.sampled:
                use = tokens[tokens <= np.uint64(int((2 ** 64 - 1) * (self.sampled / most)))]
            if not len(use):
                continue
            for turn in range(PARTS // n_parts):
                spread = mixed(use * _A + np.uint64(turn + 1))
                part = ((spread >> np.uint64(33)) % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part = part[order]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                sums = np.add.reduceat(mixed(spread[order] ^ _B), first)
                label = np.uint64(level * 65536 + turn * 256) + part[first].astype(np.uint64)
                found.append(mixed(sums * _B + mixed(label * _A)))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def class_number(tokens: np.ndarray) -> int:
    return int(mixed(np.add.reduce(mixed(tokens * _B)) + np.uint64(len(tokens)) * _A).astype(np.int64)) if len(tokens) else 0


def linked(tokens: list[np.ndarray], queries: np.ndarray, members: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between queries and members of a block, both as places in `tokens`; queries open the block if its union allows."""
    if not len(queries) or not len(members):
        return []
    every = np.concatenate([tokens[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(tokens[m]) for m in members])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    union, begin = np.unique(every, return_index=True)
    end = np.append(begin[1:], len(every))
    sizes = np.array([len(tokens[m]) for m in members])
    found = []
    for q in queries:
        own = tokens[q]
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        at = at[union[at] == own]
        if len(at) * den < num * len(own):
            continue
        n = end[at] - begin[at]
        places = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[places], minlength=len(members))
        hit = np.flatnonzero(both * den >= num * (len(own) + sizes - both))
        found += [(int(q), int(members[i])) for i in hit if members[i] != q]
    return found


def _roots(n: int, links: list[tuple[int, int]]) -> np.ndarray:
    root = np.arange(n)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([top(i) for i in range(n)])


def _open_groups(queries: DataFrame, member: DataFrame, bodies: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b, g) between queries (q, g) and members (c, g, block, blocks), as a spanning forest per block."""
    # Queries are cut into blocks as well, so a cell holds at most about two blocks of texts.
    turns = queries.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("turns"))
    asked = queries.join(member.groupBy("g").agg(F.max("blocks").alias("blocks")), "g").join(turns, "g")
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int"))
    asked = asked.select(F.col("q").alias("c"), "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "turn", F.lit(1).alias("ask"))
    held = member.join(turns, "g").select("c", "g", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("ask"))
    cells = stored(asked.union(held), "cells")
    shards = max(1, -(-cells.count() // SHARD_ROWS))
    cells = cells.withColumn("shard", F.pmod(F.xxhash64("g", "block", "turn"), F.lit(shards))).join(bodies.hint("merge"), "c")

    def match(shard: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        out_a, out_b, out_g = [], [], []
        for (g, _, _), cell in shard.groupby(["g", "block", "turn"], sort=False):
            ids, where = np.unique(cell["c"].to_numpy(), return_inverse=True)
            text: dict[int, bytes] = dict(zip(where, cell["z"], strict=True))
            tokens = [shingles(unpack.decompress(text[i]), size) for i in range(len(ids))]
            ask = cell["ask"].to_numpy() == 1
            with np.errstate(over="ignore"):
                root = _roots(len(ids), linked(tokens, np.unique(where[ask]), np.unique(where[~ask]), num, den))
            moved = np.flatnonzero(root != np.arange(len(ids)))
            out_a.append(ids[moved])
            out_b.append(ids[root[moved]])
            out_g.append(np.full(len(moved), g, np.int64))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pd.DataFrame({"a": join(out_a), "b": join(out_b), "g": join(out_g)})

    return cells.groupBy("shard").applyInPandas(match, "a bigint, b bigint, g bigint")


def similar_groups(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, num: int = 85, den: int = 100,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, part, text_key), one row per document.

    `part` numbers the components (null without shingles); text_key is xxhash64 of the text.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("k"), body.alias("text"))
    signer = Signer(num, den)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, cs, sigs = [], [], []
            with np.errstate(over="ignore"):
                for t in batch.column("text").cast(pa.binary()).to_pylist():
                    tokens = shingles(t, size)
                    ns.append(len(tokens))
                    cs.append(class_number(tokens))
                    sigs.append(signer.sign(tokens).view(np.int64) if len(tokens) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("k"), pa.array(ns, pa.int64()), pa.array(cs, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "k", "n", "c", "sigs"])

    sets = stored(keyed.mapInArrow(scan, "doc_id bigint, k bigint, n bigint, c bigint, sigs array<bigint>"), "sets")
    signed = sets.select("c", F.explode("sigs").alias("s"))
    shared = signed.groupBy("s").agg(F.min("c").alias("leader"), F.max("c").alias("other")).filter("leader <> other")
    shared = stored(shared.select("s", "leader"), "signatures")
    # Joins with corpus-sized sides are sort-merge joins at every size (the hints), so a trial run on a sample
    # moves the same data per document as the whole corpus does, instead of broadcasting what only fits there.
    inside = stored(signed.join(shared.hint("merge"), "s").distinct(), "inside")

    group = inside.groupBy("c").agg(F.min("leader").alias("g"))
    sizes = group.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = group.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    member = stored(member, "groups")

    # The texts that matter, one per class: those of classes in groups, and of the leaders.
    ids = member.select("c").union(member.select("g")).distinct()
    one = sets.join(ids, "c", "left_semi").groupBy("c").agg(F.min("k").alias("k"))
    bodies = stored(_packed(keyed).join(stored(one, "texts").hint("merge"), "k").dropDuplicates(["c"]).select("c", "z"), "bodies")

    leaders = member.select(F.col("g").alias("q"), "g").distinct()
    first = stored(_open_groups(leaders, member, bodies, size, num, den), "links")
    # Within a block a leader is the only query, so each of its rows is a link with the leader.
    # It settles them in its own group only: a leader can be a member elsewhere, where its leader does not link with it.
    settled = first.select("a", "g").union(first.select("b", "g")).distinct().toDF("c", "g")
    loose = member.join(settled, ["c", "g"], "left_anti").filter("c <> g").select(F.col("c").alias("q"), "g")
    of_signature = inside.join(member.select("c", "g"), "c")
    around = of_signature.select("s", F.col("g").alias("h")).distinct()
    across = of_signature.join(around, "s").filter("h < g").select(F.col("c").alias("q"), F.col("h").alias("g"))
    queries = stored(loose.union(across).distinct(), "queries")
    second = _open_groups(queries, member, bodies, size, num, den)

    parts = components(first.union(second).select("a", "b"), "a", "b")
    lowest = sets.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("id"))
    named = lowest.join(parts, lowest["c"] == parts["node"], "left").select("c", "id", F.coalesce("component", "c").alias("p"))
    names = stored(named, "named")
    of_part = names.groupBy("p").agg(F.min("id").alias("component_id"))
    result = names.join(of_part, "p").select("c", "component_id", F.col("p").alias("part"))
    out = sets.select("doc_id", "k", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(result, "c", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "part", F.col("k").alias("text_key"))


def keep_one(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of `documents` that stay: of each component the one with the smallest id, and all without shingles.

    Of rows with one id the smallest text hash stays, and of equal rows one; a null id is larger than all others.
    """
    groups = stored(similar_groups(documents, text, doc_id, **how), "similar")
    ranked = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("text_key"))
    first = groups.filter("part is not null").groupBy("part").agg(F.min(ranked).alias("x"))
    twice = groups.filter("part is not null").groupBy("doc_id", "text_key").agg((F.count("*") > 1).alias("twice"))
    first = first.select("x.doc_id", "x.text_key").join(
        twice.select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k"), "twice"),
        F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_key") == F.col("_k"))).select("doc_id", "text_key", "twice")
    bare = groups.filter("part is null").select("doc_id", "text_key", F.lit(False).alias("twice")).distinct()
    stay = stored(first.union(bare).toDF("_id", "_key", "_twice"), "stay")
    key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    own = documents.select(F.struct("*").alias("_row"), F.col(doc_id).cast("bigint").alias("_own"), key.alias("_text"))
    found = own.join(stay, (F.col("_text") == F.col("_key")) & F.col("_own").eqNullSafe(F.col("_id")))
    single = found.filter("not _twice").select("_row")
    # Only rows that occur more than once are gathered to keep one of them.
    again = found.filter("_twice").dropDuplicates(["_key", "_id"]).select("_row")
    return single.union(again).select(*[F.col("_row")[c].alias(c) for c in documents.columns])


def _packed(keyed: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [press.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(z, pa.binary())], ["k", "z"])

    return keyed.select("k", "text").mapInArrow(pack, "k bigint, z binary")
