"""Exact removal of byte strings that occur elsewhere, by sorted suffixes.

Every byte covered by a string of `length` bytes that also starts at another place, of the same document or another, is
removed. All strings are judged on the input.

Sorting every suffix of a corpus would move each byte hundreds of times. Equal strings share their anchors
(llm.anchors), so only suffixes near anchors that occur twice can matter:

1. Each task lists the anchors of its documents: the hash of the leading `gram` bytes, and the hash of the context, which
   holds every string of `length` bytes that spans the anchor. Anchors whose leading hash is unique in the corpus end here.
2. A context that occurs twice as a whole needs no sorting: all its strings are repeated.
3. Where one leading hash has different contexts, one copy of each context is fetched. The suffixes that start in these
   contexts are range-partitioned by their leading token, between splitters taken from a sample. Equal leading tokens
   never straddle a splitter, so neighbours across a boundary cannot be equal. Each bucket sorts its suffixes by multikey
   quicksort, once for each distance between the start of a suffix and its anchor, and a suffix that equals a neighbour
   over `length` bytes is repeated. Bytes beside the anchor are compared as 64-bit tokens of whole stretches.
4. A leading token with more than `group_limit` contexts would fill a bucket on its own. Its suffixes are dealt out and
   counted by their hash instead, with the same result.
5. The repeated strings around an anchor cover one stretch; the stretches of a document are merged and cut out.

Equality is that of 64-bit hashes. Defined results: a null text is empty; texts shorter than `length` bytes stay as
they are; equal rows repeat each other; a stretch that overlaps its own repetition goes as a whole; null ids and
other columns come back untouched (`deduped` is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .anchors import anchors
from .common import stored

SMALL = 2048
BUCKET_ROWS = 20_000
SAMPLE = 4000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
# Bytes of UTF-8 that continue a code point.
_INSIDE = bytes(range(0x80, 0xC0))


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of a token matrix: three-way partitions by one token at a time, small ranges by a library sort."""
    order = np.arange(len(tokens))
    depth_of = tokens.shape[1]
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == depth_of:
            continue
        part = order[a:b]
        if b - a <= SMALL:
            order[a:b] = part[np.lexsort(tokens[part, depth:].T[::-1])]
            continue
        keys = tokens[part, depth]
        pivot = np.sort(keys[:: max(1, len(keys) // 9)])[4]
        less, more = keys < pivot, keys > pivot
        equal = ~(less | more)
        order[a:b] = np.concatenate([part[less], part[equal], part[more]])
        m, n = a + int(less.sum()), b - int(more.sum())
        todo += [(a, m, depth), (m, n, depth + 1), (n, b, depth)]
    return order


def _side_hashes(sides: list[bytes], reach: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the first x bytes counted from the anchor, for x = 0..reach, as rows by x; lengths)."""
    n = len(sides)
    lengths = np.array([len(s) for s in sides])
    grid = np.zeros((n, reach), np.uint8)
    for i, s in enumerate(sides):
        row = np.frombuffer(s, np.uint8)
        grid[i, :len(row)] = row[::-1] if backwards else row
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, reach - 1), _MIX)]))[:reach]
    values = np.random.default_rng(37).integers(1, 2**63, 256, dtype=np.uint64)
    out = np.zeros((reach + 1, n), np.uint64)
    np.cumsum(values[grid.T] * powers[:, None], axis=0, out=out[1:])
    return out, lengths


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance before the anchor at which a repeated string starts, by context; (reach + 1, -1) if none does."""
    lefts, n_left = _side_hashes(left, reach, True)
    rights, n_right = _side_hashes(right, reach, False)
    lowest, highest = np.full(len(group), reach + 1), np.full(len(group), -1)
    for x in range(reach + 1):
        use = np.flatnonzero((n_left >= x) & (n_right >= reach - x))
        if len(use) < 2:
            continue
        tokens = np.column_stack([group[use], lefts[x, use], rights[reach - x, use]])
        order = multikey_quicksort(tokens)
        ranked = tokens[order]
        same = (ranked[1:] == ranked[:-1]).all(1)
        twice = np.zeros(len(use), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = use[twice]
        lowest[hit] = np.minimum(lowest[hit], x)
        highest[hit] = x
    return lowest, highest


def _unsigned(values: pd.Series) -> np.ndarray:
    return values.to_numpy(np.int64).view(np.uint64)


def remove_repeats(documents: DataFrame, text: str = "text", length: int = 400, gram: int = 100, group_limit: int = 100_000) -> DataFrame:
    """The rows of `documents` with a struct `deduped` of n_bytes, n_removed, n_spans, kept (the remaining bytes) and n_chars.

    n_chars counts the code points of the remaining bytes by their first byte.
    """
    reach = length - gram
    kept = [f.name for f in documents.schema.fields if f.name != "deduped"]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Equal texts have equal anchors, so two hashes of the text, 96 bits, name a document.
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.xxhash64(body).alias("k"), F.hash(body).alias("k2"), body.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            with np.errstate(over="ignore"):
                for k, k2, t in zip(batch.column("k").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    place, g, c = anchors(np.frombuffer(t, np.uint8), length, gram)
                    if len(place):
                        room = np.minimum(len(t) - place - gram, reach)
                        for part, value in zip(parts, (np.full(len(place), k), np.full(len(place), k2, np.int32), place.astype(np.int32), room.astype(np.int16), g.view(np.int64), c.view(np.int64)), strict=True):
                            part.append(value)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["k", "k2", "a", "room", "g", "c"])

    places = stored(keyed.select("k", "k2", "text").mapInArrow(scan, "k bigint, k2 int, a int, room smallint, g bigint, c bigint"), "anchors")
    groups = places.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter("n > 1")
    groups = stored(groups.select("g", (F.col("c1") != F.col("c2")).alias("differ")), "groups")
    shared = stored(places.join(groups, "g"), "shared")
    context = shared.groupBy("g", "c").agg(
        F.count("*").alias("n"), F.bool_or("differ").alias("differ"), F.min(F.struct("k", "k2", "a")).alias("at"), F.max("room").alias("room"))
    context = stored(context, "contexts")

    whole = context.filter("n > 1").select("g", "c", (F.lit(reach) - F.col("room")).alias("lowest"), F.least(F.col("at.a"), F.lit(reach)).alias("highest"))
    part = stored(_sorted_part(context.filter("differ"), keyed, reach, gram, group_limit), "repeats")
    repeats = whole.union(part).groupBy("g", "c").agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))

    stretch = F.struct((F.col("a") - F.col("highest")).cast("int").alias("lo"), (F.col("a") - F.col("lowest") + length).cast("int").alias("hi"))
    covered = shared.join(repeats, ["g", "c"]).groupBy("k", "k2").agg(F.collect_set(stretch).alias("s"))
    covered = stored(covered.select("k", "k2", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")), "covered")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, lo, hi in zip(batch.column("z").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                data = unpack.decompress(z)
                out, spans, at, n = [], 0, 0, len(data)
                for a, b in sorted(zip(lo or (), hi or (), strict=True)):
                    if a > at or not spans:
                        out.append(data[at:a])
                        spans += 1
                        at = b
                    else:
                        at = max(at, b)
                out.append(data[at:])
                left = b"".join(out)
                rows.append((n, n - len(left), spans, left, len(left.translate(None, _INSIDE))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            made = pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n_bytes", "n_removed", "n_spans", "kept", "n_chars"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), made], ["row", "deduped"])

    joined = packed(keyed, "row").join(covered, ["k", "k2"], "left").select("row", "z", "lo", "hi")
    row_type = keyed.schema["row"].dataType.simpleString()
    done = joined.mapInArrow(cut, f"row {row_type}, deduped struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary,n_chars:bigint>")
    return done.select(*[F.col("row")[c].alias(c) for c in kept], "deduped")


def packed(keyed: DataFrame, *carry: str) -> DataFrame:
    """Texts compressed, as they are about to be shuffled."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [press.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(z, pa.binary())], [*names, "z"])

    slim = keyed.select(*carry, "k", "k2", "text")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "text"]
    return slim.mapInArrow(pack, ", ".join([*fields, "z binary"]))


def _sorted_part(context: DataFrame, keyed: DataFrame, reach: int, gram: int, group_limit: int) -> DataFrame:
    """(g, c, lowest, highest) of contexts that share their leading token with a different one."""
    wanted = context.groupBy(F.col("at.k").alias("k"), F.col("at.k2").alias("k2")).agg(F.collect_list(F.struct("at.a", "g", "c")).alias("w"))
    wanted = stored(wanted.select("k", "k2", "w.a", "w.g", "w.c"), "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            gs, cs, lefts, rights = [], [], [], []
            for z, a, g, c in zip(*[batch.column(n).to_pylist() for n in ("z", "a", "g", "c")], strict=True):
                data = unpack.decompress(z)
                gs += g
                cs += c
                lefts += [data[max(0, p - reach):p] for p in a]
                rights += [data[p + gram:p + gram + reach] for p in a]
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(cs, pa.int64()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], ["g", "c", "l", "r"])

    # One of all exact copies, most of them dropped before the shuffle: each context comes to its bucket once.
    sides = packed(keyed).dropDuplicates(["k", "k2"]).join(wanted, ["k", "k2"]).select("z", "a", "g", "c").mapInArrow(fetch, "g bigint, c bigint, l binary, r binary")

    sizes = context.groupBy("g").agg(F.count("*").alias("n"))
    large = stored(sizes.filter(F.col("n") > group_limit).select("g"), "large")
    total = context.count()
    # The splitters: a sample of leading tokens, each as often as it has contexts, cut into even parts.
    sample = np.sort([row["g"] for row in context.select("g").orderBy(F.xxhash64("g", "c")).limit(SAMPLE).collect()])
    n_buckets = max(1, min(len(sample), -(-total // BUCKET_ROWS)))
    splitters = np.unique(sample[np.linspace(0, len(sample) - 1, n_buckets + 1).astype(int)[1:-1]]) if len(sample) else np.zeros(0, np.int64)
    bounds = F.array(*[F.lit(int(s)) for s in splitters]).cast("array<bigint>")

    def sort_bucket(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.drop_duplicates(["g", "c"]).reset_index(drop=True)
        with np.errstate(over="ignore"):
            lowest, highest = repeated_starts(_unsigned(bucket["g"]), bucket["l"].to_list(), bucket["r"].to_list(), reach)
        found = pd.DataFrame({"g": bucket["g"], "c": bucket["c"], "lowest": lowest, "highest": highest})
        return found[found["highest"] >= 0]

    out = "g bigint, c bigint, lowest int, highest int"
    dealt = sides.join(large, "g", "left_anti")
    # The number of splitters at or below the token.
    number = F.size(F.filter(bounds, lambda s: s <= F.col("g")))
    small = dealt.withColumn("bucket", number).groupBy("bucket").applyInPandas(sort_bucket, out)
    if large.isEmpty():
        return small
    return small.union(_counted(sides.join(large, "g", "left_semi"), reach))


def _counted(sides: DataFrame, reach: int) -> DataFrame:
    """The same as sorting, for leading tokens with very many contexts: suffixes are counted by hash."""
    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                b = batch.iloc[at:at + 500]
                with np.errstate(over="ignore"):
                    lefts, n_left = _side_hashes(b["l"].to_list(), reach, True)
                    rights, n_right = _side_hashes(b["r"].to_list(), reach, False)
                    h = lefts * _ODD ^ rights[::-1] * _MIX
                x, i = np.nonzero((n_left[None, :] >= np.arange(reach + 1)[:, None]) & (n_right[None, :] >= reach - np.arange(reach + 1)[:, None]))
                yield pd.DataFrame({"g": b["g"].to_numpy()[i], "c": b["c"].to_numpy()[i], "x": x, "h": h[x, i].view(np.int64)})

    every = sides.dropDuplicates(["g", "c"]).mapInPandas(starts, "g bigint, c bigint, x int, h bigint")
    twice = every.groupBy("g", "x", "h").agg(F.count("*").alias("n")).filter("n > 1").select("g", "x", "h")
    found = every.join(twice, ["g", "x", "h"], "left_semi")
    return found.groupBy("g", "c").agg(F.min("x").alias("lowest"), F.max("x").alias("highest"))
