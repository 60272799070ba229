"""Places and running sums inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored


def _segmented(values: np.ndarray, begins: np.ndarray, number: np.ndarray, carry: int, xor: bool) -> np.ndarray:
    """Running sums (or xors) that start anew where `begins` is set; `carry` goes on into the first segment."""
    op = np.bitwise_xor if xor else np.add
    total = op.accumulate(values)
    at = np.flatnonzero(begins)
    base = np.zeros(len(at) + 1, np.int64)
    base[1:] = np.where(at > 0, total[at - 1], 0)
    base = base[number]
    out = total ^ base if xor else total - base
    first = number == 0
    out[first] = out[first] ^ carry if xor else out[first] + carry
    return out


def in_order(
    frame: DataFrame, group: str, order: list[Column], label: str, add: tuple[str, ...] = (), xor: tuple[str, ...] = (),
    ranges: list[Column] | None = None, drop: tuple[str, ...] = (),
) -> DataFrame:
    """The rows of `frame` with their place `pos` (0, 1, …) in their group, ascending by `order`, written in the shared folder.

    `add` and `xor` name bigint columns whose running sums and xors, the row itself included, come back as `run_<name>`.
    `group` is a column without nulls. `ranges` may name short expressions, in the same order, to cut the table by.
    Columns in `drop` are only ordered by.

    The table is cut into ranges of (group, order), so a large group spreads over many tasks. Each task counts its own
    rows; what a group has in earlier ranges is added afterwards. Only the first group of a range can have
    such rows, so the table of offsets has at most one row per range, which bounds the broadcast.
    """
    kept = [c for c in frame.columns if c not in drop]
    cut = ranges if ranges is not None else order
    parted = frame.repartitionByRange(F.col(group), *cut).sortWithinPartitions(F.col(group), *order).select(*kept)
    names = ["pos", *[f"run_{c}" for c in (*add, *xor)]]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, groups, carry = None, 0, [0] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(group)
            begins = np.zeros(n, bool)
            begins[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            begins[0] = last is None or key[0].as_py() != last
            segment = np.cumsum(begins)
            made = []
            for i, name in enumerate(names):
                source = np.ones(n, np.int64) if i == 0 else batch.column(name[4:]).to_numpy(zero_copy_only=False)
                made.append(_segmented(source, begins, segment, carry[i], i > len(add)))
            carry = [int(m[-1]) for m in made]
            last, first = key[n - 1].as_py(), groups
            groups += int(segment[-1])
            made[0] = made[0] - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(m) for m in made], pa.array(np.full(n, part)), pa.array(first + segment == 1)],
                [*kept, *names, "part", "first"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parted.schema.fields)
    counts = ", ".join(f"{c} bigint" for c in names)
    rows = stored(parted.mapInArrow(number, f"{fields}, {counts}, part bigint, first boolean"), label)

    totals = rows.groupBy("part", group).agg(
        F.count("*").alias("pos"), F.bool_or("first").alias("first"),
        *[F.sum(c).alias(f"run_{c}") for c in add], *[F.bit_xor(c).alias(f"run_{c}") for c in xor])
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        "part", "first", *[(F.bit_xor(c) if c[4:] in xor else F.sum(c)).over(earlier).alias(f"before_{c}") for c in names])
    before = before.filter(F.col("first") & F.col("before_pos").isNotNull()).drop("first")
    joined = rows.join(F.broadcast(before.withColumn("first", F.lit(True))), ["part", "first"], "left")
    done = [
        (F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))) if c[4:] in xor else F.col(c) + F.coalesce(f"before_{c}", F.lit(0))).alias(c)
        for c in names
    ]
    return joined.select(*kept, *done)
