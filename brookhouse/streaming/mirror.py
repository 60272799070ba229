"""A database table mirrored on a stream: a change takes back the row it replaces.

The mirror gives out rows with a `weight`: +1 for a row that the table has now, -1 for one that it has no longer. Sums over
weights, such as `weighted_totals`, are right after every micro-batch, deletes included.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import changes_of
from .stateful import BUCKETS

WEIGHT = "weight"


def _versions(ttl_ms: int | None) -> StatefulProcessor:
    """A processor made in a function goes to Python workers by value: this package need not be installed there."""
    weight = WEIGHT

    class Versions(StatefulProcessor):
        """Versions `(key, at, gone, row)` of the keys of one bucket. The state is the last one of each key; a change of it gives out both rows.

        A micro-batch reads and writes the keys of its own rows. A deleted key leaves only its `at`, so that a version older than the delete does
        not bring the row back.
        """

        def __init__(self, ttl_ms: int | None):
            self.ttl_ms = ttl_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.live = handle.getMapState("live", "key STRING", "at STRING, row STRING")
            self.dead = handle.getMapState("dead", "key STRING", "at STRING", self.ttl_ms)

        def handleInputRows(self, bucket, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            best = {}
            for part in rows:
                for key, *version in zip(part["key"], part["at"], part["gone"].astype(bool), part["row"], strict=True):
                    best[key] = max(best.get(key, version), version)
            out, weights = [], []
            for key, (at, gone, row) in best.items():
                live = self.live.getValue((key,))
                dead = None if live is not None else self.dead.getValue((key,))
                if live is not None:
                    before = [live[0], False, live[1]]
                else:
                    before = None if dead is None else [dead[0], True, ""]
                if before is not None and [at, gone, row] <= before:
                    continue
                if gone:
                    if live is not None:
                        self.live.removeKey((key,))
                    self.dead.updateValue((key,), (at,))
                else:
                    if dead is not None:
                        self.dead.removeKey((key,))
                    self.live.updateValue((key,), (at, row))
                old, new = [live[1]] if live is not None else [], [] if gone else [row]
                if old != new:
                    out += old + new
                    weights += [-1] * len(old) + [1] * len(new)
            yield pd.DataFrame({"row": pd.Series(out, dtype=object), weight: pd.Series(weights, dtype="int64")})

        def close(self) -> None:
            pass

    return Versions(ttl_ms)


def _place(sequence: list[str]) -> Column:
    """Integer columns as one text of the same order; a null comes before all numbers."""
    texts = [F.lpad((F.col(c).cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")).cast("string"), 20, "0") for c in sequence]
    return F.concat(*[F.coalesce(t, F.lit(" " * 20)) for t in texts])


def mirrored_stream(
    changes: DataFrame, database: str, table: str, columns: Mapping[str, str], key: str, sequence: list[str],
    forget_deleted: timedelta | None = None,
) -> DataFrame:
    """Typed rows of one source table with a `weight`, from a stream of changes as `current_table` takes them.

    The integer columns of `sequence` order the changes of a key, in whatever order and however often they arrive: older
    ones and repeats give nothing. Among equal ones a delete counts as the last, else the row whose text is greater. A key
    costs one row of state; that of a deleted key goes `forget_deleted` (of the clock) after its delete, if given. With that, Spark
    plans batches without rows for ever: such a job is for a trigger that goes on, not for `availableNow`.
    """
    keyed = changes_of(changes, database, table, key)
    gone = F.col("type") == "delete"
    row = F.to_json(F.array(*[F.try_element_at("data", F.lit(name)) for name in columns]))
    versions = keyed.select(
        F.col("_key").alias("key"), _place(sequence).alias("at"), F.coalesce(gone, F.lit(False)).alias("gone"), F.when(gone, "").otherwise(row).alias("row"))
    ttl = None if forget_deleted is None else int(forget_deleted.total_seconds() * 1000)
    bucketed = versions.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), *versions.columns)
    found = bucketed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_versions(ttl), outputStructType=f"row STRING, {WEIGHT} BIGINT", outputMode="Append",
        timeMode="None" if ttl is None else "ProcessingTime")
    values = found.select(F.from_json("row", "array<string>").alias("v"), WEIGHT)
    return values.select(*[F.get("v", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items())], WEIGHT)


def weighted_totals(rows: DataFrame, by: Mapping[str, str], sums: Mapping[str, str]) -> DataFrame:
    """Per group `ct`, its rows, and a sum per entry of `sums`, of rows with a `weight`. `by` and `sums` map names to SQL expressions.

    A group without rows stays, with `ct` 0: on a stream in update mode that is how a reader learns of it. A sum over nulls
    alone is null, as ever.
    """
    values = rows.select(WEIGHT, *[F.expr(e).alias(name) for name, e in [*by.items(), *sums.items()]])
    return values.groupBy(*by).agg(F.sum(WEIGHT).alias("ct"), *[
        F.when(F.sum(F.when(F.col(name).isNotNull(), F.col(WEIGHT))) > 0, F.sum(F.col(name) * F.col(WEIGHT))).alias(name) for name in sums])
