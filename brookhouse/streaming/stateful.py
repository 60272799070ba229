"""Operators with keyed state: flag repair by a value per device, bounces by pending rows and timers.

Each key's state lives in the state store, so a micro-batch reads and writes the devices of its own rows, however
many devices the stream has seen. Arrow batches go to Python; no row is handled on its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

# A call of Python per key costs milliseconds; where keys are many it takes those of a bucket together.
BUCKETS = 1024


def _first_day(flag: str, ttl_ms: int | None) -> StatefulProcessor:
    """A processor made in a function goes to Python workers by value: this package need not be installed there."""

    class FirstDay(StatefulProcessor):
        """Rows of one device, their day in the last column, get their flag reset on days other than the first flagged one."""

        def __init__(self, flag: str, ttl_ms: int | None):
            self.flag, self.ttl_ms = flag, ttl_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.first = handle.getValueState("first_day", "day DATE", self.ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            if self.first.exists():
                first = self.first.get()[0]
            else:
                # The first micro-batch of a device: its first day is the least of all its rows.
                rows = list(rows)
                days = [d for part in rows for d in part.iloc[:, -1].dropna()]
                first = min(days, default=None)
                if days:
                    self.first.update((first,))
            for part in rows:
                day, out = part.iloc[:, -1], part.iloc[:, :-1].copy()
                out[self.flag] = out[self.flag].where(day.isna() | (day == first), "0")
                yield out

        def close(self) -> None:
            pass

    return FirstDay(flag, ttl_ms)


def repair_new_flag_stream(df: DataFrame, device: str, flag: str, day: Column, forget_after: timedelta | None = None) -> DataFrame:
    """Reset the new-visitor flag to '0' on any day other than the device's first flagged day, on a stream.

    The first flagged day is the least one of the micro-batch that brings the device; it never changes afterwards.
    Flagged rows with a device meet its state, one date per device; all others pass by it. With `forget_after`, a device whose state was
    not set within that time (of the clock) is forgotten and counts as new again; Spark then plans batches without
    rows for ever, so the trigger must be one that goes on, not `availableNow`. To be run in append mode.
    """
    flagged = F.coalesce((F.col(f"`{flag}`") == "1") & F.col(f"`{device}`").isNotNull(), F.lit(False))
    ttl = None if forget_after is None else int(forget_after.total_seconds() * 1000)
    # Columns go by place: any name will do, also one that Spark would change on the way to Python.
    placed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    name = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.filter(flagged).select(*placed, day.alias("day"))
    fixed = rows.groupBy(name[device]).transformWithStateInPandas(
        statefulProcessor=_first_day(name[flag], ttl), outputStructType=StructType(rows.schema.fields[:-1]), outputMode="Append",
        timeMode="None" if ttl is None else "ProcessingTime")
    return fixed.toDF(*df.columns).unionByName(df.filter(~flagged))


def _quiet(schema: StructType, time: int, order: list[int], timeout_ms: int, device: int = 0) -> StatefulProcessor:
    """Made in a function for the reason given at `_first_day`."""

    class Quiet(StatefulProcessor):
        """Entry rows of the devices of one bucket after which nothing happens to the device within the timeout.

        Input columns: the event time, those to give out, the time in epoch microseconds and the entry mark. Rows wait without
        the first column, those of an Arrow batch packed as one entry of a list, until the watermark is the timeout past
        them, when every row that could follow has come.
        """

        def __init__(self, schema: StructType, time: int, order: list[int], timeout_ms: int, device: int):
            self.schema, self.time, self.order, self.timeout_ms, self.device = schema, time, order, timeout_ms, device

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "packed BINARY")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            least = None
            for part in rows:
                columns = [part.iloc[:, i].tolist() for i in range(1, 1 + len(self.schema))]
                plain = [[v.item() if hasattr(v, "item") else v for v in column] for column in columns]
                found = list(zip(*[[None if v is pd.NaT or v != v else v for v in column] for column in plain], strict=True))
                self.waiting.appendValue((pickle.dumps(found),))
                first = min(r[self.time] for r in found)
                least = first if least is None else min(least, first)
            if least is not None:
                self._wake(least)
            yield self._out([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            settled = timerValues.getCurrentWatermarkInMs() * 1000 - self.timeout_ms * 1000
            devices = {}
            for (packed,) in self.waiting.get():
                for row in pickle.loads(packed):
                    devices.setdefault(row[self.device], []).append(row)
            bounces, left, some = [], [], False
            for rows in devices.values():
                rows.sort(key=lambda r: (r[self.time], *[(r[i] is not None, r[i]) for i in self.order]))
                for row, after in zip(rows, [*rows[1:], None], strict=False):
                    if row[self.time] > settled:
                        left.append(row)
                        continue
                    some = True
                    if row[-1] and (after is None or after[self.time] >= row[self.time] + self.timeout_ms * 1000):
                        bounces.append(row)
            if some and left:
                self.waiting.put([(pickle.dumps(left),)])
            elif some:
                self.waiting.clear()
            if left:
                self._wake(min(r[self.time] for r in left))
            yield self._out(bounces)

        def _wake(self, time_us: int) -> None:
            self.handle.registerTimer(time_us // 1000 + self.timeout_ms + 1)

        def _out(self, rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([r[:-1] for r in rows], columns=self.schema.names[:-1])

        def close(self) -> None:
            pass

    return Quiet(schema, time, order, timeout_ms, device)


def bounces_by_timer(
    df: DataFrame, device: str, time: str, order: list[str], entry: Column, timeout_seconds: int, delay: str
) -> DataFrame:
    """Bounces of a stream by pending rows and event-time timers, for the devices of a bucket together.

    A bucket holds the rows of its last timeout and delay only, in a list that timers clear behind the watermark. `device` and
    `order` are columns of plain types. A bounce comes out when the watermark is a timeout past it.
    """
    others = [c for c in df.columns if c != time]
    placed = df.withWatermark(time, delay).select(
        time, *others, F.unix_micros(time).alias("time_us"), F.coalesce(entry, F.lit(False)).alias("is_entry"))
    kept = StructType(placed.schema.fields[1:])
    processor = _quiet(
        kept, kept.names.index("time_us"), [kept.names.index(c) for c in order], timeout_seconds * 1000, kept.names.index(device))
    bucketed = placed.withColumn("_bucket", F.pmod(F.xxhash64(device), F.lit(BUCKETS)))
    found = bucketed.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType(kept.fields[:-1]), outputMode="Append", timeMode="EventTime")
    return found.select(*[F.timestamp_micros("time_us").alias(c) if c == time else F.col(c) for c in df.columns])
