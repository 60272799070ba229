"""Visitor operators on streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.visitors import bounces, first_flag_days, repair_new_flag
from ..sources import folders


def first_per_day_stream(
    df: DataFrame, device: str, time: str, order: list[str], delay: str, entry: Column | None = None
) -> DataFrame:
    """The first entry row of each device and day, passed on in the micro-batch that brings it.

    Among the rows of one micro-batch the first by `order` is taken. To be run in
    update mode: a group changes in its first micro-batch, where the times of its
    first and its last batch are equal, and only then its row comes out. Rows of a
    busy device are combined before they are shuffled. Days are those of the session's time zone; the
    state of a day is dropped when a row of the second day after it comes.
    """
    rows = df if entry is None else df.filter(entry)
    placed = (
        # A day is named by its end, and the day before must outlive a day of up to 25 hours.
        rows.withColumn("_day", F.date_add(F.to_date(F.col(time).cast("timestamp")), 1).cast("timestamp"))
        .withWatermark("_day", f"25 hours {delay}")
        .withColumn("_batch", F.current_timestamp())
    )
    seen = placed.groupBy(device, "_day").agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"),
        F.min("_batch").alias("_first"),
        F.max("_batch").alias("_last"),
    )
    return seen.filter(F.col("_first") == F.col("_last")).select("_row.*")


def bounces_stream(
    df: DataFrame, device: str, time: str, order: list[str], entry: Column, timeout_seconds: int, delay: str
) -> DataFrame:
    """Bounces of a stream: the table operator behind a watermark.

    A bounce comes out when the watermark is past the slot after its own, at most
    twice the timeout plus the delay behind its event time.
    """
    return bounces(df.withWatermark(time, delay), device, time, order, entry, timeout_seconds)


@dataclass(frozen=True)
class FlagDays:
    """First flagged day of every device seen so far, kept as a table on shared storage.

    Each micro-batch adds its new devices in one folder. A repeated batch finds its
    folder written, reads only the folders before it, and gives the same result.
    """

    spark: SparkSession
    root: str

    def known(self, device: str, kind: str, before: int) -> DataFrame | None:
        """Devices of earlier batches, from the newest base and the batches after it."""
        bases = [n for n in folders.committed(self.spark, f"{self.root}/base", "upto") if n < before]
        upto = bases[-1] if bases else -1
        batches = folders.committed(self.spark, f"{self.root}/new", "batch")
        paths = [f"{self.root}/new/batch={n}" for n in batches if upto < n < before]
        if bases:
            paths.append(f"{self.root}/base/upto={upto}")
        if not paths:
            return None
        return self.spark.read.schema(f"`{device}` {kind}, first_day DATE").parquet(*paths)

    def repair(
        self, batch: DataFrame, batch_id: int, device: str, flag: str, day: Column, compact_every: int = 100
    ) -> DataFrame:
        """Repair the flags of one micro-batch and remember its new devices."""
        kind = batch.schema[device].dataType.simpleString()
        known = self.known(device, kind, batch_id)
        new = f"{self.root}/new/batch={batch_id}"
        if not folders.exists(self.spark, f"{new}/_SUCCESS"):
            found = first_flag_days(batch, device, flag, day).select(device, "first_day")
            found = found.filter(F.col(device).isNotNull())
            # All seen devices are the big side: an inner join may broadcast the batch's own.
            seen = None if known is None else known.select(device).join(found.select(device), device)
            fresh = found if seen is None else found.join(seen, device, "left_anti")
            fresh.write.mode("overwrite").parquet(new)
        base = f"{self.root}/base/upto={batch_id - 1}"
        if known is not None and batch_id % compact_every == 0 and not folders.exists(self.spark, f"{base}/_SUCCESS"):
            known.write.mode("overwrite").parquet(base)
        return repair_new_flag(batch, device, flag, day, known)
