"""Visitor facts: flag repair, daily unique visitors, bounces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import is_blank
from .skew import spread_join


def is_entry(last_page: Column | str = "last_page_id") -> Column:
    """True for the first page of a visit: nothing led to it."""
    return is_blank(last_page)


def first_flag_days(
    df: DataFrame, device: str, flag: str, day: Column, known: DataFrame | None = None
) -> DataFrame:
    """First flagged day per device as `(device, first_day, n)`, `n` being its flagged rows.

    `known` holds `(device, first_day)` from earlier batches; a known day never changes.
    """
    first = (
        df.filter(F.col(flag) == "1")
        .groupBy(device)
        .agg(F.min(day).alias("first_day"), F.count("*").alias("n"))
    )
    if known is None:
        return first
    # The batch's devices are the small side, and an inner join may broadcast either one.
    hits = known.select(device, F.col("first_day").alias("_known")).join(first.select(device), device)
    return first.join(hits, device, "left").select(
        device, F.coalesce("_known", "first_day").alias("first_day"), "n"
    )


def repair_new_flag(
    df: DataFrame, device: str, flag: str, day: Column, known: DataFrame | None = None
) -> DataFrame:
    """Reset the new-visitor flag to '0' on any day other than the device's first flagged day.

    Rows without the flag keep it and never shuffle. The first day is a plain
    minimum, combined on the map side; it goes back to the flagged rows by a join
    that splits heavy devices. A flagged row without a device keeps its flag.
    """
    is_flagged = F.coalesce(F.col(flag) == "1", F.lit(False))
    first = first_flag_days(df, device, flag, day, known)
    repaired = (
        spread_join(df.filter(is_flagged), first, [device])
        .withColumn(flag, F.when(day != F.col("first_day"), "0").otherwise(F.col(flag)))
        .select(*df.columns)
    )
    return repaired.unionByName(df.filter(~is_flagged))


def first_per_day(
    df: DataFrame, device: str, day: Column, order: list[str], entry: Column | None = None
) -> DataFrame:
    """The first entry row of each device and day.

    `row_number = 1` is limited on the map side before the shuffle, so a busy
    device sends one row per map task and day.
    """
    rows = df if entry is None else df.filter(entry)
    window = Window.partitionBy(device, "_day").orderBy(*order)
    return (
        rows.withColumn("_day", day)
        .withColumn("_rank", F.row_number().over(window))
        .filter("_rank = 1")
        .drop("_day", "_rank")
    )


def bounces(
    df: DataFrame, device: str, time: str, order: list[str], entry: Column, timeout_seconds: int
) -> DataFrame:
    """Entry rows whose device does nothing else within the timeout.

    Cut time into slots as long as the timeout. Inside one slot every row but the
    last has a successor in time, so only the last row of a slot can be a bounce,
    and the first row of the next slot decides. A window twice as long that slides
    by one slot sees both. The whole pattern is therefore one aggregation per
    device and window: combined on the map side, free of device-wide groups, and
    the same on a stream (with a watermark on `time`) as on a table.
    """
    slot = F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    window = F.window(time, f"{2 * timeout_seconds} seconds", f"{timeout_seconds} seconds")
    columns = [c for c in df.columns if c not in ("_window", "_own")]
    placed = (
        df.withColumn("_window", window)
        .withColumn("_own", F.col(time) < F.col("_window.start") + slot)
        # Only an own entry row can come out, so only it carries its columns.
        .withColumn("_row", F.when(F.col("_own") & entry, F.struct(*columns)))
        .withColumn("_order", F.when(F.col("_own"), F.struct(time, *order)))
        .withColumn("_follow", F.when(~F.col("_own"), F.col(time)))
        .select(device, "_window", "_row", "_order", "_follow")
    )
    last = placed.groupBy(device, "_window").agg(
        F.max_by("_row", "_order").alias("_row"),
        F.min("_follow").alias("_next"),
    )
    quiet = F.col("_next").isNull() | (F.col("_next") >= F.col(f"_row.{time}") + slot)
    return last.filter(F.col("_row").isNotNull() & quiet).select("_row.*")
