"""Play a stored table through a streaming query, to its very end."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import stream_settings, working_dir
from ..sources import folders


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as a file stream. The path may be one file or a folder of files."""
    schema = spark.read.parquet(path).schema
    # A pattern that matches only this name: the source takes no plain file path.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def sliced(spark: SparkSession, path: str, by: str, folder: str) -> None:
    """A stored table cut into the folders `_slice=<n>`, in one pass of all tasks.

    `by` is an expression that gives each row the number of its slice.
    """
    numbered = spark.read.parquet(path).withColumn("_slice", F.expr(by))
    numbered.filter("_slice IS NOT NULL").write.partitionBy("_slice").parquet(folder)


def time_slices(time: str, ends: list) -> str:
    """A slice number by time: how many of the given times (text or number literals) are at or before it."""
    return " + ".join([f"CAST({time} >= {end} AS INT)" for end in ends]) or "0"


def cut_times(spark: SparkSession, path: str, time: str, slices: int) -> list[str]:
    """Times that cut a table into about equal slices, as literals."""
    shares = [i / slices for i in range(1, slices)]
    cuts = spark.read.parquet(path).select(F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    found = cuts.agg(F.percentile_approx("t", shares).alias("cuts")).first()["cuts"] or []
    return [f"CAST(timestamp_micros({c}) AS TIMESTAMP_NTZ)" for c in found]


def cuts_in_step(spark: SparkSession, tables: list[Played], batch_rows: int, least: int) -> list[str]:
    """Times, as literals, that cut all tables alike, so that a slice has about `batch_rows` rows of them together."""
    counts = [spark.read.parquet(played.path).count() for played in tables]
    largest = max(zip(counts, range(len(tables))))[1]
    slices = max(least, math.ceil(sum(counts) / batch_rows))
    return cut_times(spark, tables[largest].path, tables[largest].time, slices)


def _writer(out: DataFrame, folder: str, step: Callable[[DataFrame, int], DataFrame], mode: str) -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)


def _run(out: DataFrame, folder: str, step: Callable[[DataFrame, int], DataFrame], mode: str) -> None:
    with stream_settings(out.sparkSession):
        _writer(out, folder, step, mode).trigger(availableNow=True).start().awaitTermination()


def play(spark: SparkSession, job: Callable[[], DataStreamWriter], steps: Iterable[Callable[[], None]], keyed: bool = False) -> None:
    """Run one streaming query, fed by one step after the other: what a step brings is one micro-batch.

    The query stays up between the steps, so its state is not read again from the checkpoint. It is made after the first
    step, when its folders are laid out.
    """
    query = None
    with stream_settings(spark, keyed):
        try:
            for feed in steps:
                feed()
                query = query or job().start()
                query.processAllAvailable()
        finally:
            if query is not None:
                query.stop()


@dataclass(frozen=True)
class Played:
    """A stored table to play: its event time column, column values of its closing row, and how many
    micro-batches, cut by time, it is played in. Tables of unlike pace have unlike numbers of them."""

    path: str
    time: str
    closing: dict[str, str] | None = None
    slices: int = 1


def replay(
    spark: SparkSession,
    tables: Played | list[Played],
    build: Callable[..., DataFrame],
    mode: str = "append",
    horizon: str = "INTERVAL 10000 DAYS",
    folder: str | None = None,
    cuts: list[str] | None = None,
    keyed: bool = False,
) -> DataFrame:
    """Rows that the streaming query `build(stream, …)` gives out for whole tables.

    A stream never closes its last windows by itself. After the tables one closing
    row each is fed in, `horizon` later than the table's last row; it moves the
    watermark past everything before it. It comes when everything before it is done, so it is last however many
    micro-batches the tables take. With `cuts` the tables go in step: all of them are cut at these times. `folder` is where
    the query keeps its checkpoint and output, a new one by default; `keyed` as in `stream_settings`.
    """
    folder = folder or working_dir(spark, "replay")
    tables = [tables] if isinstance(tables, Played) else tables
    ends = [f"{folder}/end{i}" for i in range(len(tables))]
    streams = []
    steps = 1
    for number, (played, end) in enumerate(zip(tables, ends)):
        table = spark.read.parquet(played.path)
        table.limit(0).write.parquet(end)
        closing = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(end)
        if cuts is not None or played.slices > 1:
            times = cut_times(spark, played.path, played.time, played.slices) if cuts is None else cuts
            sliced(spark, played.path, time_slices(played.time, times), f"{folder}/slices{number}")
            folders.make(spark, f"{folder}/fed{number}")
            opened = spark.readStream.schema(table.schema).parquet(f"{folder}/fed{number}/*")
            steps = max(steps, len(times) + 1)
        else:
            opened = stream_table(spark, played.path)
        streams.append(opened.unionByName(closing))
    out = build(*streams)

    def feed(step: int) -> None:
        for number in range(len(tables)):
            part = f"{folder}/slices{number}/_slice={step}"
            if folders.exists(spark, part):
                folders.publish(spark, part, f"{folder}/fed{number}/{step}")

    def close() -> None:
        for played, end in zip(tables, ends):
            table = spark.read.parquet(played.path)
            values = {
                played.time: F.col("_last") + F.expr(horizon),
                **{name: F.lit(value) for name, value in (played.closing or {}).items()},
            }
            last = table.agg(F.max(played.time).alias("_last")).select(*[
                values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields
            ])
            last.write.parquet(f"{end}_row")
        for end in ends:
            folders.publish(spark, f"{end}_row", f"{end}/row")

    feeds = [partial(feed, step) for step in range(steps)]
    if any(played.closing is not None for played in tables):
        feeds.append(close)
    play(spark, lambda: _writer(out, folder, lambda batch, _: batch, mode), feeds, keyed)
    return spark.read.parquet(f"{folder}/out").select(*out.columns)


def state_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows in the state store of a query that `replay` ran in `folder`."""
    return spark.read.format("statestore").load(f"{folder}/checkpoint")


def replay_batches(
    spark: SparkSession, stream: DataFrame, step: Callable[[DataFrame, int, str], DataFrame]
) -> DataFrame:
    """Rows that `step(batch, batch_id, folder)` returns for each micro-batch of `stream`.

    `folder` is the query's own, for state it keeps between batches.
    """
    folder = working_dir(spark, "replay")
    _run(stream, folder, lambda batch, batch_id: step(batch, batch_id, folder), "append")
    return spark.read.parquet(f"{folder}/out").drop("batch")


def replay_twice(spark: SparkSession, build: Callable[[], DataFrame], close: Callable[[], None]) -> DataFrame:
    """Rows of the streaming query `build()`, with its closing row fed by `close` before a second run."""
    folder = working_dir(spark, "replay")
    out = build()
    _run(out, folder, lambda batch, _: batch, "append")
    close()
    _run(build(), folder, lambda batch, _: batch, "append")
    return spark.read.parquet(f"{folder}/out").select(*out.columns)
