"""Topics: named logs of JSON strings, kept in Kafka or in folders of text files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter

from ..operators.parse import parse_json
from . import folders


@dataclass(frozen=True)
class Topics:
    """Where topics live.

    With `servers` set they are Kafka topics (the connector package must be on the
    session's classpath); otherwise each topic is a folder of text files below
    `root`, one JSON string per line. Folder output is exactly once: a batch appears as a whole or not at all, once.
    """

    spark: SparkSession
    root: str | None = None
    servers: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def path(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    def source_options(self, topic: str, start: str = "earliest") -> dict[str, str]:
        return {
            "kafka.bootstrap.servers": str(self.servers), "subscribe": topic, "startingOffsets": start, **self.options,
        }

    def sink_options(self, topic: str | None = None) -> dict[str, str]:
        """Without a topic, the rows name theirs in a `topic` column."""
        named = {"topic": topic} if topic else {}
        return {"kafka.bootstrap.servers": str(self.servers), **named, **self.options}

    def _kafka_values(self, reader, topic: str, start: str, *more: Column) -> DataFrame:
        raw = reader.format("kafka").options(**self.source_options(topic, start)).load()
        return raw.select(F.col("value").cast("string").alias("value"), *more)

    def _paced(self) -> DataStreamReader:
        """Offsets of a micro-batch are limited by default: that paces a backlog and drops nothing."""
        return self.spark.readStream.option("maxOffsetsPerTrigger", "10000000")

    def _files(self) -> DataStreamReader:
        """The same for files."""
        return self.spark.readStream.schema("value STRING").options(**{"maxFilesPerTrigger": "1000", **self.options})

    def stream(self, topic: str, start: str = "earliest", placed: bool = False) -> DataFrame:
        """Endless rows of one string column `value`; a restart goes on from the checkpoint.

        With `placed`, a column `arrived` tells the order of arrival as far as the source knows it: Kafka
        partition and offset, or time and name of the file. Rows of one file follow in reading order.
        """
        if self.servers:
            place = [F.struct(F.col("timestamp").alias("at"), F.format_string("%08d", "partition").alias("of"), F.col("offset").alias("n")).alias("arrived")]
            return self._kafka_values(self._paced(), topic, start, *(place if placed else []))
        folders.make(self.spark, self.path(topic))
        place = [F.struct(
            F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("of"), F.col("_metadata.file_block_start").alias("n"),
        ).alias("arrived")]
        return self._files().text(self.path(topic)).select("value", *(place if placed else []))

    def routed_stream(self, topic: str, start: str = "earliest") -> DataFrame:
        """The same for a topic that `write_routed` fills."""
        if self.servers:
            return self._kafka_values(self._paced(), topic, start)
        return self._files().text(f"{self.path('routed')}/*/topic={topic}").select("value")

    def table(self, topic: str) -> DataFrame:
        """The rows a topic holds now."""
        if self.servers:
            return self._kafka_values(self.spark.read, topic, "earliest")
        return self.spark.read.schema("value STRING").text(self.path(topic)).select("value")

    def view(
        self, name: str, topic: str, schema: str, rowtime: str, delay: str = "3 seconds", start: str = "latest"
    ) -> DataFrame:
        """A streaming SQL view of a topic: typed columns, a computed `rowtime`, a watermark.

        `rowtime` is a SQL expression over the columns of `schema`.
        """
        rows = parse_json(self.stream(topic, start), schema).rows
        timed = rows.withColumn("rowtime", F.expr(rowtime)).withWatermark("rowtime", delay)
        timed.createOrReplaceTempView(name)
        return timed

    def write_stream(self, df: DataFrame, topic: str, checkpoint: str) -> DataStreamWriter:
        """Append a stream's `value` column to one topic."""
        writer = df.select("value").writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        if self.servers:
            return writer.format("kafka").options(**self.sink_options(topic))
        return writer.format("text").option("path", self.path(topic))

    def write_batch(self, df: DataFrame, topic: str, batch_id: int) -> None:
        """Append a micro-batch, in folders as a whole and only once."""
        if self.servers:
            df.select("value").write.format("kafka").options(**self.sink_options(topic)).save()
            return
        self._commit(df.select("value").write, f"{self.path(topic)}/batch={batch_id}")

    def write_routed(self, df: DataFrame, batch_id: int, destination: str = "sink_table") -> None:
        """Append each row's `value` to the topic its `destination` column names.

        In folders all topics of a batch leave in one write, below
        `routed/batch=<n>/topic=<name>`.
        """
        rows = df.select(F.col(destination).alias("topic"), "value")
        if self.servers:
            rows.write.format("kafka").options(**self.sink_options()).save()
            return
        self._commit(rows.write.partitionBy("topic"), f"{self.path('routed')}/batch={batch_id}")

    def _commit(self, writer: DataFrameWriter, folder: str) -> None:
        """Write a batch where no reader looks, then move it to its place in one step.

        An attempt that dies between two files leaves nothing a reader could see, and a batch
        that is in its place is not written again.
        """
        if folders.exists(self.spark, folder):
            return
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        writer.text(staged)
        folders.publish(self.spark, staged, folder)

    def routed_table(self, topic: str) -> DataFrame:
        """Rows of a routed topic; the scan touches only that topic's folders."""
        rows = self.spark.read.schema("value STRING, batch BIGINT, topic STRING").text(self.path("routed"))
        return rows.filter(F.col("topic") == topic).select("value")
