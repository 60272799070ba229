"""Routing rules that change while rows come in: a log of versions, and rows that wait for their rule."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.routing import Routed, current_rules, route_changes
from ..schemas import RULE_COLUMNS
from . import folders

_CHANGE = ", ".join([*[f"`{c}` STRING" for c in RULE_COLUMNS], "type STRING", "seq BIGINT", "batch BIGINT"])


@dataclass(frozen=True)
class RuleLog:
    """Changes of the rules, a folder per batch; version n is what is in force after batch n."""

    spark: SparkSession
    root: str

    def append(self, changes: DataFrame, batch_id: int) -> None:
        """Add one batch of rule rows with a change `type` and a `seq` that orders them; once, however often it is repeated."""
        folder = f"{self.root}/batch={batch_id}"
        if folders.exists(self.spark, folder):
            return
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
        changes.select(*RULE_COLUMNS, "type", F.col("seq").cast("bigint").alias("seq")).write.parquet(staged)
        folders.publish(self.spark, staged, folder)

    def version(self) -> int:
        """Number of the newest version, -1 before the first."""
        return max(folders.numbers(self.spark, self.root, "batch"), default=-1)

    def rules(self, version: int | None = None) -> DataFrame:
        """The rules in force in a version, the newest by default."""
        upto = self.version() if version is None else version
        paths = [f"{self.root}/batch={n}" for n in folders.numbers(self.spark, self.root, "batch") if n <= upto]
        if not paths:
            return self.spark.createDataFrame([], _CHANGE).select(*RULE_COLUMNS)
        changes = self.spark.read.schema(_CHANGE).option("basePath", self.root).parquet(*paths)
        return current_rules(changes, ["batch", "seq"])


@dataclass(frozen=True)
class WaitingRows:
    """Change rows without a rule, kept until a version of the rules serves them.

    A batch that finds the version of the batch before it routes its own rows and adds those without a rule. Only a
    new version makes a batch read what waits: the rows it serves go out, the others are written anew. Each batch
    notes its version first, so a repeated batch does the same again.
    """

    log: RuleLog
    root: str

    def _note(self, batch_id: int) -> tuple[int, list[int], int]:
        """(version to use, batches whose rows this batch reads, first batch whose rows wait afterwards)."""
        spark, place = self.log.spark, f"{self.root}/notes/batch={batch_id}"
        earlier = [n for n in folders.numbers(spark, f"{self.root}/notes", "batch") if n < batch_id]
        before = json.loads(folders.read_text(spark, f"{self.root}/notes/batch={earlier[-1]}")) if earlier else {"version": -1, "since": batch_id}
        if not folders.exists(spark, place):
            version = self.log.version()
            since = before["since"] if version == before["version"] else batch_id
            folders.write_text(spark, place, json.dumps({"version": version, "since": since}))
        note = json.loads(folders.read_text(spark, place))
        reads = [] if note["version"] == before["version"] else [n for n in earlier if n >= before["since"]]
        return note["version"], reads, note["since"]

    def route(self, rows: DataFrame, batch_id: int) -> Routed:
        """Route the rows of a batch and those that have waited for this version; the rest of both waits on."""
        spark = self.log.spark
        version, reads, _ = self._note(batch_id)
        paths = [f"{self.root}/rows/batch={n}" for n in reads]
        if paths:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*paths))
        routed = route_changes(rows, self.log.rules(version))
        folder = f"{self.root}/rows/batch={batch_id}"
        if not folders.exists(spark, folder):
            staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
            routed.unmatched.write.parquet(staged)
            folders.publish(spark, staged, folder)
        return routed

    def waiting(self) -> DataFrame | None:
        """All rows that wait now."""
        noted = folders.numbers(self.log.spark, f"{self.root}/notes", "batch")
        if not noted:
            return None
        since = json.loads(folders.read_text(self.log.spark, f"{self.root}/notes/batch={noted[-1]}"))["since"]
        return self.log.spark.read.parquet(*[f"{self.root}/rows/batch={n}" for n in noted if n >= since])
