"""Late rows of a stream as an output of their own."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import folders


@dataclass(frozen=True)
class LateRows:
    """Splits micro-batches at a watermark that is kept on shared storage.

    The watermark of a batch is the greatest event time of all earlier batches less the delay, so a repeated batch is
    split as it was before. A windowed job with the same delay over the rows in time drops none of them: its
    own watermark is never ahead of the one here, as it has seen no more batches. So every row is either counted or late.
    """

    spark: SparkSession
    root: str
    time: str
    delay_seconds: int

    def _before(self, batch_id: int) -> int | None:
        """Greatest event time, in microseconds, up to the batch before; each mark holds that of all before it too."""
        earlier = [n for n in folders.committed(self.spark, self.root, "batch") if n < batch_id]
        if not earlier:
            return None
        return self.spark.read.schema("latest BIGINT").json(f"{self.root}/batch={earlier[-1]}").first()["latest"]

    def split(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(rows in time, late rows); rows without an event time are in time."""
        before = self._before(batch_id)
        micros = F.unix_micros(F.col(self.time).cast("timestamp"))
        mark = f"{self.root}/batch={batch_id}"
        if not folders.exists(self.spark, mark):
            latest = batch.agg(F.greatest(F.max(micros), F.lit(before).cast("bigint")).alias("latest"))
            staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
            latest.coalesce(1).write.json(staged)
            folders.publish(self.spark, staged, mark)
        if before is None:
            return batch, batch.limit(0)
        late = F.coalesce(micros < before - self.delay_seconds * 1_000_000, F.lit(False))
        return batch.filter(~late), batch.filter(late)
