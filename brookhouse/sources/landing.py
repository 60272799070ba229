"""Landing of raw log lines: kept by day, forwarded, bad lines set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import day_text
from ..operators.parse import in_time, solid_text
from . import folders
from .topics import Topics


def land_logs(lines: DataFrame, folder: str, batch_id: int, topics: Topics | None = None, topic: str = "ods_base_log") -> None:
    """Write one batch of raw lines below `folder`, as one pass over the input.

    Every line is kept, with its event day (`none` where there is no readable time) and whether it is a JSON object; the day
    is a folder, so a day's lines can be read alone. Good lines also go to `topic`.
    A batch that is already there is not written again.
    """
    target = f"{folder}/batch={batch_id}"
    parsed = lines.select(
        F.col("value"),
        F.inline(F.array(F.from_json(solid_text("value"), "ts STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))),
    ).withColumn("ts", F.col("ts").try_cast("bigint"))
    kept = parsed.select(
        "value",
        F.col("_bad").isNull().alias("good"),
        F.coalesce(day_text(F.when(in_time("ts"), F.col("ts"))), F.lit("none")).alias("log_day"),
    )
    if not folders.exists(lines.sparkSession, f"{target}/_SUCCESS"):
        kept.write.mode("overwrite").partitionBy("log_day", "good").parquet(target)
    if topics is not None:
        written = lines.sparkSession.read.schema("value STRING, log_day STRING, good BOOLEAN").parquet(target)
        topics.write_batch(written.filter("good"), topic, batch_id)


def landed_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All landed lines with `log_day` and `good`."""
    schema = "value STRING, batch BIGINT, log_day STRING, good BOOLEAN"
    return spark.read.schema(schema).parquet(folder)


