"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import working_dir

# Fixed by the contract of the queries: a word is a run of characters other than blank, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, also inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts`; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write `frame` into the shared folder and read it back.

    This cuts the lineage: what follows reads files that outlive any executor.
    """
    spark = frame.sparkSession
    path = working_dir(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
