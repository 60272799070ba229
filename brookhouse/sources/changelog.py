"""Change rows of a table: its snapshot first, then the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_snapshot(snapshot: DataFrame, database: str, table: str, changes: DataFrame, sequence: str = "ts_ms") -> DataFrame:
    """Rows of `snapshot` as `read` changes, placed before all rows of `changes`.

    `changes` has `(database, table, type, data)` and the `sequence` column.
    """
    pairs = [part for name in snapshot.columns for part in (F.lit(name), F.col(name).cast("string"))]
    first = snapshot.select(
        F.lit(database).alias("database"),
        F.lit(table).alias("table"),
        F.lit("read").alias("type"),
        F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull()).alias("data"),
        F.lit(-1).cast("bigint").alias(sequence),
    )
    here = changes.filter((F.col("database") == database) & (F.col("table") == table))
    return first.unionByName(here.select(*first.columns))
