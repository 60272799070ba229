"""Database change rows: normalising, filtering, folding to current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import is_blank

# Operation letters of the change envelope.
OPERATIONS = {"c": "insert", "r": "read", "u": "update", "d": "delete"}


def normalise_changes(envelopes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Change envelopes to `(database, table, type, data)`; a delete has empty data.

    Spelled-out operation names are accepted next to the one-letter codes. `keep`
    names further columns to pass on, such as a sequence or the row before.
    """
    op = F.lower("op")
    spelled = F.when(op == "create", "insert").otherwise(op)
    kind = F.coalesce(*[F.when(op == code, name) for code, name in OPERATIONS.items()], spelled)
    empty = F.create_map().cast("map<string,string>")
    return envelopes.select(
        F.col("source.db").alias("database"),
        F.col("source.table").alias("table"),
        kind.alias("type"),
        F.coalesce("after", empty).alias("data"),
        *keep,
    )


def valid_changes(changes: DataFrame) -> DataFrame:
    """Keep rows that name a table and carry data."""
    return changes.filter(~is_blank("table") & F.col("data").isNotNull() & (F.size("data") > 0))


def latest_by_key(
    df: DataFrame, keys: list[str], sequence: list[str], deleted: Column | None = None
) -> DataFrame:
    """The last row of each key by `sequence`; keys whose last row is a delete drop out.

    `row_number = 1` is limited on the map side first, so a hot key sends one row
    per map task into the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.desc(name) for name in sequence])
    last = df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
    return last if deleted is None else last.filter(~F.coalesce(deleted, F.lit(False)))


def changes_of(changes: DataFrame, database: str, table: str, key: str) -> DataFrame:
    """The changes of one source table that name a key, with the key as `_key`.

    A delete must still name it, in `data` or in a `before` map column.
    """
    rows = changes.filter((F.col("database") == database) & (F.col("table") == table))
    named = F.col("data")
    if "before" in changes.columns:
        named = F.when(F.size("data") > 0, F.col("data")).otherwise(F.col("before"))
    # Rows without a key belong to no row of the table.
    return rows.withColumn("_key", F.try_element_at(named, F.lit(key))).filter(F.col("_key").isNotNull())


def current_table(
    changes: DataFrame, database: str, table: str, columns: dict[str, str], key: str, sequence: list[str]
) -> DataFrame:
    """Mirror of one source table: typed current rows with changes and deletes applied, as `changes_of` finds them."""
    keyed = changes_of(changes, database, table, key)
    last = latest_by_key(keyed, ["_key"], sequence, F.col("type") == "delete")
    return last.select(*[
        F.try_element_at("data", F.lit(name)).try_cast(kind).alias(name) for name, kind in columns.items()
    ])
