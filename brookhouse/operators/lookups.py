"""Dimension lookups: left joins to keyed snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame, functions as F


class Near(Protocol):
    """A dimension that gives the rows of some keys without a scan of all."""

    def near(self, keys: DataFrame) -> DataFrame: ...


def rows_near(dimension: DataFrame | Near, facts: DataFrame, key: str) -> DataFrame:
    """The dimension's rows, at least those that `facts` ask for by `key`."""
    return dimension if isinstance(dimension, DataFrame) else dimension.near(facts.select(f"`{key}`"))


def lookup(
    facts: DataFrame, dimension: DataFrame, on: Mapping[str, str], take: Mapping[str, str], unique: bool = True, few: bool = False
) -> DataFrame:
    """Add columns of the matching dimension row; rows without a match stay, with nulls.

    `on` maps fact columns to SQL expressions over the dimension (all must be
    equal), `take` maps output columns to such expressions. A taken name that exists
    in `facts` is replaced where a dimension row was found.

    There is no broadcast hint. Spark broadcasts the dimension when the measured
    size is under `spark.sql.autoBroadcastJoinThreshold` and shuffles otherwise; a
    snapshot with unique keys reaches that shuffle directly, so adaptive execution
    can split a hot key or the rows without a key.

    Pass `unique=False` when keys may repeat: one row per key is kept. Pass `few=True` when the facts
    are a small batch: the dimension is first reduced to the keys of the batch by an inner join, in
    which Spark may broadcast those keys, so that a large dimension is scanned but not shuffled.
    """
    keys = [f"_key{i}" for i in range(len(on))]
    picked = dimension.selectExpr(
        *[f"{value} AS {key}" for key, value in zip(keys, on.values())],
        *[f"{value} AS `_dim_{name}`" for name, value in take.items()],
        "true AS _found",
    )
    if few:
        asked = facts.selectExpr(*[f"`{fact}` AS {key}" for key, fact in zip(keys, on)]).distinct()
        picked = picked.join(asked, keys)
    if not unique:
        picked = picked.dropDuplicates(keys)
    condition = F.expr(" AND ".join(f"`{fact}` = {key}" for key, fact in zip(keys, on)))
    kept = [
        f"IF(_found, `_dim_{name}`, `{name}`) AS `{name}`" if name in take else f"`{name}`" for name in facts.columns
    ]
    added = [f"`_dim_{name}` AS `{name}`" for name in take if name not in facts.columns]
    return facts.join(picked, condition, "left").selectExpr(*kept, *added)


def by_id(
    facts: DataFrame, dimension: DataFrame | Near, key: str, take: Mapping[str, str], few: bool = False
) -> DataFrame:
    """Lookup on the numeric key of a dimension that stores all columns as strings."""
    return lookup(facts, rows_near(dimension, facts, key), {key: "TRY_CAST(ID AS BIGINT)"}, take, few=few)
