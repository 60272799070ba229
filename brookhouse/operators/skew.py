"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.values import all_of

# A key is heavy when it holds more than one part in HEAVY_PARTS of all rows.
# By arithmetic there are fewer than HEAVY_PARTS such keys, which is the proven
# bound of the broadcast below, whatever the size of the data.
HEAVY_PARTS = 1000


def heavy_keys(grouped: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Heavy keys of a grouped table with row counts, with `pieces` to split each into.

    A key with share s of the rows gets ceil(s * HEAVY_PARTS) pieces, so every
    piece is about 1 / HEAVY_PARTS of the data.
    """
    # Asking for every column keeps all uses of `grouped` alike, so that they share
    # one shuffle instead of pruning it into three different ones.
    filled = all_of([F.col(name).isNotNull() for name in grouped.columns])
    used = grouped.filter(filled)
    total = used.agg(F.sum(n)).scalar()
    share = F.col(n) * F.lit(float(HEAVY_PARTS)) / total
    return used.filter(share > 1).select(*keys, F.ceil(share).alias("pieces"))


def hashable(kind: DataType) -> bool:
    """Hash functions take no maps, nor anything that holds one."""
    if isinstance(kind, StructType):
        return all(hashable(field.dataType) for field in kind.fields)
    if isinstance(kind, ArrayType):
        return hashable(kind.elementType)
    return not isinstance(kind, MapType)


def spread_join(facts: DataFrame, grouped: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Left join of `facts` to `grouped`, which has one row and a row count `n` per key.

    Adaptive skew handling does not see a join input that ends in an
    aggregation, so heavy keys are salted here: fact rows of a heavy key are
    dealt by a hash of their content over its pieces, and its one row of
    `grouped` is repeated once per piece (fewer than 2 * HEAVY_PARTS rows in all).
    """
    heavy = F.broadcast(heavy_keys(grouped, keys, n))
    content = [f.name for f in facts.schema.fields if hashable(f.dataType)]
    salted = (
        facts.join(heavy, keys, "left")
        .withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*content), F.col("pieces")), F.lit(0)))
        .drop("pieces")
    )
    # The count is asked for here as well, so that this use of `grouped` is like the others.
    copies = F.when(F.col(n) > 0, F.coalesce("pieces", F.lit(1))).otherwise(1)
    repeated = (
        grouped.join(heavy, keys, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
        .drop("pieces", n)
    )
    return salted.join(repeated, [*keys, "_piece"], "left").drop("_piece")
