"""Windowed statistics of the four subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..codes import KEYWORD_SEARCH
from ..functions import span_text
from .measures import PRODUCT_FLAGS, PRODUCT_SUMS, VISITOR_DIMS, VISITOR_MEASURES

# Fixed size of the statistics window.
WINDOW = "10 seconds"


def union_measures(branches: list[DataFrame]) -> DataFrame:
    """Union of measure rows; a branch that lacks a measure counts as 0 for it."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    kinds = dict(merged.dtypes)
    return merged.selectExpr(*[
        f"coalesce({name}, CAST(0 AS {kinds[name]})) AS {name}" if name in PRODUCT_SUMS or name in PRODUCT_FLAGS else name
        for name in merged.columns
    ])


def visitor_stats(measures: DataFrame, size: str = WINDOW, time: str = "rowtime") -> DataFrame:
    """Sum all visitor measures per window and the four visitor dimensions."""
    totals = measures.groupBy(F.window(time, size).alias("w"), *VISITOR_DIMS).agg(
        *[F.expr(f"sum({name}) AS {name}") for name in VISITOR_MEASURES]
    )
    return totals.select(*span_text("w"), *VISITOR_DIMS, *VISITOR_MEASURES)


def product_stats(measures: DataFrame, size: str = WINDOW, time: str = "rowtime") -> DataFrame:
    """Sum all product measures and count distinct orders per window and product.

    Two levels: the first folds the rows of one order, the second counts orders by
    flag. That counts three kinds of order id exactly in one pass, without a row
    expansion and without sets in memory, and both levels combine before they
    shuffle. It also runs on a stream in append mode.
    """
    sums = [name for name in PRODUCT_SUMS if name in measures.columns]
    flags = [name for name in PRODUCT_FLAGS if name in measures.columns]
    per_order = measures.groupBy(F.window(time, size).alias("w"), "sku_id", "order_id").agg(
        *[F.expr(f"sum({name}) AS {name}") for name in sums], *[F.expr(f"max({name}) AS {name}") for name in flags]
    )
    counts = {"ordered": "order_ct", "paid": "paid_order_ct", "refunded": "refund_order_ct"}
    kinds = {name: "BIGINT" if PRODUCT_SUMS[name] == "bigint" else "DECIMAL(26,2)" for name in sums}
    totals = per_order.groupBy("w", "sku_id").agg(
        *[F.expr(f"CAST(sum({name}) AS {kinds[name]}) AS {name}") for name in sums],
        *[F.expr(f"CAST(sum(IF(order_id IS NULL, 0, {flag})) AS BIGINT) AS {counts[flag]}") for flag in flags],
    )
    return totals.select(*span_text("w"), "sku_id", *sums, *[counts[flag] for flag in flags])


def keyword_stats(keywords: DataFrame, size: str = WINDOW, source: str = KEYWORD_SEARCH, time: str = "rowtime") -> DataFrame:
    """Count keywords per window."""
    counted = keywords.groupBy(F.window(time, size).alias("w"), "keyword").agg(F.count("*").alias("ct"))
    return counted.select("keyword", "ct", F.lit(source).alias("source"), *span_text("w"))


def province_stats(wide: DataFrame, size: str = WINDOW, time: str = "rowtime") -> DataFrame:
    """Order amount and distinct orders per window and province, in two levels."""
    places = {
        "province_id": "province_id", "province_name": "province_name", "area_code": "province_area_code",
        "iso_code": "province_iso_code", "iso_3166_2": "province_3166_2_code",
    }
    rows = wide.selectExpr(*[f"{c} AS {name}" for name, c in places.items()], "order_id", "split_total_amount", time)
    per_order = rows.groupBy(F.window(time, size).alias("w"), *places, "order_id").agg(
        F.sum("split_total_amount").alias("order_amount")
    )
    totals = per_order.groupBy("w", *places).agg(
        F.sum("order_amount").cast("decimal(26,2)").alias("order_amount"),
        F.count("order_id").alias("order_count"),
    )
    return totals.select(*span_text("w"), *places, "order_amount", "order_count")


def stamp(stats: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add the processing time in milliseconds and bring columns into sink order."""
    return stats.withColumn("ts", F.unix_timestamp() * 1000).select(*columns)
