"""The ten jobs of the warehouse on tables.

Layers: raw logs and change rows (ODS), routed facts and dimensions (DWD), visitor
facts and wide rows (DWM), windowed statistics (DWS). Each job maps DataFrames to
DataFrames; `stream_jobs` connects the same operators to topics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import day_of, put_field
from ..functions.keywords import Tokenizer, explode_keywords
from ..operators import measures as m
from ..operators import stats
from ..operators.changes import valid_changes
from ..operators.parse import parse_json
from ..operators.routing import LINE, Logs, Routed, route_changes, split_logs
from ..operators.visitors import bounces, first_per_day, is_entry, repair_new_flag
from ..operators.wide import (
    ORDER_DETAIL_BOUNDS, PAYMENT_ORDER_BOUNDS, Dimensions, enrich_order_wide, enrich_products,
    order_with_detail, payment_wide, with_rowtime,
)
from ..schemas import CHANGE_SCHEMA, LOG_SCHEMA

# Fixed: seconds an entry page waits for a second page.
BOUNCE_SECONDS = 10


class RoutedLogs(NamedTuple):
    logs: Logs
    rejects: DataFrame


class RoutedChanges(NamedTuple):
    routed: Routed
    rejects: DataFrame


def with_device(pages: DataFrame) -> DataFrame:
    """Page rows with the device as `_mid` and a stable order among equal times."""
    return pages.withColumn("_mid", F.col("common.mid")).withColumn("_tie", F.xxhash64("common", "page"))


def repair_logs(logs: DataFrame) -> DataFrame:
    """Page rows with the new-visitor flag repaired inside `common`."""
    flat = logs.withColumn("_mid", F.col("common.mid")).withColumn("_flag", F.col("common.is_new"))
    fixed = repair_new_flag(flat, "_mid", "_flag", day_of("ts"))
    return fixed.withColumn("common", put_field("common", "is_new", F.col("_flag"))).drop("_mid", "_flag")


def log_routing(lines: DataFrame) -> RoutedLogs:
    """Raw log strings to page, start and display logs, with the new-visitor flag repaired.

    Page and start logs carry the whole text of their row in `LINE`; `page_text` and `start_text` write it.
    """
    parsed = parse_json(lines, LOG_SCHEMA, line=LINE)
    # Only page logs carry the flag on, so only they take the way of the repair.
    plain = split_logs(parsed.rows)
    return RoutedLogs(plain._replace(page=split_logs(repair_logs(parsed.rows)).page), parsed.rejects)


def database_routing(lines: DataFrame, rules: DataFrame) -> RoutedChanges:
    """Raw change strings to dimension rows and fact rows, as the rules say."""
    parsed = parse_json(lines, CHANGE_SCHEMA)
    return RoutedChanges(route_changes(valid_changes(parsed.rows), rules), parsed.rejects)


def unique_visitors(pages: DataFrame) -> DataFrame:
    """The first entry page of each device and day."""
    keyed = with_device(pages)
    first = first_per_day(keyed, "_mid", day_of("ts"), ["ts", "_tie"], is_entry("page.last_page_id"))
    return first.select(*pages.columns)


def bounced_visitors(pages: DataFrame, timeout_seconds: int = BOUNCE_SECONDS) -> DataFrame:
    """Entry pages that no other page of the device follows in time."""
    keyed = with_device(pages).withColumn("_time", F.timestamp_millis("ts"))
    found = bounces(keyed, "_mid", "_time", ["_tie"], is_entry("page.last_page_id"), timeout_seconds)
    return found.select(*pages.columns)


def order_wide(
    orders: DataFrame,
    details: DataFrame,
    dims: Dimensions,
    as_of: Column,
    bounds: tuple[float, float] = ORDER_DETAIL_BOUNDS,
) -> DataFrame:
    """Orders joined to details and to six dimensions."""
    wide = order_with_detail(with_rowtime(orders), with_rowtime(details), bounds)
    return enrich_order_wide(wide, dims, as_of)


def payment_wide_rows(
    payments: DataFrame, wide: DataFrame, bounds: tuple[float, float] = PAYMENT_ORDER_BOUNDS
) -> DataFrame:
    """Payments, at their callback time, joined to the order wide rows."""
    return payment_wide(with_rowtime(payments, "callback_time"), with_rowtime(wide), bounds)


def visitor_statistics(
    pages: DataFrame, size: str = stats.WINDOW, timeout_seconds: int = BOUNCE_SECONDS
) -> DataFrame:
    """Visitor measures per window; unique visits and bounces come from the same pages."""
    rows = (
        m.page_views(pages)
        .unionByName(m.unique_visits(unique_visitors(pages)))
        .unionByName(m.bounced_visits(bounced_visitors(pages, timeout_seconds)))
    )
    return stats.visitor_stats(rows.withColumn("rowtime", F.timestamp_millis("ts")), size)


@dataclass(frozen=True)
class ProductFacts:
    """Inputs of the product subject."""

    pages: DataFrame
    order_wide: DataFrame
    payment_wide: DataFrame
    favors: DataFrame
    carts: DataFrame
    refunds: DataFrame
    comments: DataFrame


def product_measures(facts: ProductFacts, each: Callable[[DataFrame], DataFrame] = lambda branch: branch) -> DataFrame:
    """All branches of the product subject in one table; `each` is applied to every branch first."""
    return stats.union_measures([each(branch) for branch in (
        m.product_clicks(facts.pages),
        m.product_displays(facts.pages),
        m.product_favors(facts.favors),
        m.product_carts(facts.carts),
        m.product_orders(facts.order_wide),
        m.product_payments(facts.payment_wide),
        m.product_refunds(facts.refunds),
        m.product_comments(facts.comments),
    )])


def product_statistics(facts: ProductFacts, dims: Dimensions, size: str = stats.WINDOW) -> DataFrame:
    """Product measures per window and product; names are looked up after the aggregation."""
    return enrich_products(stats.product_stats(product_measures(facts), size), dims, with_price=True)


def keyword_statistics(
    pages: DataFrame, size: str = stats.WINDOW, page_id: str = "good_list", tokenizer: Tokenizer | None = None
) -> DataFrame:
    """Searched keywords per window; `pages` has open maps."""
    words = explode_keywords(m.searches(pages, page_id), "fullword", tokenizer=tokenizer)
    return stats.keyword_stats(words, size)


def province_statistics(wide: DataFrame, size: str = stats.WINDOW) -> DataFrame:
    """Order amount and order count per window and province."""
    return stats.province_stats(with_rowtime(wide), size)
