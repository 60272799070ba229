"""Facts to measure rows, one shape per statistics subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..codes import GOOD_APPRAISE
from ..functions import map_value, to_time
from .visitors import is_entry

VISITOR_DIMS = ("vc", "ch", "ar", "is_new")
VISITOR_MEASURES = ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")


def _visitor(df: DataFrame, **measures: str) -> DataFrame:
    return df.selectExpr(
        *[f"common.{name} AS {name}" for name in VISITOR_DIMS],
        *[f"CAST({measures.get(name, '0')} AS BIGINT) AS {name}" for name in VISITOR_MEASURES],
        "ts",
    )


def page_views(pages: DataFrame) -> DataFrame:
    """One view per page row, one visit per entry row, and the time spent."""
    marked = pages.withColumn("_entry", is_entry("page.last_page_id"))
    return _visitor(marked, pv_ct="1", sv_ct="_entry", dur_sum="coalesce(page.during_time, 0)")


def unique_visits(pages: DataFrame) -> DataFrame:
    return _visitor(pages, uv_ct="1")


def bounced_visits(pages: DataFrame) -> DataFrame:
    return _visitor(pages, uj_ct="1")


# Measures of the product subject with the type each is summed in. Orders,
# payments and refunds are counted by distinct order id.
PRODUCT_SUMS = {
    "display_ct": "bigint", "click_ct": "bigint", "favor_ct": "bigint", "cart_ct": "bigint",
    "order_sku_num": "bigint", "order_amount": "decimal(16,2)", "payment_amount": "decimal(16,2)",
    "refund_amount": "decimal(16,2)", "comment_ct": "bigint", "good_comment_ct": "bigint",
}
PRODUCT_FLAGS = ("ordered", "paid", "refunded")


def _product(df: DataFrame, sku: str, rowtime: Column, order_id: str = "NULL", **measures: str) -> DataFrame:
    """Rows of one branch; `measures` maps measures and flags to SQL expressions."""
    kinds = {**PRODUCT_SUMS, **dict.fromkeys(PRODUCT_FLAGS, "INT")}
    return df.withColumn("rowtime", rowtime).selectExpr(
        f"CAST({sku} AS BIGINT) AS sku_id", "rowtime", f"CAST({order_id} AS BIGINT) AS order_id",
        *[f"CAST({value} AS {kinds[name]}) AS {name}" for name, value in measures.items()],
    )


def product_clicks(pages: DataFrame) -> DataFrame:
    """Pages that show one product in detail."""
    shown = pages.filter("page.page_id = 'good_detail'")
    return _product(shown, "TRY_CAST(page.item AS BIGINT)", F.timestamp_millis("ts"), click_ct="1")


def product_displays(pages: DataFrame) -> DataFrame:
    """Displayed items that are products."""
    displays = pages.selectExpr("ts", "explode(displays) AS display")
    products = displays.filter(map_value("display", "item_type") == "sku_id")
    sku = "TRY_CAST(try_element_at(display, 'item') AS BIGINT)"
    return _product(products, sku, F.timestamp_millis("ts"), display_ct="1")


def product_favors(favors: DataFrame) -> DataFrame:
    return _product(favors, "sku_id", to_time("create_time"), favor_ct="1")


def product_carts(carts: DataFrame) -> DataFrame:
    return _product(carts, "sku_id", to_time("create_time"), cart_ct="1")


def product_orders(wide: DataFrame) -> DataFrame:
    return _product(
        wide, "sku_id", to_time("create_time"), "order_id",
        order_sku_num="sku_num", order_amount="split_total_amount", ordered="1",
    )


def product_payments(wide: DataFrame) -> DataFrame:
    return _product(
        wide, "sku_id", to_time("callback_time"), "order_id", payment_amount="split_total_amount", paid="1"
    )


def product_refunds(refunds: DataFrame) -> DataFrame:
    return _product(
        refunds, "sku_id", to_time("create_time"), "order_id", refund_amount="refund_amount", refunded="1"
    )


def product_comments(comments: DataFrame) -> DataFrame:
    return _product(
        comments, "sku_id", to_time("create_time"), comment_ct="1",
        good_comment_ct=f"IF(appraise = '{GOOD_APPRAISE}', 1, 0)",
    )


def searches(pages: DataFrame, page_id: str = "good_list") -> DataFrame:
    """Search texts of result-list pages; `page` is an open map."""
    item = map_value("page", "item")
    return pages.filter((map_value("page", "page_id") == page_id) & item.isNotNull()).select(
        item.alias("fullword"), F.timestamp_millis((F.floor(F.col("ts") / 1000) * 1000).cast("bigint")).alias("rowtime")
    )
