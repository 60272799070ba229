"""Order and payment wide rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import add_computed, age_years, to_time
from ..schemas import ORDER_WIDE_COLUMNS, PAYMENT_WIDE_COLUMNS
from .intervals import interval_join
from .lookups import Near, by_id, rows_near

# Fixed bounds of the two joins, in seconds.
ORDER_DETAIL_BOUNDS = (-5, 5)
PAYMENT_ORDER_BOUNDS = (-1800, 0)

# Wide columns by the table they come from.
_FROM_ORDER = {
    "order_id": "id", **{name: name for name in (
        "province_id", "order_status", "user_id", "total_amount", "activity_reduce_amount",
        "coupon_reduce_amount", "original_total_amount", "feight_fee", "create_time",
    )},
}
_FROM_DETAIL = {
    "detail_id": "id", **{name: name for name in (
        "sku_id", "order_price", "sku_num", "sku_name", "split_activity_amount",
        "split_coupon_amount", "split_total_amount",
    )},
}


@dataclass(frozen=True)
class Dimensions:
    """The six dimension snapshots, all columns strings, key column `ID`.

    Those that grow with the business may be given by key instead; the product then needs `few`.
    """

    user: DataFrame | Near
    province: DataFrame
    sku: DataFrame | Near
    spu: DataFrame
    category3: DataFrame
    trademark: DataFrame


def _tagged(df: DataFrame, prefix: str, names: Mapping[str, str], time: str) -> DataFrame:
    return df.selectExpr(
        *[f"`{source}` AS `{prefix}{name}`" for name, source in names.items()], f"`{time}` AS {prefix}time"
    )


def order_with_detail(
    orders: DataFrame, details: DataFrame, bounds: tuple[float, float] = ORDER_DETAIL_BOUNDS,
    time: str = "rowtime", spread: int = 1,
) -> DataFrame:
    """Join orders to their details and lay out the 35 wide columns.

    Both inputs carry an event-time column. The date and hour come from the order's
    `create_time`; columns nobody fills stay null.
    """
    order_side = _tagged(orders, "o_", _FROM_ORDER, time)
    detail_side = _tagged(details, "d_", {**_FROM_DETAIL, "order_id": "order_id"}, time)
    joined = interval_join(order_side, detail_side, "o_order_id", "d_order_id", "o_time", "d_time", *bounds, spread)
    filled = {
        **{name: f"o_{name}" for name in _FROM_ORDER},
        **{name: f"d_{name}" for name in _FROM_DETAIL},
        "create_date": "substring(o_create_time, 1, 10)",
        "create_hour": "substring(o_create_time, 12, 2)",
    }
    return joined.selectExpr(*[
        f"CAST({filled.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in ORDER_WIDE_COLUMNS.items()
    ])


def product_dimension(dims: Dimensions, skus: DataFrame | None = None) -> DataFrame:
    """The product dimension with the names of its unit, category and trademark.

    They depend on the product alone, so the snowflake is joined between the
    dimensions, and facts need one lookup in place of four. With `skus`, a few rows with a
    `sku_id`, only their products are looked up.
    """
    few = skus is not None
    sku = dims.sku if skus is None else rows_near(dims.sku, skus, "sku_id").join(
        skus.select(F.col("sku_id").alias("_sku")).distinct(), F.expr("TRY_CAST(ID AS BIGINT) = _sku"))
    products = sku.selectExpr(
        "ID", "SKU_NAME AS sku_name", "TRY_CAST(PRICE AS DECIMAL(16,2)) AS sku_price",
        *[f"TRY_CAST({name.upper()} AS BIGINT) AS {name}" for name in ("spu_id", "category3_id", "tm_id")],
    )
    products = by_id(products, dims.spu, "spu_id", {"spu_name": "SPU_NAME"}, few)
    products = by_id(products, dims.category3, "category3_id", {"category3_name": "NAME"}, few)
    return by_id(products, dims.trademark, "tm_id", {"tm_name": "TM_NAME"}, few)


def enrich_products(df: DataFrame, dims: Dimensions, with_price: bool = False, few: bool = False) -> DataFrame:
    """Product, unit, category and trademark of rows with a `sku_id`; `few` as in `lookup`."""
    names = ["sku_name", "spu_id", "category3_id", "tm_id", "spu_name", "category3_name", "tm_name"]
    if with_price:
        names.append("sku_price")
    return by_id(df, product_dimension(dims, df if few else None), "sku_id", {name: name for name in names})


def enrich_user(wide: DataFrame, users: DataFrame | Near, as_of: Column, few: bool = False) -> DataFrame:
    """Gender, and the age on the day `as_of`."""
    found = by_id(wide, users, "user_id", {"user_gender": "GENDER", "_birthday": "TRY_CAST(BIRTHDAY AS DATE)"}, few)
    return found.withColumn("user_age", age_years("_birthday", as_of)).drop("_birthday")


def enrich_province(wide: DataFrame, provinces: DataFrame, few: bool = False) -> DataFrame:
    return by_id(wide, provinces, "province_id", {
        "province_name": "NAME", "province_area_code": "AREA_CODE",
        "province_iso_code": "ISO_CODE", "province_3166_2_code": "ISO_3166_2",
    }, few)


def enrich_order_wide(wide: DataFrame, dims: Dimensions, as_of: Column, few: bool = False) -> DataFrame:
    """Fill all dimension columns of order wide rows; `few` as in `lookup`."""
    wide = enrich_province(enrich_user(wide, dims.user, as_of, few), dims.province, few)
    return enrich_products(wide, dims, few=few).select(*ORDER_WIDE_COLUMNS)


def payment_wide(
    payments: DataFrame, wide: DataFrame, bounds: tuple[float, float] = PAYMENT_ORDER_BOUNDS,
    time: str = "rowtime", spread: int = 1,
) -> DataFrame:
    """Payments joined to the wide rows of their order.

    Where both sides have a column of the same name the payment's value is used.
    """
    from_payment = {
        "payment_id": "id", "payment_create_time": "create_time",
        **{name: name for name in ("subject", "payment_type", "callback_time", "order_id", "user_id", "total_amount")},
    }
    from_wide = {
        "order_create_time": "create_time", "order_id": "order_id",
        **{name: name for name in PAYMENT_WIDE_COLUMNS if name in wide.columns and name not in from_payment},
    }
    pay_side = _tagged(payments, "p_", from_payment, time)
    wide_side = _tagged(wide, "w_", from_wide, time)
    joined = interval_join(pay_side, wide_side, "p_order_id", "w_order_id", "p_time", "w_time", *bounds, spread)
    return joined.selectExpr(*[
        f"{'p' if name in from_payment else 'w'}_{name} AS {name}" for name in PAYMENT_WIDE_COLUMNS
    ])


def with_rowtime(df: DataFrame, column: str = "create_time", rowtime: str = "rowtime") -> DataFrame:
    """Event time from a datetime string column."""
    return add_computed(df, **{rowtime: to_time(column)})


# Columns that a second row may fill in, and columns that always stay the first row's.
FILLABLE = (
    "order_status", "create_time", "create_date", "coupon_reduce_amount", "activity_reduce_amount",
    "original_total_amount", "feight_fee", "total_amount", "user_id", "sku_id", "sku_name",
    "order_price", "sku_num",
)


def merge_wide(first: DataFrame, second: DataFrame, keys: list[str], fillable: tuple[str, ...] = FILLABLE) -> DataFrame:
    """Fill null columns of `first` from the row of `second` with the same keys."""
    other = second.selectExpr(*keys, *[f"`{name}` AS `_other_{name}`" for name in fillable])
    return first.join(other, keys, "left").selectExpr(*[
        f"coalesce(`{name}`, `_other_{name}`) AS `{name}`" if name in fillable else f"`{name}`"
        for name in first.columns
    ])
