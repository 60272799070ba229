"""Row types of the warehouse layers. Names and orders are fixed values."""

from __future__ import annotations

# Behaviour log (ODS and page log): one JSON object per row.
LOG_SCHEMA = (
    "common STRUCT<mid: STRING, vc: STRING, ch: STRING, ar: STRING, is_new: STRING>, "
    "page STRUCT<page_id: STRING, last_page_id: STRING, item: STRING, during_time: BIGINT>, "
    "displays ARRAY<MAP<STRING, STRING>>, "
    "`start` MAP<STRING, STRING>, "
    "ts BIGINT"
)

# The same page log, read with open maps by the keyword job.
PAGE_MAP_SCHEMA = "common MAP<STRING, STRING>, page MAP<STRING, STRING>, ts BIGINT"

# Change row after normalising, and the raw change envelope before it.
CHANGE_SCHEMA = "database STRING, `table` STRING, type STRING, data MAP<STRING, STRING>"
ENVELOPE_SCHEMA = (
    "source STRUCT<db: STRING, `table`: STRING>, op STRING, "
    "before MAP<STRING, STRING>, after MAP<STRING, STRING>, ts_ms BIGINT"
)

# Routing rules.
RULE_COLUMNS = (
    "source_table", "operate_type", "sink_type", "sink_table", "sink_columns", "sink_pk", "sink_extend",
)
SINK_DIM = "hbase"
SINK_FACT = "kafka"

MONEY = "DECIMAL(16,2)"

ORDER_INFO_SCHEMA = (
    f"id BIGINT, province_id BIGINT, order_status STRING, user_id BIGINT, total_amount {MONEY}, "
    f"activity_reduce_amount {MONEY}, coupon_reduce_amount {MONEY}, original_total_amount {MONEY}, "
    f"feight_fee {MONEY}, expire_time STRING, create_time STRING, operate_time STRING"
)
ORDER_DETAIL_SCHEMA = (
    f"id BIGINT, order_id BIGINT, sku_id BIGINT, order_price {MONEY}, sku_num BIGINT, sku_name STRING, "
    f"create_time STRING, split_total_amount {MONEY}, split_activity_amount {MONEY}, split_coupon_amount {MONEY}"
)
PAYMENT_INFO_SCHEMA = (
    f"id BIGINT, order_id BIGINT, user_id BIGINT, total_amount {MONEY}, subject STRING, "
    "payment_type STRING, create_time STRING, callback_time STRING"
)
FAVOR_SCHEMA = "sku_id BIGINT, create_time STRING"
CART_SCHEMA = FAVOR_SCHEMA
REFUND_SCHEMA = f"sku_id BIGINT, order_id BIGINT, refund_amount {MONEY}, create_time STRING"
COMMENT_SCHEMA = "sku_id BIGINT, appraise STRING, create_time STRING"

ORDER_WIDE_COLUMNS = {
    "detail_id": "BIGINT", "order_id": "BIGINT", "sku_id": "BIGINT", "order_price": MONEY,
    "sku_num": "BIGINT", "sku_name": "STRING", "province_id": "BIGINT", "order_status": "STRING",
    "user_id": "BIGINT", "total_amount": MONEY, "activity_reduce_amount": MONEY,
    "coupon_reduce_amount": MONEY, "original_total_amount": MONEY, "feight_fee": MONEY,
    "split_feight_fee": MONEY, "split_activity_amount": MONEY, "split_coupon_amount": MONEY,
    "split_total_amount": MONEY, "expire_time": "STRING", "create_time": "STRING",
    "operate_time": "STRING", "create_date": "STRING", "create_hour": "STRING",
    "province_name": "STRING", "province_area_code": "STRING", "province_iso_code": "STRING",
    "province_3166_2_code": "STRING", "user_age": "INT", "user_gender": "STRING", "spu_id": "BIGINT",
    "tm_id": "BIGINT", "category3_id": "BIGINT", "spu_name": "STRING", "tm_name": "STRING",
    "category3_name": "STRING",
}
ORDER_WIDE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in ORDER_WIDE_COLUMNS.items())

PAYMENT_WIDE_COLUMNS = (
    "payment_id", "subject", "payment_type", "payment_create_time", "callback_time", "detail_id",
    "order_id", "sku_id", "order_price", "sku_num", "sku_name", "province_id", "order_status", "user_id",
    "total_amount", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount",
    "feight_fee", "split_feight_fee", "split_activity_amount", "split_coupon_amount",
    "split_total_amount", "order_create_time", "province_name", "province_area_code",
    "province_iso_code", "province_3166_2_code", "user_age", "user_gender", "spu_id", "tm_id",
    "category3_id", "spu_name", "tm_name", "category3_name",
)

# Statistics tables in sink order.
VISITOR_STATS_COLUMNS = (
    "stt", "edt", "vc", "ch", "ar", "is_new", "uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum", "ts",
)
PRODUCT_STATS_COLUMNS = (
    "stt", "edt", "sku_id", "sku_name", "sku_price", "spu_id", "spu_name", "tm_id", "tm_name",
    "category3_id", "category3_name", "display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num",
    "order_amount", "order_ct", "payment_amount", "paid_order_ct", "refund_order_ct", "refund_amount",
    "comment_ct", "good_comment_ct", "ts",
)
KEYWORD_STATS_COLUMNS = ("keyword", "ct", "source", "stt", "edt", "ts")
PROVINCE_STATS_COLUMNS = (
    "stt", "edt", "province_id", "province_name", "area_code", "iso_code", "iso_3166_2",
    "order_amount", "order_count", "ts",
)

# Topic names the jobs read and write by default.
TOPICS = {
    "log": "ods_base_log", "changes": "ods_base_db_m",
    "page": "dwd_page_log", "start": "dwd_start_log", "display": "dwd_display_log",
    "order": "dwd_order_info", "detail": "dwd_order_detail", "payment": "dwd_payment_info",
    "cart": "dwd_cart_info", "favor": "dwd_favor_info", "refund": "dwd_order_refund_info",
    "comment": "dwd_comment_info",
    "unique_visitor": "dwm_unique_visitor", "bounce": "dwm_user_jump_detail",
    "order_wide": "dwm_order_wide", "payment_wide": "dwm_payment_wide",
}

# Dimension tables and the columns that lookups read.
DIMENSION_TABLES = {
    "user": ("dim_user_info", ["id", "gender", "birthday"]),
    "province": ("dim_base_province", ["id", "name", "area_code", "iso_code", "iso_3166_2"]),
    "sku": ("dim_sku_info", ["id", "sku_name", "spu_id", "category3_id", "tm_id", "price"]),
    "spu": ("dim_spu_info", ["id", "spu_name"]),
    "category3": ("dim_base_category3", ["id", "name"]),
    "trademark": ("dim_base_trademark", ["id", "tm_name"]),
}
