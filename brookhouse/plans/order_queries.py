"""Queries on orders: interval joins, lookups, wide rows, order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..codes import code_table
from ..operators import (
    interval_join, lookup, merge_wide, order_with_detail, parse_json, province_stats as province_stats_of,
    to_json_value, union_measures, with_rowtime,
)
from ..operators import measures as m
from ..operators.wide import enrich_province, enrich_user, enrich_products
from ..schemas import ORDER_DETAIL_SCHEMA
from . import jobs, shop
from .registry import query
from .shop import Tables
from .visitor_queries import PAGES_SQL

DAYS_120 = 120 * 86400
BOUNDS = (-DAYS_120, DAYS_120)
def _as_of() -> Column:
    return F.lit("2024-06-30").cast("date")

DIMS_SQL = """
dim_user AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
                    CAST(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS DATE) AS birthday FROM customer),
dim_province AS (SELECT n_nationkey AS id, n_name AS name, CAST(n_nationkey + 100 AS VARCHAR) AS area_code,
                        'N-' || n_nationkey AS iso_code, 'R-' || n_regionkey AS iso_3166_2 FROM nation),
dim_sku AS (SELECT p_partkey AS id, p_name AS sku_name, CAST(p_size AS BIGINT) AS spu_id,
                   CAST(p_size % 7 AS BIGINT) AS category3_id, CAST(substr(p_brand, 7, 2) AS BIGINT) AS tm_id,
                   CAST(p_retailprice AS DECIMAL(16,2)) AS price FROM part)
"""

WIDE_SQL = """
o AS (SELECT o_orderkey AS id, o_custkey % 30 AS province_id,
             CASE o_orderstatus WHEN 'F' THEN '1004' WHEN 'P' THEN '1002' ELSE '1001' END AS order_status,
             o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(16,2)) AS total_amount, o_orderdate FROM orders),
wide AS (
  SELECT l_orderkey * 10 + l_linenumber AS detail_id, o.id AS order_id, l_partkey AS sku_id,
         CAST(l_extendedprice AS DECIMAL(16,2)) AS order_price, CAST(l_quantity AS BIGINT) AS sku_num,
         province_id, order_status, user_id, total_amount, total_amount AS original_total_amount,
         CAST(0 AS DECIMAL(16,2)) AS feight_fee, CAST(l_discount AS DECIMAL(16,2)) AS split_activity_amount,
         CAST(l_tax AS DECIMAL(16,2)) AS split_coupon_amount,
         CAST(l_extendedprice AS DECIMAL(16,2)) AS split_total_amount, o_orderdate,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS create_time
  FROM o JOIN lineitem ON o.id = l_orderkey
   AND l_shipdate BETWEEN o_orderdate - INTERVAL 120 DAYS AND o_orderdate + INTERVAL 120 DAYS)
"""

PRODUCT_NAMES_SQL = """
  LEFT JOIN dim_sku s ON s.id = x.sku_id LEFT JOIN supplier u ON u.s_suppkey = s.spu_id
  LEFT JOIN region c ON c.r_regionkey = s.category3_id LEFT JOIN nation m ON m.n_nationkey = s.tm_id
"""


def _wide(t: Tables) -> DataFrame:
    """Wide rows before the dimensions."""
    return order_with_detail(
        with_rowtime(shop.order_info(t.orders)), with_rowtime(shop.order_detail(t.lineitem)), BOUNDS
    )


@query("interval_join_two_sided", """
SELECT o_orderkey, l_partkey, l_linenumber, l_extendedprice, o_totalprice FROM orders JOIN lineitem
  ON o_orderkey = l_orderkey
 AND l_shipdate BETWEEN o_orderdate - INTERVAL 120 DAYS AND o_orderdate + INTERVAL 120 DAYS""")
def interval_join_two_sided(t: Tables) -> DataFrame:
    joined = interval_join(
        t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"),
        t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate"),
        "o_orderkey", "l_orderkey", "o_orderdate", "l_shipdate", *BOUNDS,
    )
    return joined.select("o_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "o_totalprice")


@query("interval_join_one_sided", """
SELECT a.event_id AS pay_id, b.event_id AS order_id, a.value AS pay, b.value AS amt FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view'
 AND b.ts BETWEEN a.ts - INTERVAL 6 HOURS AND a.ts""")
def interval_join_one_sided(t: Tables) -> DataFrame:
    """Hot users are cut into six-hour slots, so views far from a purchase never meet it."""
    pays = t.events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("pay_id"), F.col("user_id").alias("payer"), F.col("ts").alias("pay_ts"),
        F.col("value").alias("pay"),
    )
    views = t.events.filter("event_type = 'view'").select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("view_ts"),
        F.col("value").alias("amt"),
    )
    joined = interval_join(pays, views, "payer", "viewer", "pay_ts", "view_ts", -6 * 3600, 0)
    return joined.select("pay_id", "order_id", "pay", "amt")


@query("order_wide", f"""WITH {DIMS_SQL}, {WIDE_SQL}
SELECT x.detail_id, x.order_id, x.sku_id, x.order_price, x.sku_num, s.sku_name, x.province_id, x.order_status,
       x.user_id, x.total_amount, CAST(0 AS DECIMAL(16,2)) AS activity_reduce_amount,
       CAST(0 AS DECIMAL(16,2)) AS coupon_reduce_amount, x.original_total_amount, x.feight_fee,
       CAST(NULL AS DECIMAL(16,2)) AS split_feight_fee, x.split_activity_amount, x.split_coupon_amount,
       x.split_total_amount, CAST(NULL AS VARCHAR) AS expire_time, x.create_time,
       CAST(NULL AS VARCHAR) AS operate_time, substr(x.create_time, 1, 10) AS create_date,
       substr(x.create_time, 12, 2) AS create_hour, p.name AS province_name, p.area_code AS province_area_code,
       p.iso_code AS province_iso_code, p.iso_3166_2 AS province_3166_2_code,
       CAST(trunc(date_diff('day', d.birthday, DATE '2024-06-30') / 365.0) AS INTEGER) AS user_age,
       d.gender AS user_gender, s.spu_id, s.tm_id, s.category3_id, u.s_name AS spu_name, m.n_name AS tm_name,
       c.r_name AS category3_name
FROM wide x LEFT JOIN dim_user d ON d.id = x.user_id LEFT JOIN dim_province p ON p.id = x.province_id
{PRODUCT_NAMES_SQL}""")
def order_wide(t: Tables) -> DataFrame:
    return jobs.order_wide(
        shop.order_info(t.orders), shop.order_detail(t.lineitem), shop.dimensions(t), _as_of(), BOUNDS
    )


PAYMENT_SQL = """
pay AS (SELECT o_orderkey + 1 AS id, o_orderkey AS order_id, o_custkey AS user_id,
               CAST(CAST(o_totalprice AS DECIMAL(16,2)) + 1 AS DECIMAL(16,2)) AS total_amount,
               o_orderpriority AS subject, o_orderdate AS created,
               o_orderdate + to_minutes(CAST(o_custkey % 60 AS INTEGER)) AS called
        FROM orders WHERE o_orderstatus = 'F'),
paid AS (SELECT p.id AS payment_id, p.subject, p.total_amount AS paid_amount, p.user_id AS payer, p.created, p.called, w.*
         FROM pay p JOIN wide w ON w.order_id = p.order_id
          AND w.o_orderdate BETWEEN p.called - INTERVAL 1800 SECONDS AND p.called)
"""


@query("payment_wide", f"""WITH {DIMS_SQL}, {WIDE_SQL}, {PAYMENT_SQL}
SELECT x.payment_id, x.subject, '1101' AS payment_type, strftime(x.created, '%Y-%m-%d %H:%M:%S') AS payment_create_time,
       strftime(x.called, '%Y-%m-%d %H:%M:%S') AS callback_time, x.detail_id, x.order_id, x.sku_id, x.order_price, x.sku_num,
       s.sku_name, x.province_id, x.order_status, x.payer AS user_id, x.paid_amount AS total_amount,
       CAST(0 AS DECIMAL(16,2)) AS activity_reduce_amount, CAST(0 AS DECIMAL(16,2)) AS coupon_reduce_amount,
       x.original_total_amount, x.feight_fee, CAST(NULL AS DECIMAL(16,2)) AS split_feight_fee, x.split_activity_amount,
       x.split_coupon_amount, x.split_total_amount, x.create_time AS order_create_time, p.name AS province_name,
       p.area_code AS province_area_code, p.iso_code AS province_iso_code, p.iso_3166_2 AS province_3166_2_code,
       CAST(trunc(date_diff('day', d.birthday, DATE '2024-06-30') / 365.0) AS INTEGER) AS user_age,
       d.gender AS user_gender, s.spu_id, s.tm_id, s.category3_id, u.s_name AS spu_name, m.n_name AS tm_name,
       c.r_name AS category3_name
FROM paid x LEFT JOIN dim_user d ON d.id = x.user_id LEFT JOIN dim_province p ON p.id = x.province_id
{PRODUCT_NAMES_SQL}""")
def payment_wide(t: Tables) -> DataFrame:
    return jobs.payment_wide_rows(shop.payment_info(t.orders), order_wide(t))


PROVINCE_SQL = f"""WITH {DIMS_SQL}, {WIDE_SQL},
w AS (SELECT time_bucket(INTERVAL '7 days', o_orderdate, TIMESTAMP '1970-01-01') AS s, * FROM wide)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS stt, strftime(s + INTERVAL '7 days', '%Y-%m-%d %H:%M:%S') AS edt,
       province_id, p.name AS province_name, p.area_code, p.iso_code, p.iso_3166_2,
       CAST(sum(split_total_amount) AS DECIMAL(26,2)) AS order_amount, count(DISTINCT order_id) AS order_count
FROM w LEFT JOIN dim_province p ON p.id = w.province_id GROUP BY s, province_id, p.name, p.area_code, p.iso_code, p.iso_3166_2"""


@query("province_stats", PROVINCE_SQL)
def province_stats(t: Tables) -> DataFrame:
    return jobs.province_statistics(enrich_province(_wide(t), shop.dimensions(t).province), "7 days")


@query("nation_stats", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS stt, strftime(s + INTERVAL '7 days', '%Y-%m-%d %H:%M:%S') AS edt,
       n_nationkey AS province_id, n_name AS province_name,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2))) AS DECIMAL(26,2)) AS order_amount,
       count(DISTINCT l_orderkey) AS order_count
FROM (SELECT *, time_bucket(INTERVAL '7 days', l_shipdate, TIMESTAMP '1970-01-01') AS s FROM lineitem) l
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
GROUP BY s, n_nationkey, n_name""")
def nation_stats(t: Tables) -> DataFrame:
    """Order statistics over every line item, by the customer's nation."""
    places = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", F.col("n_nationkey").cast("bigint").alias("province_id"), F.col("n_name").alias("province_name")
    )
    rows = (
        t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(places, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            "province_id", "province_name", F.col("l_orderkey").alias("order_id"),
            F.col("l_extendedprice").cast("decimal(16,2)").alias("split_total_amount"),
            F.col("l_shipdate").alias("rowtime"),
            *[F.lit(None).cast("string").alias(f"province_{c}") for c in ("area_code", "iso_code", "3166_2_code")],
        )
    )
    stats = province_stats_of(rows, "7 days")
    return stats.select("stt", "edt", "province_id", "province_name", "order_amount", "order_count")


PRODUCT_ROWS_SQL = """
r AS (
  SELECT TRY_CAST(item AS BIGINT) AS sku_id, ts AS t, NULL AS oid, NULL AS pid, NULL AS rid,
         CASE WHEN page_id = 'good_detail' THEN 1 ELSE 0 END AS click, 0 AS disp, 0 AS fav, 0 AS cart, 0 AS num,
         0 AS oa, 0 AS pa, 0 AS ra, 0 AS com, 0 AS good FROM pages_ WHERE event_type = 'view'
  UNION ALL SELECT CAST(k AS BIGINT), ts, NULL, NULL, NULL, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0
    FROM pages_ WHERE event_type = 'view'
  UNION ALL SELECT l_partkey, l_shipdate, NULL, NULL, NULL, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0
    FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT l_partkey, l_shipdate, NULL, NULL, NULL, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0
    FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT sku_id, o_orderdate, order_id, NULL, NULL, 0, 0, 0, 0, sku_num, split_total_amount, 0, 0, 0, 0 FROM wide
  UNION ALL SELECT sku_id, called, NULL, order_id, NULL, 0, 0, 0, 0, 0, 0, split_total_amount, 0, 0, 0 FROM paid
  UNION ALL SELECT l_partkey, l_shipdate, NULL, NULL, l_orderkey, 0, 0, 0, 0, 0, 0, 0,
    CAST(l_extendedprice AS DECIMAL(16,2)), 0, 0 FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_partkey, l_shipdate, NULL, NULL, NULL, 0, 0, 0, 0, 0, 0, 0, 0, 1,
    CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END FROM lineitem WHERE l_linestatus = 'F'),
b AS (SELECT time_bucket(INTERVAL '30 days', t, TIMESTAMP '1970-01-01') AS s, * FROM r),
x AS (SELECT s, sku_id, CAST(sum(disp) AS BIGINT) AS display_ct, CAST(sum(click) AS BIGINT) AS click_ct,
             CAST(sum(fav) AS BIGINT) AS favor_ct, CAST(sum(cart) AS BIGINT) AS cart_ct,
             CAST(sum(num) AS BIGINT) AS order_sku_num, CAST(sum(oa) AS DECIMAL(26,2)) AS order_amount,
             count(DISTINCT oid) AS order_ct, CAST(sum(pa) AS DECIMAL(26,2)) AS payment_amount,
             count(DISTINCT pid) AS paid_order_ct, count(DISTINCT rid) AS refund_order_ct,
             CAST(sum(ra) AS DECIMAL(26,2)) AS refund_amount, CAST(sum(com) AS BIGINT) AS comment_ct,
             CAST(sum(good) AS BIGINT) AS good_comment_ct FROM b GROUP BY s, sku_id)
"""


def _product_facts(t: Tables) -> jobs.ProductFacts:
    wide = _wide(t)
    return jobs.ProductFacts(
        pages=shop.page_logs(t.events),
        order_wide=wide,
        payment_wide=jobs.payment_wide_rows(shop.payment_info(t.orders), wide),
        favors=shop.sku_times(t.lineitem.filter("l_returnflag = 'N'")),
        carts=shop.sku_times(t.lineitem.filter("l_linestatus = 'O'")),
        refunds=shop.refunds(t.lineitem),
        comments=shop.comments(t.lineitem),
    )


@query("product_stats", f"""WITH {PAGES_SQL}, {DIMS_SQL}, {WIDE_SQL}, {PAYMENT_SQL}, {PRODUCT_ROWS_SQL}
SELECT strftime(x.s, '%Y-%m-%d %H:%M:%S') AS stt, strftime(x.s + INTERVAL '30 days', '%Y-%m-%d %H:%M:%S') AS edt,
       x.* EXCLUDE (s), s.sku_name, s.price AS sku_price, s.spu_id, u.s_name AS spu_name, s.tm_id, m.n_name AS tm_name,
       s.category3_id, c.r_name AS category3_name
FROM x {PRODUCT_NAMES_SQL}""")
def product_stats(t: Tables) -> DataFrame:
    return jobs.product_statistics(_product_facts(t), shop.dimensions(t), "30 days")


@query("union_defaults", f"""WITH {PAGES_SQL}
SELECT sku_id, kind_ct.* FROM (
  SELECT l_partkey AS sku_id, {{'favor_ct': CAST(1 AS BIGINT), 'cart_ct': CAST(0 AS BIGINT),
         'refund_amount': CAST(0 AS DECIMAL(16,2)), 'click_ct': CAST(0 AS BIGINT)}} AS kind_ct FROM lineitem
  UNION ALL SELECT l_partkey, {{'favor_ct': 0, 'cart_ct': 1, 'refund_amount': 0, 'click_ct': 0}} FROM lineitem
  UNION ALL SELECT l_partkey, {{'favor_ct': 0, 'cart_ct': 0, 'refund_amount': CAST(l_extendedprice AS DECIMAL(16,2)),
         'click_ct': 0}} FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT CAST(item AS BIGINT), {{'favor_ct': 0, 'cart_ct': 0, 'refund_amount': 0, 'click_ct': 1}}
    FROM pages_ WHERE page_id = 'good_detail') y""")
def union_defaults(t: Tables) -> DataFrame:
    rows = union_measures([
        m.product_favors(shop.sku_times(t.lineitem)),
        m.product_carts(shop.sku_times(t.lineitem)),
        m.product_refunds(shop.refunds(t.lineitem)),
        m.product_clicks(shop.page_logs(t.events)),
    ])
    return rows.select("sku_id", "favor_ct", "cart_ct", "refund_amount", "click_ct")


@query("product_clicks", f"WITH {PAGES_SQL} SELECT CAST(item AS BIGINT) AS sku_id, CAST(1 AS BIGINT) AS click_ct "
       "FROM pages_ WHERE page_id = 'good_detail'")
def product_clicks(t: Tables) -> DataFrame:
    return m.product_clicks(shop.page_logs(t.events)).select("sku_id", "click_ct")


@query("product_displays", f"WITH {PAGES_SQL} SELECT CAST(k AS BIGINT) AS sku_id, CAST(1 AS BIGINT) AS display_ct "
       "FROM pages_ WHERE event_type = 'view'")
def product_displays(t: Tables) -> DataFrame:
    return m.product_displays(shop.page_logs(t.events)).select("sku_id", "display_ct")


@query("product_comments", """
SELECT l_partkey AS sku_id, CAST(1 AS BIGINT) AS comment_ct,
       CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS good_comment_ct
FROM lineitem WHERE l_linestatus = 'F'""")
def product_comments(t: Tables) -> DataFrame:
    return m.product_comments(shop.comments(t.lineitem)).select("sku_id", "comment_ct", "good_comment_ct")


@query("product_favors_carts", """
SELECT l_partkey AS sku_id, l_shipdate AS t, CAST(1 AS BIGINT) AS favor_ct, CAST(0 AS BIGINT) AS cart_ct
FROM lineitem WHERE l_returnflag = 'N'
UNION ALL SELECT l_partkey, l_shipdate, 0, 1 FROM lineitem WHERE l_linestatus = 'O' """)
def product_favors_carts(t: Tables) -> DataFrame:
    facts = _product_facts(t)
    rows = union_measures([m.product_favors(facts.favors), m.product_carts(facts.carts)])
    return rows.selectExpr("sku_id", "CAST(rowtime AS TIMESTAMP_NTZ) AS t", "favor_ct", "cart_ct")


@query("product_orders", f"""WITH {WIDE_SQL}
SELECT sku_id, o_orderdate AS t, order_id, sku_num AS order_sku_num, split_total_amount AS order_amount FROM wide""")
def product_orders(t: Tables) -> DataFrame:
    rows = m.product_orders(_wide(t))
    return rows.selectExpr("sku_id", "CAST(rowtime AS TIMESTAMP_NTZ) AS t", "order_id", "order_sku_num", "order_amount")


@query("product_payments", f"""WITH {WIDE_SQL}, {PAYMENT_SQL}
SELECT sku_id, called AS t, order_id, split_total_amount AS payment_amount FROM paid""")
def product_payments(t: Tables) -> DataFrame:
    rows = m.product_payments(_product_facts(t).payment_wide)
    return rows.selectExpr("sku_id", "CAST(rowtime AS TIMESTAMP_NTZ) AS t", "order_id", "payment_amount")


@query("product_refunds", """
SELECT l_partkey AS sku_id, l_shipdate AS t, l_orderkey AS order_id, CAST(l_extendedprice AS DECIMAL(16,2)) AS refund_amount
FROM lineitem WHERE l_returnflag = 'R' """)
def product_refunds(t: Tables) -> DataFrame:
    rows = m.product_refunds(shop.refunds(t.lineitem))
    return rows.selectExpr("sku_id", "CAST(rowtime AS TIMESTAMP_NTZ) AS t", "order_id", "refund_amount")


@query("dim_lookup", f"""WITH {DIMS_SQL}
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS sku_id, s.sku_name, s.spu_id,
       u.s_name AS spu_name, s.tm_id, m.n_name AS tm_name, s.category3_id, c.r_name AS category3_name, s.price AS sku_price
FROM (SELECT *, l_partkey AS sku_id FROM lineitem) x {PRODUCT_NAMES_SQL}""")
def dim_lookup(t: Tables) -> DataFrame:
    """Product, unit, category and trademark of every line item."""
    details = shop.order_detail(t.lineitem).select("id", "order_id", "sku_id")
    return enrich_products(details, shop.dimensions(t), with_price=True)


@query("user_province_lookup", f"""WITH {DIMS_SQL}
SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey % 30 AS province_id, d.gender AS user_gender,
       CAST(trunc(date_diff('day', d.birthday, DATE '2024-06-30') / 365.0) AS INTEGER) AS user_age,
       p.name AS province_name, p.area_code AS province_area_code, p.iso_code AS province_iso_code,
       p.iso_3166_2 AS province_3166_2_code
FROM orders LEFT JOIN dim_user d ON d.id = o_custkey LEFT JOIN dim_province p ON p.id = o_custkey % 30""")
def user_province_lookup(t: Tables) -> DataFrame:
    orders = shop.order_info(t.orders).select("id", "user_id", "province_id")
    dims = shop.dimensions(t)
    return enrich_province(enrich_user(orders, dims.user, _as_of()), dims.province)


@query("composite_lookup", """
SELECT a.conv_id, a.turn, a.role, b.role AS previous_role, length(b.text) AS previous_chars
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def composite_lookup(t: Tables) -> DataFrame:
    """Lookup on two key columns: the turn before each turn."""
    turns = t.conversations.select("conv_id", "turn", "role", (F.col("turn") - 1).alias("before"))
    known = t.conversations.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("n"), F.col("role").alias("r"), F.length("text").cast("bigint").alias("len")
    )
    found = lookup(turns, known, {"conv_id": "c", "before": "n"}, {"previous_role": "r", "previous_chars": "len"})
    return found.drop("before")


@query("code_lookup", """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '1004' WHEN 'P' THEN '1002' ELSE '1001' END AS order_status,
       CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'paid' ELSE 'unpaid' END AS status_name FROM orders""")
def code_lookup(t: Tables) -> DataFrame:
    codes = code_table(t.spark).filter("code_group = 'order_status'")
    orders = shop.order_info(t.orders).select("id", "order_status")
    return lookup(orders, codes, {"order_status": "code"}, {"status_name": "code_name"})


@query("first_non_null", """
SELECT a.o_orderkey AS order_id, coalesce(CASE WHEN a.o_orderkey % 2 = 0 THEN a.o_orderstatus END, b.o_orderpriority) AS order_status,
       CAST(CASE WHEN a.o_orderkey % 3 = 0 THEN a.o_totalprice END AS DECIMAL(16,2)) AS split_total_amount,
       coalesce(CAST(CASE WHEN a.o_orderkey % 3 = 0 THEN a.o_totalprice END AS DECIMAL(16,2)), CAST(b.o_custkey AS DECIMAL(16,2))) AS total_amount
FROM orders a LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) b ON a.o_orderkey = b.o_orderkey""")
def first_non_null(t: Tables) -> DataFrame:
    """Wide rows filled from second rows; split amounts are never taken over."""
    amount = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).cast("decimal(16,2)")
    first = t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("order_status"),
        amount.alias("split_total_amount"), amount.alias("total_amount"),
    )
    second = t.orders.filter("o_orderkey % 5 <> 0").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("order_status"),
        F.col("o_custkey").cast("decimal(16,2)").alias("total_amount"),
    )
    return merge_wide(first, second, ["order_id"], ("order_status", "total_amount"))


@query("json_round_trip", """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS sku_id,
       CAST(l_extendedprice AS DECIMAL(16,2)) AS order_price, CAST(l_quantity AS BIGINT) AS sku_num,
       CAST(NULL AS VARCHAR) AS sku_name, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS create_time,
       CAST(l_extendedprice AS DECIMAL(16,2)) AS split_total_amount, CAST(l_discount AS DECIMAL(16,2)) AS split_activity_amount,
       CAST(l_tax AS DECIMAL(16,2)) AS split_coupon_amount FROM lineitem""")
def json_round_trip(t: Tables) -> DataFrame:
    """Order details as JSON strings and back to typed rows."""
    return parse_json(to_json_value(shop.order_detail(t.lineitem)), ORDER_DETAIL_SCHEMA).rows


