"""The shop's source tables, derived from the sample star schema.

The jobs expect logs, change rows, business facts and dimensions. This module reads
them out of the sample tables, row for row, so that a job's input grows with the
data. Amounts are decimals, times are datetime strings, dimensions are strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.wide import Dimensions
from ..schemas import MONEY


class Tables:
    """The sample tables of one folder. A table's schema is read once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._schemas: dict[str, object] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(self.path(name)).schema
        return self.spark.read.schema(self._schemas[name]).parquet(self.path(name))


def _stamp(time: str) -> str:
    return f"date_format({time}, 'yyyy-MM-dd HH:mm:ss')"


K = "get_json_object(props, '$.k')"


def logs(events: DataFrame) -> DataFrame:
    """Behaviour logs: sign-ups enter, views and clicks follow, errors start the app."""
    return events.selectExpr(
        """named_struct('mid', concat('m', user_id), 'vc', concat('v', user_id % 3), 'ch', concat('c', user_id % 5),
                        'ar', concat('a', user_id % 7),
                        'is_new', IF(event_type IN ('signup', 'view'), '1', '0')) AS common""",
        f"""named_struct(
              'page_id', CASE event_type WHEN 'signup' THEN 'home' WHEN 'view' THEN 'good_detail'
                                         WHEN 'click' THEN 'good_list' WHEN 'purchase' THEN 'trade'
                                         WHEN 'error' THEN 'none' END,
              'last_page_id', IF(event_type <> 'signup', 'home', NULL),
              'item', CASE event_type WHEN 'view' THEN {K} WHEN 'click' THEN concat('Red Ring ', {K}) END,
              'during_time', CAST(round(value * 100) AS BIGINT)) AS page""",
        f"""IF(event_type = 'view', array(map('item', {K}, 'item_type', 'sku_id'),
                                          map('item', concat('a', {K}), 'item_type', 'activity_id')), NULL) AS displays""",
        f"IF(event_type = 'error', map('entry', 'icon', 'loading', {K}), NULL) AS `start`",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ts",
    )


def page_logs(events: DataFrame) -> DataFrame:
    """Logs without the app starts."""
    return logs(events.filter("event_type <> 'error'"))


def envelopes(events: DataFrame) -> DataFrame:
    """Change envelopes: one database table per event type, operations by turn."""
    return events.selectExpr(
        "named_struct('db', 'shop', 'table', event_type) AS source",
        "CASE event_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'r' WHEN 2 THEN 'u' ELSE 'd' END AS op",
        "IF(event_id % 4 > 1, map('id', CAST(user_id AS STRING)), NULL) AS before",
        """IF(event_id % 4 <> 3, map('id', CAST(user_id AS STRING), 'event', CAST(event_id AS STRING),
                                    'value', CAST(value AS STRING), 'noise', 'x'), NULL) AS after""",
        "event_id AS ts_ms",
    )


def change_rows(events: DataFrame) -> DataFrame:
    """Change rows as they arrive in the raw topic, some first-load rows among them."""
    return events.selectExpr(
        "'shop' AS database",
        "IF(event_id % 11 = 0, '', event_type) AS `table`",
        "CASE event_id % 3 WHEN 0 THEN 'bootstrap-insert' WHEN 1 THEN 'insert' ELSE 'update' END AS type",
        """IF(event_id % 13 = 0, CAST(map() AS MAP<STRING, STRING>),
              map('id', CAST(user_id AS STRING), 'event', CAST(event_id AS STRING), 'noise', 'x')) AS data""",
    )


# Routing rules for the change rows above, one of them with a sink that does not exist.
RULES = (
    ("view", "insert", "kafka", "dwd_view", "id,event", None, None),
    ("click", "insert", "kafka", "dwd_click", "event", None, None),
    ("signup", "insert", "hbase", "dim_signup", "id,event", "id", None),
    ("signup", "update", "hbase", "dim_signup", "id,event", "id", None),
    ("purchase", "update", "hbase", "dim_purchase", "id,event", None, "salted"),
    ("error", "insert", "clickhouse", "x", "id", None, None),
)


def _literal(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else f"'{value}'"


def rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in RULES)
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS rules"
        "(source_table, operate_type, sink_type, sink_table, sink_columns, sink_pk, sink_extend)"
    )


def order_info(orders: DataFrame) -> DataFrame:
    """Orders; five of thirty provinces have no dimension row."""
    return orders.selectExpr(
        "o_orderkey AS id",
        "o_custkey % 30 AS province_id",
        "CASE o_orderstatus WHEN 'F' THEN '1004' WHEN 'P' THEN '1002' ELSE '1001' END AS order_status",
        "o_custkey AS user_id",
        f"CAST(o_totalprice AS {MONEY}) AS total_amount",
        f"CAST(0 AS {MONEY}) AS activity_reduce_amount",
        f"CAST(0 AS {MONEY}) AS coupon_reduce_amount",
        f"CAST(o_totalprice AS {MONEY}) AS original_total_amount",
        f"CAST(0 AS {MONEY}) AS feight_fee",
        "CAST(NULL AS STRING) AS expire_time",
        f"{_stamp('o_orderdate')} AS create_time",
        "CAST(NULL AS STRING) AS operate_time",
    )


def order_detail(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber AS id",
        "l_orderkey AS order_id",
        "l_partkey AS sku_id",
        f"CAST(l_extendedprice AS {MONEY}) AS order_price",
        "CAST(l_quantity AS BIGINT) AS sku_num",
        "CAST(NULL AS STRING) AS sku_name",
        f"{_stamp('l_shipdate')} AS create_time",
        f"CAST(l_extendedprice AS {MONEY}) AS split_total_amount",
        f"CAST(l_discount AS {MONEY}) AS split_activity_amount",
        f"CAST(l_tax AS {MONEY}) AS split_coupon_amount",
    )


def payment_info(orders: DataFrame) -> DataFrame:
    """Payments of finished orders, up to an hour after the order."""
    called = "o_orderdate + make_dt_interval(0, 0, CAST(o_custkey % 60 AS INT))"
    return orders.filter("o_orderstatus = 'F'").selectExpr(
        "o_orderkey + 1 AS id",
        "o_orderkey AS order_id",
        "o_custkey AS user_id",
        f"CAST(CAST(o_totalprice AS {MONEY}) + 1 AS {MONEY}) AS total_amount",
        "o_orderpriority AS subject",
        "'1101' AS payment_type",
        f"{_stamp('o_orderdate')} AS create_time",
        f"{_stamp(called)} AS callback_time",
    )


def dimensions(tables: Tables) -> Dimensions:
    """Six dimensions; some keys are left without a row."""
    return Dimensions(
        user=tables.customer.selectExpr(
            "CAST(c_custkey AS STRING) AS ID", "IF(c_custkey % 2 = 0, 'M', 'F') AS GENDER",
            "CAST(date_add(DATE '1950-01-01', CAST(c_custkey % 20000 AS INT)) AS STRING) AS BIRTHDAY",
        ),
        province=tables.nation.selectExpr(
            "CAST(n_nationkey AS STRING) AS ID", "n_name AS NAME", "CAST(n_nationkey + 100 AS STRING) AS AREA_CODE",
            "concat('N-', n_nationkey) AS ISO_CODE", "concat('R-', n_regionkey) AS ISO_3166_2",
        ),
        sku=tables.part.selectExpr(
            "CAST(p_partkey AS STRING) AS ID", "p_name AS SKU_NAME", "CAST(p_size AS STRING) AS SPU_ID",
            "CAST(p_size % 7 AS STRING) AS CATEGORY3_ID", "substring(p_brand, 7, 2) AS TM_ID",
            f"CAST(CAST(p_retailprice AS {MONEY}) AS STRING) AS PRICE",
        ),
        spu=tables.supplier.selectExpr("CAST(s_suppkey AS STRING) AS ID", "s_name AS SPU_NAME"),
        category3=tables.region.selectExpr("CAST(r_regionkey AS STRING) AS ID", "r_name AS NAME"),
        trademark=tables.nation.selectExpr("CAST(n_nationkey AS STRING) AS ID", "n_name AS TM_NAME"),
    )


def sku_times(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr("l_partkey AS sku_id", f"{_stamp('l_shipdate')} AS create_time")


def refunds(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter("l_returnflag = 'R'").selectExpr(
        "l_partkey AS sku_id", "l_orderkey AS order_id", f"CAST(l_extendedprice AS {MONEY}) AS refund_amount",
        f"{_stamp('l_shipdate')} AS create_time",
    )


def comments(lineitem: DataFrame) -> DataFrame:
    """Comments on finished lines, a third of them good."""
    return lineitem.filter("l_linestatus = 'F'").selectExpr(
        "l_partkey AS sku_id", "IF(l_linenumber % 3 = 0, '1201', '1203') AS appraise",
        f"{_stamp('l_shipdate')} AS create_time",
    )
