"""Streaming queries, played over whole tables to their end.

Each gives the rows its query appends, so the SQL of the table form applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import to_time
from ..functions.keywords import explode_keywords, register_keyword_function
from ..operators import (
    interval_join, lookup, route_changes, stats, to_json_value, valid_changes,
)
from ..operators import measures as m
from ..operators.routing import split_logs
from ..operators.parse import parse_json
from ..operators.wide import enrich_province
from ..schemas import KEYWORD_STATS_COLUMNS, LOG_SCHEMA, PAGE_MAP_SCHEMA
from ..session import working_dir
from ..sources import Topics, land_logs, landed_logs
from ..streaming import FlagDays, StatsTable, bounces_stream, first_per_day_stream
from ..streaming.replay import Played, cuts_in_step, replay, replay_batches, replay_twice, stream_table
from . import shop
from .order_queries import BOUNDS
from .registry import SQL, query
from .shop import Tables
from .visitor_queries import LOGS_SQL, PAGES_SQL, SIX_HOURS, USER_JUMP_SQL

# The sample events lie minutes to hours apart.
LATE = "6 hours"


def _events(t: Tables) -> Played:
    return Played(t.path("events"), "ts", {"event_type": "close"})


def _zoned(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


@query("stream_unique_visitor", SQL["unique_visitor"])
def stream_unique_visitor(t: Tables) -> DataFrame:
    """The table is one micro-batch, so the first row to arrive is the first in time."""
    first = replay(t.spark, Played(t.path("events"), "ts"), lambda events: first_per_day_stream(
        _zoned(events).select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", ["ts", "event_id"], LATE,
        F.col("event_type") == "signup",
    ), mode="update")
    return first.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_user_jump", USER_JUMP_SQL)
def stream_user_jump(t: Tables) -> DataFrame:
    found = replay(t.spark, _events(t), lambda events: bounces_stream(
        _zoned(events).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", ["event_id"],
        F.col("event_type") == "signup", SIX_HOURS, LATE,
    ))
    return found.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_new_visitor_fix", f"WITH {LOGS_SQL} SELECT mid, ms AS ts, is_new FROM repaired")
def stream_new_visitor_fix(t: Tables) -> DataFrame:
    """Flag repair per micro-batch, with the first days kept between batches."""

    def step(batch: DataFrame, batch_id: int, folder: str) -> DataFrame:
        flat = batch.select(F.col("common.mid").alias("mid"), F.col("common.is_new").alias("is_new"), "ts")
        days = FlagDays(batch.sparkSession, f"{folder}/days")
        return days.repair(flat, batch_id, "mid", "is_new", F.to_date(F.timestamp_millis("ts")))

    return replay_batches(t.spark, shop.logs(stream_table(t.spark, t.path("events"))), step)


@query("stream_visitor_windows", f"""WITH {PAGES_SQL}
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS stt, strftime(s + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS edt,
       vc, ch, ar, is_new, CAST(0 AS BIGINT) AS uv_ct, count(*) AS pv_ct,
       count(*) FILTER (WHERE last_page_id IS NULL) AS sv_ct, CAST(0 AS BIGINT) AS uj_ct,
       CAST(sum(during_time) AS BIGINT) AS dur_sum
FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS s FROM pages_) x
GROUP BY s, vc, ch, ar, is_new""")
def stream_visitor_windows(t: Tables) -> DataFrame:
    """Page views in tumbling windows that close behind the watermark."""

    def build(events: DataFrame) -> DataFrame:
        rows = m.page_views(shop.page_logs(events)).withColumn("rowtime", F.timestamp_millis("ts"))
        return stats.visitor_stats(rows.withWatermark("rowtime", LATE), "1 hour")

    return replay(t.spark, _events(t), build)


@query("stream_product_windows", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS stt, strftime(s + INTERVAL '30 days', '%Y-%m-%d %H:%M:%S') AS edt,
       l_partkey AS sku_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2))) AS DECIMAL(26,2)) AS refund_amount,
       count(DISTINCT l_orderkey) AS refund_order_ct
FROM (SELECT *, time_bucket(INTERVAL '30 days', l_shipdate, TIMESTAMP '1970-01-01') AS s FROM lineitem) x
WHERE l_returnflag = 'R' GROUP BY s, l_partkey""")
def stream_product_windows(t: Tables) -> DataFrame:
    """Distinct orders per window on a stream: two aggregations, one after the other."""

    def build(lines: DataFrame) -> DataFrame:
        rows = m.product_refunds(shop.refunds(lines)).withWatermark("rowtime", "3650 days")
        return stats.product_stats(rows, "30 days")

    out = replay(t.spark, Played(t.path("lineitem"), "l_shipdate", {"l_returnflag": "R"}), build)
    return out.select("stt", "edt", "sku_id", "refund_amount", "refund_order_ct")


@query("stream_keyword_windows", """
SELECT keyword, count(*) AS ct, 'SEARCH' AS source, strftime(s, '%Y-%m-%d %H:%M:%S') AS stt,
       strftime(s + INTERVAL '1 day', '%Y-%m-%d %H:%M:%S') AS edt
FROM (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS s,
             unnest(['red', 'ring', json_extract_string(props, '$.k')]) AS keyword
      FROM events WHERE event_type = 'click') y GROUP BY s, keyword""")
def stream_keyword_windows(t: Tables) -> DataFrame:
    def build(events: DataFrame) -> DataFrame:
        page = F.create_map(F.lit("page_id"), F.col("page.page_id"), F.lit("item"), F.col("page.item"))
        clicked = events.filter("event_type = 'click'")
        found = m.searches(shop.page_logs(clicked).select(page.alias("page"), "ts"))
        words = explode_keywords(found.withWatermark("rowtime", LATE), "fullword")
        return stats.keyword_stats(words, "1 day")

    return replay(t.spark, Played(t.path("events"), "ts", {"event_type": "click", "props": '{"k": 0}'}), build)


# Two tables cut at the same times advance in step, so the watermark waits for no more than the rounding of times, and the
# state holds the rows of one slice and of the interval. Slices have a number of rows, whatever the size of the tables.
IN_STEP = "1 day"
SLICE_ROWS = 2_000_000


def _replay_in_step(t: Tables, tables: list[Played], build) -> DataFrame:
    return replay(t.spark, tables, build, cuts=cuts_in_step(t.spark, tables, SLICE_ROWS, 4))


@query("stream_interval_join", SQL["interval_join_two_sided"])
def stream_interval_join(t: Tables) -> DataFrame:
    """Two streams joined within an interval; the watermarks bound the state."""

    def build(orders: DataFrame, lines: DataFrame) -> DataFrame:
        left = _zoned(orders.select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderdate")
        right = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
        joined = interval_join(
            left.withWatermark("o_orderdate", IN_STEP), _zoned(right, "l_shipdate").withWatermark("l_shipdate", IN_STEP),
            "o_orderkey", "l_orderkey", "o_orderdate", "l_shipdate", *BOUNDS, spread=2,
        )
        return joined.select("o_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "o_totalprice")

    tables = [Played(t.path("orders"), "o_orderdate"), Played(t.path("lineitem"), "l_shipdate")]
    return _replay_in_step(t, tables, build)


@query("stream_payment_join", SQL["interval_join_one_sided"])
def stream_payment_join(t: Tables) -> DataFrame:
    """One stream with itself: purchases and the views of the six hours before."""

    def build(events: DataFrame) -> DataFrame:
        timed = _zoned(events)
        pays = timed.filter("event_type = 'purchase'").selectExpr(
            "event_id AS pay_id", "user_id AS payer", "ts AS pay_ts", "value AS pay"
        )
        views = timed.filter("event_type = 'view'").selectExpr(
            "event_id AS order_id", "user_id AS viewer", "ts AS view_ts", "value AS amt"
        )
        joined = interval_join(
            pays.withWatermark("pay_ts", LATE), views.withWatermark("view_ts", LATE), "payer", "viewer", "pay_ts",
            "view_ts", -SIX_HOURS, 0,
        )
        return joined.select("pay_id", "order_id", "pay", "amt")

    return replay(t.spark, Played(t.path("events"), "ts"), build)


@query("stream_province_windows", """
WITH w AS (
  SELECT time_bucket(INTERVAL '7 days', o_orderdate, TIMESTAMP '1970-01-01') AS s, o_custkey % 30 AS province_id,
         o_orderkey, CAST(l_extendedprice AS DECIMAL(16,2)) AS amount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
   AND l_shipdate BETWEEN o_orderdate - INTERVAL 120 DAYS AND o_orderdate + INTERVAL 120 DAYS)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS stt, strftime(s + INTERVAL '7 days', '%Y-%m-%d %H:%M:%S') AS edt, province_id,
       n_name AS province_name, CAST(sum(amount) AS DECIMAL(26,2)) AS order_amount, count(DISTINCT o_orderkey) AS order_count
FROM w LEFT JOIN nation ON n_nationkey = province_id GROUP BY s, province_id, n_name""")
def stream_province_windows(t: Tables) -> DataFrame:
    """Interval join, dimension lookup and windowed distinct counts in one streaming query."""
    provinces = shop.dimensions(t).province

    def build(orders: DataFrame, lines: DataFrame) -> DataFrame:
        left = shop.order_info(orders).withColumn("rowtime", to_time("create_time")).withWatermark("rowtime", IN_STEP)
        right = shop.order_detail(lines).withColumn("rowtime", to_time("create_time")).withWatermark("rowtime", IN_STEP)
        joined = interval_join(
            left.selectExpr("id AS o_id", "province_id", "rowtime"),
            right.selectExpr("order_id", "split_total_amount", "rowtime AS d_time"),
            "o_id", "order_id", "rowtime", "d_time", *BOUNDS,
        )
        return stats.province_stats(enrich_province(joined, provinces), "7 days")

    tables = [
        Played(t.path("orders"), "o_orderdate", {"o_orderkey": "-1"}),
        Played(t.path("lineitem"), "l_shipdate", {"l_orderkey": "-2"}),
    ]
    out = _replay_in_step(t, tables, build)
    return out.select("stt", "edt", "province_id", "province_name", "order_amount", "order_count")


@query("stream_keyword_sql", SQL["keyword_search"])
def stream_keyword_sql(t: Tables) -> DataFrame:
    """A topic as a streaming SQL view with a computed time and a watermark, and a table function over it."""
    topics = Topics(t.spark, root=working_dir(t.spark, "topics"))
    topics.write_batch(to_json_value(shop.page_logs(t.events)), "page", 0)
    register_keyword_function(t.spark)

    def run() -> DataFrame:
        topics.view("stream_page_log", "page", PAGE_MAP_SCHEMA, "to_timestamp(from_unixtime(ts div 1000))", LATE, "earliest")
        return t.spark.sql("""
            SELECT keyword, count(*) AS ct, 'SEARCH' AS source,
                   date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS stt, date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS edt
            FROM (SELECT k.keyword, p.rowtime
                  FROM stream_page_log p, LATERAL ik_analyze(try_element_at(p.page, 'item')) AS k(keyword)
                  WHERE try_element_at(p.page, 'page_id') = 'good_list' AND try_element_at(p.page, 'item') IS NOT NULL)
            GROUP BY window(rowtime, '1 day'), keyword""")

    # Spark filters before the watermark, so the closing row has to be a search as well.
    last = t.events.selectExpr("max(ts) AS ts").selectExpr(
        "map('page_id', 'good_list', 'item', 'end') AS page", "unix_millis(CAST(ts AS TIMESTAMP)) + 100000000000 AS ts"
    )
    return replay_twice(t.spark, run, lambda: topics.write_batch(to_json_value(last), "page", 1))


@query("stream_dim_lookup", """
SELECT event_id, user_id, c_name AS user_name FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0""")
def stream_dim_lookup(t: Tables) -> DataFrame:
    """A stream looks up a stored dimension; events without a match stay."""
    users = t.customer.filter("c_custkey % 2 = 0")
    out = replay(t.spark, Played(t.path("events"), "ts"), lambda events: lookup(
        events.select("event_id", "user_id"), users, {"user_id": "c_custkey"}, {"user_name": "c_name"}
    ))
    return out.select("event_id", "user_id", "user_name")


@query("stream_log_router", """
SELECT topic, count(*) AS ct FROM (
  SELECT CASE WHEN event_type = 'error' THEN 'start' ELSE 'page' END AS topic FROM events
  UNION ALL SELECT 'display' FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'display' FROM events WHERE event_type = 'view') x GROUP BY topic""")
def stream_log_router(t: Tables) -> DataFrame:
    """One input stream, three outputs written per micro-batch."""
    topics = Topics(t.spark, root=working_dir(t.spark, "topics"))

    def step(batch: DataFrame, batch_id: int, _folder: str) -> DataFrame:
        logs = split_logs(parse_json(batch, LOG_SCHEMA).rows)
        topics.write_batch(to_json_value(logs.page), "page", batch_id)
        topics.write_batch(logs.start.select(F.to_json("start").alias("value")), "start", batch_id)
        topics.write_batch(logs.display.select(F.to_json("display").alias("value")), "display", batch_id)
        return batch.limit(0)

    replay_batches(t.spark, to_json_value(shop.logs(stream_table(t.spark, t.path("events")))), step)
    counted = [topics.table(name).select(F.lit(name).alias("topic")) for name in ("page", "start", "display")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).groupBy("topic").agg(F.count("*").alias("ct"))


@query("stream_routed_topics", SQL["router_facts"])
def stream_routed_topics(t: Tables) -> DataFrame:
    """Fact rows written to the topic each row names, and read back from there."""
    topics = Topics(t.spark, root=working_dir(t.spark, "topics"))
    rules = shop.rules(t.spark)

    def step(batch: DataFrame, batch_id: int, _folder: str) -> DataFrame:
        facts = route_changes(valid_changes(batch), rules).facts
        body = F.to_json(F.struct("table", "type", "sink_table", "data"))
        topics.write_routed(facts.select("sink_table", body.alias("value")), batch_id)
        return batch.select("type").limit(0)

    replay_batches(t.spark, shop.change_rows(stream_table(t.spark, t.path("events"))), step)
    lines = topics.routed_table("dwd_view").unionByName(topics.routed_table("dwd_click"))
    rows = parse_json(lines, "`table` STRING, type STRING, sink_table STRING, data MAP<STRING, STRING>").rows
    return rows.select(
        "table", "type", "sink_table", F.try_element_at("data", F.lit("event")).alias("event"),
        F.try_element_at("data", F.lit("id")).alias("id"), F.array_join(F.array_sort(F.map_keys("data")), ",").alias("kept"),
    )


@query("log_landing", """
SELECT coalesce(CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y%m%d') END, 'none') AS log_day, event_id % 7 <> 0 AS good, count(*) AS ct
FROM events GROUP BY ALL""")
def log_landing(t: Tables) -> DataFrame:
    """Raw lines landed by day, broken ones kept apart."""
    folder = working_dir(t.spark, "landing")
    line = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id")))
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(line)
    topics = Topics(t.spark, root=f"{folder}/topics")
    land_logs(t.events.select(broken.alias("value")), f"{folder}/bronze", 0, topics)
    return landed_logs(t.spark, f"{folder}/bronze").groupBy("log_day", "good").agg(F.count("*").alias("ct"))


@query("stats_sink", SQL["keyword_search"])
def stats_sink(t: Tables) -> DataFrame:
    """Statistics written in sink column order and read back, without the write time."""
    from .text_queries import keyword_search

    table = StatsTable(t.spark, working_dir(t.spark, "stats"), KEYWORD_STATS_COLUMNS)
    table.write(keyword_search(t), 0)
    table.write(keyword_search(t), 0)  # a repeated batch does not double rows
    return table.read().drop("ts")

