"""Queries on behaviour logs: routing, flag repair, unique visitors, bounces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import day_of, epoch_ms, map_value
from ..operators import (
    bounces, explode_displays, first_per_day, parse_json, repair_new_flag, split_logs, to_json_value,
)
from ..operators import measures as m
from ..operators.routing import page_text
from ..schemas import LOG_SCHEMA
from . import jobs, shop
from .registry import query
from .shop import Tables

SIX_HOURS = 6 * 3600

# The behaviour logs of `shop.logs`, in SQL.
LOGS_SQL = """
logs AS (
  SELECT *, CASE event_type WHEN 'view' THEN k WHEN 'click' THEN 'Red Ring ' || k END AS item
  FROM (SELECT event_id, ts, event_type, 'm' || user_id AS mid, 'v' || (user_id % 3) AS vc,
               'c' || (user_id % 5) AS ch, 'a' || (user_id % 7) AS ar,
               CASE WHEN event_type IN ('signup', 'view') THEN '1' ELSE '0' END AS is_new,
               CASE event_type WHEN 'signup' THEN 'home' WHEN 'view' THEN 'good_detail' WHEN 'click' THEN 'good_list'
                               WHEN 'purchase' THEN 'trade' ELSE 'none' END AS page_id,
               CASE WHEN event_type <> 'signup' THEN 'home' END AS last_page_id,
               json_extract_string(props, '$.k') AS k,
               CAST(round(value * 100) AS BIGINT) AS during_time, epoch_us(ts) // 1000 AS ms
        FROM events) e),
repaired AS (
  SELECT * EXCLUDE (is_new),
         CASE WHEN is_new = '1' AND CAST(ts AS DATE) <> min(CASE WHEN is_new = '1' THEN CAST(ts AS DATE) END)
                   OVER (PARTITION BY mid) THEN '0' ELSE is_new END AS is_new
  FROM logs)
"""

PAGES_SQL = LOGS_SQL + ", pages_ AS (SELECT * FROM logs WHERE event_type <> 'error')"


def _page_columns(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("common.mid").alias("mid"), F.col("common.vc").alias("vc"), F.col("common.is_new").alias("is_new"),
        F.col("page.page_id").alias("page_id"), F.col("page.last_page_id").alias("last_page_id"),
        F.col("page.during_time").alias("during_time"), "ts",
    )


def _lines(t: Tables) -> DataFrame:
    return to_json_value(shop.logs(t.events))


@query("log_router_page", f"WITH {LOGS_SQL} SELECT mid, vc, is_new, page_id, last_page_id, during_time, ms AS ts "
       "FROM repaired WHERE event_type <> 'error'")
def log_router_page(t: Tables) -> DataFrame:
    return _page_columns(jobs.log_routing(_lines(t)).logs.page)


@query("log_router_start", f"WITH {LOGS_SQL} SELECT 'icon' AS entry, k AS loading FROM logs WHERE event_type = 'error'")
def log_router_start(t: Tables) -> DataFrame:
    start = split_logs(parse_json(_lines(t), LOG_SCHEMA).rows).start
    return start.select(map_value("start", "entry").alias("entry"), map_value("start", "loading").alias("loading"))


@query("display_explode", f"""WITH {LOGS_SQL}
SELECT k AS item, 'sku_id' AS item_type, page_id, CAST(ms AS VARCHAR) AS ts FROM logs WHERE event_type = 'view'
UNION ALL
SELECT 'a' || k, 'activity_id', page_id, CAST(ms AS VARCHAR) FROM logs WHERE event_type = 'view'""")
def display_explode(t: Tables) -> DataFrame:
    shown = explode_displays(parse_json(_lines(t), LOG_SCHEMA).rows)
    return shown.select(*[map_value("display", name).alias(name) for name in ("item", "item_type", "page_id", "ts")])


def _raw_line() -> Column:
    """A behaviour log as an app sends it: with fields that no job knows, in every part of the row."""
    return F.to_json(F.expr("""named_struct(
        'common', named_struct('mid', concat('m', user_id), 'is_new', IF(event_type IN ('signup', 'view'), '1', '0'), 'os', concat('o', user_id % 2)),
        'page', named_struct('page_id', event_type, 'item_type', 'sku', 'rank', event_id % 10),
        'err', event_id % 100, 'ts', unix_millis(CAST(ts AS TIMESTAMP)))"""))


@query("log_router_whole_row", """
SELECT mid, CASE WHEN is_new = '1' AND d <> min(CASE WHEN is_new = '1' THEN d END) OVER (PARTITION BY mid) THEN '0' ELSE is_new END AS is_new,
       os, item_type, rank, err, ts
FROM (SELECT 'm' || user_id AS mid, CASE WHEN event_type IN ('signup', 'view') THEN '1' ELSE '0' END AS is_new, CAST(ts AS DATE) AS d,
             'o' || (user_id % 2) AS os, 'sku' AS item_type, event_id % 10 AS rank, event_id % 100 AS err, epoch_us(ts) // 1000 AS ts FROM events) x""")
def log_router_whole_row(t: Tables) -> DataFrame:
    """Page rows keep fields that the job does not know, whether or not their flag is repaired."""
    pages = page_text(jobs.log_routing(t.events.select(_raw_line().alias("value"))).logs.page)
    field = lambda path: F.get_json_object("value", path)
    return pages.select(
        field("$.common.mid").alias("mid"), field("$.common.is_new").alias("is_new"), field("$.common.os").alias("os"),
        field("$.page.item_type").alias("item_type"), field("$.page.rank").cast("bigint").alias("rank"),
        field("$.err").cast("bigint").alias("err"), field("$.ts").cast("bigint").alias("ts"),
    )


@query("poison_lines", """
SELECT CASE event_id % 6 WHEN 1 THEN 'json' WHEN 2 THEN 'time' WHEN 3 THEN 'number' ELSE 'row' END AS outcome, count(*) AS ct
FROM events GROUP BY ALL""")
def poison_lines(t: Tables) -> DataFrame:
    """Broken, out-of-range and non-numeric lines are set aside by reason; quoted numbers pass; every line is accounted for."""
    good = "unix_millis(CAST(ts AS TIMESTAMP))"
    line = F.expr(f"""CASE event_id % 6 WHEN 1 THEN '{{broken' WHEN 2 THEN '{{"ts": 9223372036854775807, "page": {{"page_id": "home"}}}}'
        WHEN 3 THEN '{{"ts": 1, "page": {{"during_time": "long"}}}}' WHEN 4 THEN concat('{{"ts": "', {good}, '", "page": {{"during_time": "12"}}}}')
        ELSE concat('{{"ts": ', {good}, ', "common": {{"mid": "', user_id, '", "is_new": "1"}}}}') END""")
    routed = jobs.log_routing(t.events.select(line.alias("value")))
    rows = routed.logs.page.select(F.lit("row").alias("outcome"))
    return rows.unionByName(routed.rejects.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("ct"))


@query("datetime_forms", """
SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000 + CASE WHEN event_id % 4 = 2 THEN 120 ELSE 0 END AS ms FROM events WHERE event_id % 4 <> 3
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3""")
def datetime_forms(t: Tables) -> DataFrame:
    """Datetime texts with a 'T', with a fraction, and cut short."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_id") % 4
    form = F.when(kind == 1, F.replace(text, F.lit(" "), F.lit("T"))).when(kind == 2, F.concat(text, F.lit(".12"))).when(
        kind == 3, F.substring(text, 1, 16)).otherwise(text)
    return t.events.select("event_id", epoch_ms(form).alias("ms"))


@query("json_rejects", """
SELECT reason, count(*) AS ct FROM (
  SELECT CASE WHEN event_id % 7 = 0 THEN 'reject' ELSE 'row' END AS reason FROM events) x GROUP BY reason""")
def json_rejects(t: Tables) -> DataFrame:
    """Every seventh line is cut off; all lines are accounted for."""
    broken = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = parse_json(t.events.select(broken.alias("value")), "k BIGINT")
    rows = parsed.rows.select(F.lit("row").alias("reason"))
    rejects = parsed.rejects.select(F.lit("reject").alias("reason"))
    return rows.unionByName(rejects).groupBy("reason").agg(F.count("*").alias("ct"))


@query("unique_visitor", """
SELECT event_id, user_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) r
  FROM events WHERE event_type = 'signup') x WHERE r = 1""")
def unique_visitor(t: Tables) -> DataFrame:
    first = first_per_day(
        t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", F.to_date("ts"), ["ts", "event_id"],
        F.col("event_type") == "signup",
    )
    return first.select("event_id", "user_id", "ts")


@query("unique_visitor_pages", f"""WITH {PAGES_SQL}
SELECT mid, vc, is_new, page_id, last_page_id, during_time, ms AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY mid, CAST(ts AS DATE) ORDER BY ms, event_id) r
  FROM pages_ WHERE last_page_id IS NULL) x WHERE r = 1""")
def unique_visitor_pages(t: Tables) -> DataFrame:
    return _page_columns(jobs.unique_visitors(shop.page_logs(t.events)))


@query("new_visitor_fix", """
SELECT event_id, user_id,
       CASE WHEN event_type = 'signup' AND CAST(ts AS DATE) <> CAST(min(CASE WHEN event_type = 'signup' THEN ts END)
                 OVER (PARTITION BY user_id) AS DATE) THEN '0'
            WHEN event_type = 'signup' THEN '1' ELSE '0' END AS is_new
FROM events""")
def new_visitor_fix(t: Tables) -> DataFrame:
    flagged = t.events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", "1").otherwise("0").alias("is_new")
    )
    return repair_new_flag(flagged, "user_id", "is_new", F.to_date("ts")).select("event_id", "user_id", "is_new")


USER_JUMP_SQL = """
SELECT event_id, user_id, ts FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events) x
WHERE event_type = 'signup' AND (n IS NULL OR n >= ts + INTERVAL 6 HOURS)"""


@query("user_jump", USER_JUMP_SQL)
def user_jump(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    found = bounces(rows, "user_id", "ts", ["event_id"], F.col("event_type") == "signup", SIX_HOURS)
    return found.select("event_id", "user_id", "ts")


@query("user_jump_pages", f"""WITH {PAGES_SQL}
SELECT mid, vc, is_new, page_id, last_page_id, during_time, ms AS ts FROM (
  SELECT *, lead(ms) OVER (PARTITION BY mid ORDER BY ms, event_id) n FROM pages_) x
WHERE last_page_id IS NULL AND (n IS NULL OR n >= ms + 21600000)""")
def user_jump_pages(t: Tables) -> DataFrame:
    return _page_columns(jobs.bounced_visitors(shop.page_logs(t.events), SIX_HOURS))


@query("visitor_measures", f"""WITH {PAGES_SQL}
SELECT vc, ch, ar, is_new, CAST(0 AS BIGINT) AS uv_ct, CAST(1 AS BIGINT) AS pv_ct,
       CAST(CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS sv_ct,
       CAST(0 AS BIGINT) AS uj_ct, during_time AS dur_sum, ms AS ts FROM pages_""")
def visitor_measures(t: Tables) -> DataFrame:
    return m.page_views(shop.page_logs(t.events))


@query("visitor_unique_and_bounce_measures", f"""WITH {PAGES_SQL},
ranked AS (
  SELECT *, lead(ms) OVER (PARTITION BY mid ORDER BY ms, event_id) AS n,
         row_number() OVER (PARTITION BY mid, CAST(ts AS DATE), last_page_id IS NULL ORDER BY ms, event_id) AS r FROM pages_)
SELECT vc, ch, ar, is_new, CAST(1 AS BIGINT) AS uv_ct, CAST(0 AS BIGINT) AS uj_ct, ms AS ts FROM ranked
WHERE last_page_id IS NULL AND r = 1
UNION ALL SELECT vc, ch, ar, is_new, 0, 1, ms FROM ranked
WHERE last_page_id IS NULL AND (n IS NULL OR n >= ms + 21600000)""")
def visitor_unique_and_bounce_measures(t: Tables) -> DataFrame:
    pages = shop.page_logs(t.events)
    rows = m.unique_visits(jobs.unique_visitors(pages)).unionByName(
        m.bounced_visits(jobs.bounced_visitors(pages, SIX_HOURS))
    )
    return rows.select("vc", "ch", "ar", "is_new", "uv_ct", "uj_ct", "ts")


VISITOR_STATS_SQL = f"""WITH {PAGES_SQL},
ranked AS (
  SELECT *, lead(ms) OVER (PARTITION BY mid ORDER BY ms, event_id) AS n,
         row_number() OVER (PARTITION BY mid, CAST(ts AS DATE), last_page_id IS NULL ORDER BY ms, event_id) AS r
  FROM pages_),
u AS (
  SELECT ts, vc, ch, ar, is_new, 0 AS uv, 1 AS pv, CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END AS sv, 0 AS uj,
         during_time AS dur FROM ranked
  UNION ALL SELECT ts, vc, ch, ar, is_new, 1, 0, 0, 0, 0 FROM ranked WHERE last_page_id IS NULL AND r = 1
  UNION ALL SELECT ts, vc, ch, ar, is_new, 0, 0, 0, 1, 0 FROM ranked
    WHERE last_page_id IS NULL AND (n IS NULL OR n >= ms + 21600000)),
w AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS s, * FROM u)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS stt, strftime(s + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS edt,
       vc, ch, ar, is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct,
       CAST(sum(sv) AS BIGINT) AS sv_ct, CAST(sum(uj) AS BIGINT) AS uj_ct, CAST(sum(dur) AS BIGINT) AS dur_sum
FROM w GROUP BY s, vc, ch, ar, is_new"""


@query("visitor_stats", VISITOR_STATS_SQL)
def visitor_stats(t: Tables) -> DataFrame:
    return jobs.visitor_statistics(shop.page_logs(t.events), "1 hour", SIX_HOURS)


@query("first_flag_day", f"""WITH {LOGS_SQL}
SELECT mid, strftime(min(ts), '%Y%m%d') AS first_day, count(*) AS n FROM logs WHERE is_new = '1' GROUP BY mid""")
def first_flag_day(t: Tables) -> DataFrame:
    from ..operators import first_flag_days

    flat = shop.logs(t.events).select(F.col("common.mid").alias("mid"), F.col("common.is_new").alias("is_new"), "ts")
    first = first_flag_days(flat, "mid", "is_new", day_of("ts"))
    return first.select("mid", F.date_format("first_day", "yyyyMMdd").alias("first_day"), "n")
