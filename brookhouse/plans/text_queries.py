"""Queries on keywords and single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import (
    age_years, compose_key, datetime_text, day_text, epoch_ms, first_non_null, from_epoch_text, is_blank, join_names,
    json_decimal, json_long, map_value, put_field, split_names, to_time,
)
from ..functions.keywords import explode_keywords, register_keyword_function
from ..operators.stats import keyword_stats as count_keywords
from . import jobs, shop
from .registry import query
from .shop import Tables


@query("keyword_stats", """
SELECT keyword, count(*) AS ct, 'SEARCH' AS source, strftime(s, '%Y-%m-%d %H:%M:%S') AS stt,
       strftime(s + INTERVAL '7 days', '%Y-%m-%d %H:%M:%S') AS edt
FROM (SELECT time_bucket(INTERVAL '7 days', l_shipdate, TIMESTAMP '1970-01-01') AS s,
             unnest(string_split(p_name, ' ')) AS keyword
      FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY') y
GROUP BY s, keyword""")
def keyword_stats(t: Tables) -> DataFrame:
    """Words of the names of one kind of product, per week shipped."""
    named = t.lineitem.select("l_partkey", F.col("l_shipdate").alias("rowtime")).join(
        t.part.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"
    )
    return count_keywords(explode_keywords(named, "p_name"), "7 days")


SEARCH_SQL = """
SELECT keyword, count(*) AS ct, 'SEARCH' AS source, strftime(s, '%Y-%m-%d %H:%M:%S') AS stt,
       strftime(s + INTERVAL '1 day', '%Y-%m-%d %H:%M:%S') AS edt
FROM (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS s,
             unnest(['red', 'ring', json_extract_string(props, '$.k')]) AS keyword
      FROM events WHERE event_type = 'click') y GROUP BY s, keyword"""


def _open_pages(t: Tables) -> DataFrame:
    """Page logs with `page` as an open map."""
    page = F.create_map(F.lit("page_id"), F.col("page.page_id"), F.lit("item"), F.col("page.item"))
    return shop.page_logs(t.events).select(page.alias("page"), "ts")


@query("keyword_search", SEARCH_SQL)
def keyword_search(t: Tables) -> DataFrame:
    return jobs.keyword_statistics(_open_pages(t), "1 day")


@query("keyword_sql", SEARCH_SQL)
def keyword_sql(t: Tables) -> DataFrame:
    """The same in SQL, with the registered table function."""
    register_keyword_function(t.spark)
    _open_pages(t).withColumn("rowtime", F.timestamp_millis("ts")).createOrReplaceTempView("keyword_page_log")
    return t.spark.sql("""
        SELECT keyword, count(*) AS ct, 'SEARCH' AS source,
               date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS stt, date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS edt
        FROM (SELECT k.keyword, p.rowtime
              FROM keyword_page_log p, LATERAL ik_analyze(p.page['item']) AS k(keyword)
              WHERE p.page['page_id'] = 'good_list' AND p.page['item'] IS NOT NULL)
        GROUP BY window(rowtime, '1 day'), keyword""")


@query("keyword_tokenizer", """
SELECT keyword, count(*) AS ct FROM (SELECT unnest(string_split(p_name, ' ')) AS keyword FROM part) y GROUP BY keyword""")
def keyword_tokenizer(t: Tables) -> DataFrame:
    """Keywords by a tokenizer of the user's own, run in Arrow batches over the distinct names."""
    names = t.part.groupBy("p_name").agg(F.count("*").alias("n"))
    words = explode_keywords(names, "p_name", tokenizer=str.split)
    return words.groupBy("keyword").agg(F.sum("n").alias("ct"))


@query("document_keywords", r"""
SELECT lang, keyword, count(*) AS ct FROM (
  SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS keyword FROM documents) y
GROUP BY lang, keyword""")
def document_keywords(t: Tables) -> DataFrame:
    """Keywords of whole texts, counted by language."""
    return explode_keywords(t.documents.select("lang", "text"), "text").groupBy("lang", "keyword").agg(
        F.count("*").alias("ct")
    )


@query("json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CAST(json_extract_string(props, '$.k') AS DECIMAL(16,2)) AS amount FROM events""")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", json_long("props", "$.k").alias("k"), json_decimal("props", "$.k").alias("amount"))


@query("date_functions", """
SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text,
       CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds_text,
       date_trunc('second', ts) AS parsed, strftime(ts, '%H') AS hour_text FROM events""")
def date_functions(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = t.events.select("event_id", ms.alias("millis"), datetime_text("ts").alias("text"))
    return rows.select(
        "event_id", day_text("millis").alias("day"), "text", epoch_ms("text").alias("ms"),
        from_epoch_text("millis").alias("seconds_text"), to_time("text").cast("timestamp_ntz").alias("parsed"),
        F.date_format(to_time("text"), "HH").alias("hour_text"),
    )


@query("age", "SELECT c_custkey, CAST(floor((10000 + c_custkey) / 365.0) AS INTEGER) AS age FROM customer")
def age(t: Tables) -> DataFrame:
    """Age on a fixed day of people born up to many days earlier."""
    as_of = F.lit("2024-06-30").cast("date")
    born = F.date_sub(as_of, (F.col("c_custkey") + 10000).cast("int"))
    return t.customer.select("c_custkey", age_years(born, as_of).alias("age"))


@query("value_functions", """
SELECT event_id, event_type || ':' || user_id AS route_key, 'dim:user:' || user_id || '_' || event_type AS cache_key,
       CAST(NULL AS VARCHAR) AS absent, event_type AS present, 'a,' || event_type AS joined, event_type AS second,
       event_type = 'view' AS blank, coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE props END, 'none') AS first_value,
       CAST(length(event_type) AS INTEGER) AS chars, upper(event_type) = 'VIEW' AS same, value + user_id AS added
FROM events""")
def value_functions(t: Tables) -> DataFrame:
    entries = F.create_map(F.lit("type"), F.col("event_type"))
    names = F.concat(F.lit("a,"), F.col("event_type"))
    page = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return t.events.select(
        "event_id", compose_key("event_type", F.col("user_id").cast("string")).alias("route_key"),
        compose_key(
            F.lit("dim"), F.lit("user"), compose_key(F.col("user_id").cast("string"), "event_type", separator="_")
        ).alias("cache_key"),
        map_value(entries, "other").alias("absent"), map_value(entries, "type").alias("present"),
        join_names(split_names(names)).alias("joined"), F.element_at(split_names(names), 2).alias("second"),
        is_blank(page).alias("blank"),
        first_non_null(F.when(F.col("event_type") != "view", F.col("props")), F.lit("none")).alias("first_value"),
        F.length("event_type").alias("chars"), (F.upper("event_type") == "VIEW").alias("same"),
        (F.col("value") + F.col("user_id")).alias("added"),
    )


@query("json_put", """
SELECT event_id, 'm' || user_id AS mid, CASE WHEN event_type = 'signup' THEN '0' ELSE '1' END AS is_new FROM events""")
def json_put(t: Tables) -> DataFrame:
    """A field overwritten inside a nested record, in some rows with its own value."""
    rows = t.events.select(
        "event_id", "event_type", F.struct(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("mid"), F.lit("1").alias("is_new")).alias("common")
    )
    value = F.when(F.col("event_type") == "signup", "0").otherwise(F.col("common.is_new"))
    fixed = rows.withColumn("common", put_field("common", "is_new", value))
    return fixed.select("event_id", "common.mid", "common.is_new")
