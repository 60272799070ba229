"""Queries on database changes: normalising, routing by rule, folding to current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import map_value
from ..operators import (
    by_id, current_rules, current_table, latest_by_key, normalise_changes, parse_json, to_json_value, valid_changes,
)
from ..operators.routing import route_changes
from ..schemas import ENVELOPE_SCHEMA, RULE_COLUMNS
from ..session import working_dir
from ..sources import DimensionStore, StoredDimension, table_columns, with_snapshot
from . import jobs, shop
from .registry import query
from .shop import Tables

CHANGES_SQL = """
changes AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS tbl,
         CASE event_id % 3 WHEN 0 THEN 'bootstrap-insert' WHEN 1 THEN 'insert' ELSE 'update' END AS op,
         event_id % 13 = 0 AS empty, CAST(user_id AS VARCHAR) AS id FROM events)
"""

RULES_SQL = """
rules AS (SELECT * FROM (VALUES
  ('view', 'insert', 'kafka', 'dwd_view', 'id,event'), ('click', 'insert', 'kafka', 'dwd_click', 'event'),
  ('signup', 'insert', 'hbase', 'dim_signup', 'id,event'), ('signup', 'update', 'hbase', 'dim_signup', 'id,event'),
  ('purchase', 'update', 'hbase', 'dim_purchase', 'id,event'), ('error', 'insert', 'clickhouse', 'x', 'id'))
  v(source_table, operate_type, sink_type, sink_table, sink_columns))
"""

ROUTED_SQL = f"""{CHANGES_SQL}, {RULES_SQL},
routed AS (
  SELECT c.*, CASE WHEN op = 'bootstrap-insert' THEN 'insert' ELSE op END AS kind, r.* FROM changes c
  LEFT JOIN rules r ON source_table = tbl AND operate_type = CASE WHEN op = 'bootstrap-insert' THEN 'insert' ELSE op END
  WHERE tbl <> '' AND NOT empty)
"""


def _lines(t: Tables) -> DataFrame:
    return to_json_value(shop.change_rows(t.events))


def _routed(t: Tables):
    return jobs.database_routing(_lines(t), shop.rules(t.spark)).routed


def _keys(column: str = "data") -> object:
    return F.array_join(F.array_sort(F.map_keys(column)), ",")


@query("cdc_normalise", """
SELECT event_id AS seq, 'shop' AS database, event_type AS "table",
       CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'read' WHEN 2 THEN 'update' ELSE 'delete' END AS type,
       CASE WHEN event_id % 4 <> 3 THEN CAST(user_id AS VARCHAR) END AS id,
       CAST(CASE WHEN event_id % 4 = 3 THEN 0 ELSE 4 END AS INTEGER) AS fields
FROM events""")
def cdc_normalise(t: Tables) -> DataFrame:
    raw = parse_json(to_json_value(shop.envelopes(t.events)), ENVELOPE_SCHEMA).rows
    rows = normalise_changes(raw, keep=("ts_ms",))
    return rows.select(
        F.col("ts_ms").alias("seq"), "database", "table", "type", map_value("data", "id").alias("id"),
        F.size("data").alias("fields"),
    )


@query("cdc_filter", f"WITH {CHANGES_SQL} SELECT tbl AS \"table\", op AS type, CAST(event_id AS VARCHAR) AS event "
       "FROM changes WHERE tbl <> '' AND NOT empty")
def cdc_filter(t: Tables) -> DataFrame:
    return valid_changes(shop.change_rows(t.events)).select("table", "type", map_value("data", "event").alias("event"))


@query("table_router", """
WITH cfg AS (SELECT * FROM (VALUES ('view', 'insert', 'kafka', 'dwd_view'), ('click', 'insert', 'kafka', 'dwd_click'),
  ('signup', 'insert', 'hbase', 'dim_signup'), ('error', 'insert', 'clickhouse', 'x')) v(st, op, sink_type, sink_table))
SELECT event_id, sink_type, sink_table FROM events JOIN cfg ON st = event_type AND op = 'insert'
WHERE sink_type IN ('kafka', 'hbase')""")
def table_router(t: Tables) -> DataFrame:
    """Every event as an insert, routed by the insert rules."""
    from ..operators import route_changes

    changes = t.events.select(
        F.col("event_id"), F.lit("shop").alias("database"), F.col("event_type").alias("table"),
        F.lit("insert").alias("type"), F.create_map(F.lit("id"), F.col("user_id").cast("string")).alias("data"),
    )
    routed = route_changes(changes, shop.rules(t.spark).filter("operate_type = 'insert'"))
    facts = routed.facts.select("event_id", F.lit("kafka").alias("sink_type"), "sink_table")
    return facts.unionByName(routed.dims.select("event_id", F.lit("hbase").alias("sink_type"), "sink_table"))


@query("router_facts", f"""WITH {ROUTED_SQL}
SELECT tbl AS "table", kind AS type, sink_table, CAST(event_id AS VARCHAR) AS event,
       CASE WHEN sink_columns = 'id,event' THEN id END AS id,
       CASE WHEN sink_columns = 'id,event' THEN 'event,id' ELSE 'event' END AS kept
FROM routed WHERE sink_type = 'kafka'""")
def router_facts(t: Tables) -> DataFrame:
    """Routed fact rows with their columns pruned to the rule's list."""
    return _routed(t).facts.select(
        "table", "type", "sink_table", map_value("data", "event").alias("event"), map_value("data", "id").alias("id"),
        _keys().alias("kept"),
    )


@query("router_dims", f"""WITH {ROUTED_SQL}
SELECT tbl AS "table", kind AS type, sink_table, 'id' AS sink_pk, id, CAST(event_id AS VARCHAR) AS event, 'event,id' AS kept
FROM routed WHERE sink_type = 'hbase'""")
def router_dims(t: Tables) -> DataFrame:
    return _routed(t).dims.select(
        "table", "type", "sink_table", "sink_pk", map_value("data", "id").alias("id"),
        map_value("data", "event").alias("event"), _keys().alias("kept"),
    )


@query("router_unmatched", f"""WITH {ROUTED_SQL}
SELECT tbl AS "table", kind AS type, CAST(event_id AS VARCHAR) AS event FROM routed
WHERE sink_type IS NULL OR sink_type NOT IN ('kafka', 'hbase')""")
def router_unmatched(t: Tables) -> DataFrame:
    return _routed(t).unmatched.select("table", "type", map_value("data", "event").alias("event"))


@query("dim_latest", """
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) x
WHERE r = 1 AND event_type <> 'error'""")
def dim_latest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "value", "event_type")
    last = latest_by_key(rows, ["user_id"], ["event_id"], F.col("event_type") == "error")
    return last.select("user_id", "event_id", "value")


@query("current_table", """
SELECT user_id AS id, event_id AS event, CAST(value AS DECIMAL(16,2)) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE event_type = 'signup') x
WHERE r = 1 AND event_id % 4 <> 3""")
def mirrored_table(t: Tables) -> DataFrame:
    """Current rows of one source table, its changes and deletes applied."""
    changes = normalise_changes(shop.envelopes(t.events), keep=("before", "ts_ms"))
    columns = {"id": "bigint", "event": "bigint", "value": "decimal(16,2)"}
    return current_table(changes, "shop", "signup", columns, "id", ["ts_ms"])


@query("snapshot_changes", """
SELECT c_custkey AS id, CAST(coalesce(v, c_acctbal) AS DECIMAL(16,2)) AS value
FROM customer LEFT JOIN (
  SELECT user_id, value AS v, event_id AS e,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE event_type = 'signup') x
  ON user_id = c_custkey AND r = 1
WHERE e IS NULL OR e % 4 <> 3
UNION ALL
SELECT user_id, CAST(value AS DECIMAL(16,2)) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE event_type = 'signup') y
WHERE r = 1 AND event_id % 4 <> 3 AND user_id NOT IN (SELECT c_custkey FROM customer)""")
def snapshot_changes(t: Tables) -> DataFrame:
    """A table's snapshot followed by its changes, folded to current rows."""
    snapshot = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    changes = normalise_changes(shop.envelopes(t.events), keep=("before", "ts_ms"))
    plain = changes.withColumn(
        "data", F.when(F.size("data") > 0, F.col("data")).otherwise(F.col("before"))
    )
    rows = with_snapshot(snapshot, "shop", "signup", plain)
    return current_table(rows, "shop", "signup", {"id": "bigint", "value": "decimal(16,2)"}, "id", ["ts_ms"])


def _rule_changes(t: Tables) -> DataFrame:
    """Rule changes out of events: one rule per event type and user, changed and deleted over time."""
    return t.events.select(
        F.col("event_type").alias("source_table"),
        F.concat(F.lit("op"), (F.col("user_id") % 40).cast("string")).alias("operate_type"),
        F.lit("kafka").alias("sink_type"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("sink_table"),
        F.lit("id,event").alias("sink_columns"), F.lit(None).cast("string").alias("sink_pk"),
        F.lit(None).cast("string").alias("sink_extend"),
        F.when(F.col("event_id") % 5 == 0, "delete").otherwise("update").alias("type"),
        F.col("event_id").alias("seq"),
    )


@query("rules_current", """
SELECT event_type AS source_table, 'op' || (user_id % 40) AS operate_type, 't' || event_id AS sink_table FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 40 ORDER BY event_id DESC) r FROM events) x
WHERE r = 1 AND event_id % 5 <> 0""")
def rules_current(t: Tables) -> DataFrame:
    return current_rules(_rule_changes(t), ["seq"]).select("source_table", "operate_type", "sink_table")


@query("rules_kept", """
SELECT event_type AS source_table, 'op' || (user_id % 40) AS operate_type, 't' || event_id AS sink_table FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 40 ORDER BY event_id DESC) r
  FROM events WHERE event_id % 5 <> 0) x WHERE r = 1""")
def rules_kept(t: Tables) -> DataFrame:
    """The same with deletes ignored."""
    return current_rules(_rule_changes(t), ["seq"], keep_deleted=True).select(
        "source_table", "operate_type", "sink_table"
    )


@query("dim_table_columns", """
WITH t AS (SELECT DISTINCT 'dim_' || event_type AS sink_table FROM events)
SELECT sink_table, 0 AS position, 'id' AS "column", 'STRING' AS kind, true AS is_key, '' AS extension FROM t
UNION ALL SELECT sink_table, 1, 'event', 'STRING', false, '' FROM t""")
def dim_table_columns(t: Tables) -> DataFrame:
    """Column lists of the dimension tables that a rule per event type calls for."""
    rules = t.events.select("event_type").distinct().select(
        F.col("event_type").alias("source_table"), F.lit("insert").alias("operate_type"),
        F.lit("hbase").alias("sink_type"), F.concat(F.lit("dim_"), "event_type").alias("sink_table"),
        F.lit("id,event").alias("sink_columns"), F.lit(None).cast("string").alias("sink_pk"),
        F.lit(None).cast("string").alias("sink_extend"),
    )
    return table_columns(rules)


@query("dim_upsert", """
SELECT CAST(user_id AS VARCHAR) AS "ID", CAST(event_id AS VARCHAR) AS "EVENT" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) x
WHERE r = 1 AND event_type <> 'error'""")
def dim_upsert(t: Tables) -> DataFrame:
    """Two batches of upserts and deletes in a dimension store, folded in between, and read back."""
    store = DimensionStore(t.spark, working_dir(t.spark, "dims"))
    changes = t.events.select(
        F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("type"),
        F.create_map(
            F.lit("id"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_id").cast("string")
        ).alias("data"),
        F.lit("dim_user").alias("sink_table"), F.lit("id").alias("sink_pk"), F.col("event_id").alias("seq"), "ts",
    )
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    store.apply(changes.filter(early), 0, sequence="seq")
    store.compact(0)
    store.apply(changes.filter(~early), 1, sequence="seq")
    return store.table("dim_user", ["id", "event"])


@query("dim_lookup_by_key", """
SELECT o_orderkey AS order_id, CASE WHEN c_custkey % 9 <> 0 THEN CASE WHEN c_custkey % 10 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END END AS segment
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def dim_lookup_by_key(t: Tables) -> DataFrame:
    """A folded dimension with changes since, of which a lookup reads the buckets of its keys only."""
    store = DimensionStore(t.spark, working_dir(t.spark, "dims"))
    row = lambda kind, segment: t.customer.select(
        F.lit(kind).alias("type"), F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("segment"), segment).alias("data"),
        F.lit("dim_customer").alias("sink_table"), F.lit("id").alias("sink_pk"), F.col("c_custkey").alias("seq"))
    store.apply(row("insert", F.col("c_mktsegment")), 0, sequence="seq")
    store.compact(0)
    store.apply(row("update", F.upper("c_mktsegment")).filter("seq % 10 = 0"), 1, sequence="seq")
    store.apply(row("delete", F.col("c_mktsegment")).filter("seq % 9 = 0"), 2, sequence="seq")
    facts = t.orders.select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    customers = StoredDimension(store, "dim_customer", ["id", "segment"])
    return by_id(facts, customers, "o_custkey", {"segment": "SEGMENT"}, few=True).select("order_id", "segment")


# Two dimension tables by rule: one plain, one with a key and types of its own; a third rule is no table.
TABLE_RULES = (
    ("signup", "insert", "hbase", "dim_signup", "id,event", None, None),
    ("purchase", "insert", "hbase", "dim_purchase", "event,id,value", "event", "id BIGINT, value DECIMAL(16,2)"),
    ("view", "insert", "kafka", "dwd_view", "id", None, None),
)


@query("dim_table_from_rules", """
SELECT 'dim_signup' AS tab, CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS VARCHAR) AS event, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DECIMAL(16,2)) AS value
FROM events WHERE event_type = 'signup' GROUP BY user_id
UNION ALL
SELECT 'dim_purchase', CAST(event_id AS VARCHAR), NULL, user_id, CASE WHEN event_id % 5 <> 0 THEN CAST(value AS DECIMAL(16,2)) END FROM events WHERE event_type = 'purchase'""")
def dim_table_from_rules(t: Tables) -> DataFrame:
    """Tables come out of the rules, with keys and types: no code names their columns."""
    rules = t.spark.createDataFrame(list(TABLE_RULES), ", ".join(f"{c} string" for c in RULE_COLUMNS))
    amount = F.col("value").cast("decimal(16,2)").cast("string")
    data = F.create_map(
        F.lit("id"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_id").cast("string"),
        F.lit("value"), F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(amount), F.lit("noise"), F.lit("x"))
    changes = t.events.select(F.lit("shop").alias("database"), F.col("event_type").alias("table"), F.lit("insert").alias("type"), data.alias("data"), F.col("event_id").alias("seq"))
    store = DimensionStore(t.spark, working_dir(t.spark, "dims"))
    store.apply(route_changes(changes, rules).dims, 0, sequence="seq")
    found = store.tables(rules)
    none = lambda kind: F.lit(None).cast(kind)
    return found["dim_signup"].select(
        F.lit("dim_signup").alias("tab"), F.col("id").alias("key"), "event", none("bigint").alias("id"), none("decimal(16,2)").alias("value"),
    ).unionByName(found["dim_purchase"].select(
        F.lit("dim_purchase").alias("tab"), F.col("event").alias("key"), none("string").alias("event"), "id", "value"))
