"""One input, many outputs: log routing and rule-driven change routing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import compose_key, split_names
from ..schemas import RULE_COLUMNS, SINK_DIM, SINK_FACT
from .changes import latest_by_key


# Name of the column in which log rows carry their whole text.
LINE = "_line"


def _entries(text: Column) -> Column:
    """The fields of a JSON object, each with its own type; null where there is no object."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>")


def with_fields(text: Column, **fields: Column) -> Column:
    """A JSON object with some fields set to other JSON texts; all others stay as they are."""
    own = F.map_filter(_entries(text), lambda name, _: ~name.isin(*fields))
    new = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), F.try_parse_json(value))])
    return F.to_json(F.map_concat(own, new))


def page_text(pages: DataFrame, line: str = LINE) -> DataFrame:
    """Page rows as JSON strings: the whole text of the row, with `is_new` as it stands in `common`.

    Only rows whose flag was changed are written anew.
    """
    text = F.col(line)
    now, before = F.col("common.is_new"), F.get_json_object(text, "$.common.is_new")
    common = with_fields(F.get_json_object(text, "$.common"), is_new=F.to_json(F.struct(now.alias("x"))).substr(F.lit(6), F.length(now) + 2))
    return pages.select(F.when(before.eqNullSafe(now), text).otherwise(F.coalesce(with_fields(text, common=common), text)).alias("value"))


def start_text(starts: DataFrame, line: str = LINE) -> DataFrame:
    """Start logs as JSON strings: the `start` object as it was written."""
    return starts.select(F.get_json_object(line, "$.start").alias("value"))


def display_text(pages: DataFrame, line: str = LINE) -> DataFrame:
    """Each display of a page log as a JSON string, as it was written, with the page's `page_id` and `ts`."""
    shown = F.explode(F.from_json(F.get_json_object(line, "$.displays"), "ARRAY<STRING>"))
    page_id = F.to_json(F.array("page.page_id")).substr(F.lit(2), F.length(F.to_json(F.array("page.page_id"))) - 2)
    rows = pages.select(page_id.alias("_page"), F.col("ts").cast("string").alias("_ts"), shown.alias("_display"))
    null = F.lit("null")
    return rows.select(with_fields(F.col("_display"), page_id=F.coalesce("_page", null), ts=F.coalesce("_ts", null)).alias("value"))


class Logs(NamedTuple):
    page: DataFrame
    start: DataFrame
    display: DataFrame


def split_logs(logs: DataFrame) -> Logs:
    """Start logs leave as their `start` map alone; all others are page logs.

    Each display of a page log becomes a row of its own. Rows that carry their whole text keep it.
    """
    is_start = F.coalesce(F.size("start") > 0, F.lit(False))
    pages = logs.filter(~is_start)
    carried = [c for c in (LINE,) if c in logs.columns]
    return Logs(page=pages, start=logs.filter(is_start).select("start", *carried), display=explode_displays(pages))


def explode_displays(pages: DataFrame) -> DataFrame:
    """One map per element of `displays`, with the page's `page_id` and `ts` set."""
    parent = F.map_from_arrays(
        F.array(F.lit("page_id"), F.lit("ts")), F.array(F.col("page.page_id"), F.col("ts").cast("string"))
    )
    exploded = pages.select(F.col("page"), F.col("ts"), F.explode("displays").alias("_display"))
    own = F.map_filter("_display", lambda name, _: ~name.isin("page_id", "ts"))
    return exploded.select(F.map_concat(own, parent).alias("display"))


def current_rules(changes: DataFrame, sequence: list[str], keep_deleted: bool = False) -> DataFrame:
    """Routing rules in force: the last change of each `(source_table, operate_type)`.

    `changes` has the rule columns and a change `type`. A delete removes the rule
    unless `keep_deleted`.
    """
    if keep_deleted:
        changes = changes.filter(F.coalesce(F.col("type") != "delete", F.lit(True)))
    last = latest_by_key(changes, ["source_table", "operate_type"], sequence, F.col("type") == "delete")
    return last.select(*RULE_COLUMNS)


class Routed(NamedTuple):
    dims: DataFrame
    facts: DataFrame
    unmatched: DataFrame


def route_changes(changes: DataFrame, rules: DataFrame) -> Routed:
    """Send change rows where the rules say.

    The rule table is joined without a hint: it is broadcast by its measured size,
    so the changes do not shuffle. Rows without a rule, or whose rule names a sink
    that does not exist here, come out as `unmatched`.
    """
    kind = F.when(F.col("type") == "bootstrap-insert", "insert").otherwise(F.col("type"))
    keyed = changes.withColumn("type", kind).withColumn("_route", compose_key("table", "type"))
    rule = rules.select(
        compose_key("source_table", "operate_type").alias("_route"),
        "sink_type", "sink_table", "sink_columns", "sink_pk",
    )
    routed = keyed.join(rule, "_route", "left").drop("_route")
    names = split_names("sink_columns")
    pruned = routed.withColumn("data", F.map_filter("data", lambda name, _: F.array_contains(names, name)))
    plain = list(keyed.drop("_route").columns)
    served = F.coalesce(F.col("sink_type").isin(SINK_DIM, SINK_FACT), F.lit(False))
    return Routed(
        dims=pruned.filter(F.col("sink_type") == SINK_DIM).select(
            *plain, "sink_table", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk")
        ),
        facts=pruned.filter(F.col("sink_type") == SINK_FACT).select(*plain, "sink_table"),
        unmatched=routed.filter(~served).select(*plain),
    )
