"""The landing and the ten jobs on streams. Topics are the only link between them.

Every function returns a writer that is not started yet: the caller sets the
trigger and starts it. A job restarted with its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import timedelta
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schemas
from ..functions import day_of, put_field
from ..functions.keywords import Tokenizer, register_keyword_function
from ..operators import measures as m
from ..operators import stats
from ..operators.parse import in_time, parse_fields, parse_json, to_json_value
from ..operators.routing import LINE, display_text, page_text, route_changes, split_logs, start_text
from ..operators.changes import normalise_changes, valid_changes
from ..operators.visitors import is_entry
from ..operators.wide import Dimensions, enrich_order_wide, enrich_products, order_with_detail, payment_wide, with_rowtime
from ..schemas import TOPICS
from ..sources import DimensionStore, RuleLog, StoredDimension, Topics, WaitingRows, land_logs
from ..streaming import (
    FlagDays, StatsTable, bounces_stream, first_per_day_stream, mirrored_stream, repair_new_flag_stream, weighted_totals,
)
from .jobs import BOUNCE_SECONDS, ProductFacts, product_measures, with_device

# Fixed lateness allowed to event times.
DELAY = "3 seconds"

# Tasks over which the rows of one key are dealt in stream joins.
SPREAD = 4


# Event times that a fact needs to take part.
FACT_TIMES = {name: ("create_time",) for name in ("order", "detail", "favor", "cart", "refund", "comment")}
FACT_TIMES["payment"] = ("callback_time",)


@contextmanager
def kept(batch: DataFrame) -> Iterator[DataFrame]:
    """A micro-batch that is read more than once: in memory, on disk where memory is short."""
    rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class Warehouse:
    """Topics, dimension store and checkpoint folder the jobs share."""

    topics: Topics
    store: DimensionStore
    checkpoints: str

    def checkpoint(self, job: str) -> str:
        return f"{self.checkpoints}/{job}"

    def rows(self, topic: str, schema: str, line: str | None = None) -> DataFrame:
        """Rows of a topic; `rejected_rows` keeps the lines that are none."""
        return parse_json(self.topics.stream(TOPICS[topic]), schema, line=line).rows

    def facts(self, topic: str, schema: str) -> DataFrame:
        """Rows of a topic that the change router fills; their columns arrive as text."""
        return parse_fields(self.topics.routed_stream(TOPICS[topic]), schema, times=FACT_TIMES[topic]).rows

    def dimensions(self) -> Dimensions:
        """The dimensions as they are now."""
        return Dimensions(**{
            role: self.store.table(name, columns) for role, (name, columns) in schemas.DIMENSION_TABLES.items()
        })

    def dimensions_by_key(self) -> Dimensions:
        """The same for micro-batches: of users and products, which grow, only the buckets of the keys asked for."""
        named = {role: StoredDimension(self.store, *schemas.DIMENSION_TABLES[role]) for role in ("user", "sku")}
        return replace(self.dimensions(), **named)

    def emit_batches(
        self, df: DataFrame, topic: str, job: str, step: Callable[[DataFrame], DataFrame], mode: str = "append"
    ) -> DataStreamWriter:
        """Write what `step` makes of each micro-batch, so that it sees the dimensions of that moment."""

        def write(batch: DataFrame, batch_id: int) -> None:
            with kept(batch) as rows:
                self.topics.write_batch(to_json_value(step(rows)), TOPICS[topic], batch_id)

        writer = df.writeStream.outputMode(mode).option("checkpointLocation", self.checkpoint(job))
        return writer.foreachBatch(write)

    def emit_lines(self, lines: DataFrame, topic: str, job: str, mode: str) -> DataStreamWriter:
        """Write ready texts per micro-batch."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.topics.write_batch(batch, TOPICS[topic], batch_id)

        writer = lines.writeStream.outputMode(mode).option("checkpointLocation", self.checkpoint(job))
        return writer.foreachBatch(write)

    def emit(self, df: DataFrame, topic: str, job: str) -> DataStreamWriter:
        return self.topics.write_stream(to_json_value(df), TOPICS[topic], self.checkpoint(job))


def log_landing(house: Warehouse, lines: DataFrame, folder: str) -> DataStreamWriter:
    """Raw log lines (a stream of strings) to day folders below `folder` and to the raw log topic."""

    def write(batch: DataFrame, batch_id: int) -> None:
        land_logs(batch, folder, batch_id, house.topics, TOPICS["log"])

    return lines.writeStream.option("checkpointLocation", house.checkpoint("log_landing")).foreachBatch(write)


def log_routing(house: Warehouse, days: FlagDays) -> DataStreamWriter:
    """Raw logs to page, start and display topics, whole as they came; broken lines to a reject topic."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_json(batch, schemas.LOG_SCHEMA, line=LINE)
        # The batch is read by the repair and by three outputs: keep it parsed, on disk
        # where memory is short.
        rows = parsed.rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            plain = split_logs(rows)
            flat = rows.withColumn("_mid", F.col("common.mid")).withColumn("_flag", F.col("common.is_new"))
            fixed = days.repair(flat, batch_id, "_mid", "_flag", day_of("ts"))
            fixed = fixed.withColumn("common", put_field("common", "is_new", F.col("_flag"))).drop("_mid", "_flag")
            topics = house.topics
            topics.write_batch(page_text(split_logs(fixed).page), TOPICS["page"], batch_id)
            topics.write_batch(start_text(plain.start), TOPICS["start"], batch_id)
            topics.write_batch(display_text(plain.page), TOPICS["display"], batch_id)
            topics.write_batch(parsed.rejects, TOPICS["log"] + "_rejects", batch_id)
        finally:
            rows.unpersist()

    lines = house.topics.stream(TOPICS["log"])
    return lines.writeStream.option("checkpointLocation", house.checkpoint("log_routing")).foreachBatch(write)


def log_routing_by_state(house: Warehouse) -> DataStreamWriter:
    """The same with the first flagged days in keyed state: a micro-batch costs what its own devices cost.

    The state sees a line, its device, flag and day; each line is parsed whole afterwards, so broken ones reach the reject topic.
    """
    lines = house.topics.stream(TOPICS["log"])
    field = lambda path: F.get_json_object("value", path)
    slim = lines.select("value", field("$.common.mid").alias("mid"), field("$.common.is_new").alias("flag"),
                        field("$.ts").try_cast("bigint").alias("ms"))
    fixed = repair_new_flag_stream(slim, "mid", "flag", F.when(in_time("ms"), day_of("ms"))).select("value", "flag")

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch is kept as the state gives it out, so that rows and rejects together meet the state once.
        with kept(batch) as lines_of:
            parsed = parse_json(lines_of, schemas.LOG_SCHEMA, keep=("flag",), line=LINE)
            rows = parsed.rows.withColumn("common", put_field("common", "is_new", F.col("flag"))).drop("flag")
            with kept(rows) as rows:
                logs = split_logs(rows)
                topics = house.topics
                topics.write_batch(page_text(logs.page), TOPICS["page"], batch_id)
                topics.write_batch(start_text(logs.start), TOPICS["start"], batch_id)
                topics.write_batch(display_text(logs.page), TOPICS["display"], batch_id)
                topics.write_batch(parsed.rejects.select("value", "reason"), TOPICS["log"] + "_rejects", batch_id)

    return fixed.writeStream.option("checkpointLocation", house.checkpoint("log_routing")).foreachBatch(write)


def rule_updates(house: Warehouse, log: RuleLog, topic: str) -> DataStreamWriter:
    """Changes of the rule table, as they come from a topic of change rows, to versions of the rules."""

    def write(batch: DataFrame, batch_id: int) -> None:
        changes = valid_changes(parse_json(batch, schemas.CHANGE_SCHEMA + ", ts BIGINT").rows)
        fields = [F.try_element_at("data", F.lit(c)).alias(c) for c in schemas.RULE_COLUMNS]
        log.append(changes.select(*fields, "type", F.coalesce("ts", F.lit(0)).alias("seq")), batch_id)

    lines = house.topics.stream(topic)
    return lines.writeStream.option("checkpointLocation", house.checkpoint("rule_updates")).foreachBatch(write)


def database_routing(
    house: Warehouse, rules: Callable[[], DataFrame] | WaitingRows, compact_every: int = 50
) -> DataStreamWriter:
    """Change rows to dimension tables and fact topics.

    `rules` is called for every micro-batch, before its rows are routed; rows without a rule then go to an unmatched topic.
    With `WaitingRows` the rules come from their log, and rows without one wait for the version that serves them. Changes of one key
    inside a batch follow their `ts`, and their order of arrival where it is equal or missing. Broken lines go to a reject topic.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        read = batch.withColumn("_row", F.monotonically_increasing_id())
        both = parse_json(read, schemas.CHANGE_SCHEMA + ", ts BIGINT", keep=("arrived", "_row"))
        parsed = both.rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            waits = isinstance(rules, WaitingRows)
            valid = valid_changes(parsed)
            routed = rules.route(valid, batch_id) if waits else route_changes(valid, rules())
            house.store.apply(routed.dims, batch_id, sequence=["ts", "arrived", "_row"])
            house.topics.write_batch(both.rejects, TOPICS["changes"] + "_rejects", batch_id)
            if not waits:
                house.topics.write_batch(
                    to_json_value(routed.unmatched.drop("arrived", "_row")), TOPICS["changes"] + "_unmatched", batch_id)
            facts = routed.facts.select("sink_table", F.to_json("data").alias("value"))
            house.topics.write_routed(facts, batch_id)
        finally:
            parsed.unpersist()
        if batch_id and batch_id % compact_every == 0:
            house.store.compact(batch_id)

    lines = house.topics.stream(TOPICS["changes"], placed=True)
    return lines.writeStream.option("checkpointLocation", house.checkpoint("database_routing")).foreachBatch(write)


def rejected_rows(house: Warehouse, topic: str, schema: str, routed: bool = False) -> DataStreamWriter:
    """Lines of a topic that the jobs reading it leave out, to the topic's reject topic.

    Jobs with state have one output, so their rejects come from a query of their own. `routed` topics
    are those the change router fills.
    """
    if routed:
        found = parse_fields(house.topics.routed_stream(TOPICS[topic]), schema, times=FACT_TIMES[topic]).rejects
    else:
        found = parse_json(house.topics.stream(TOPICS[topic]), schema).rejects
    name = TOPICS[topic] + "_rejects"

    def write(batch: DataFrame, batch_id: int) -> None:
        house.topics.write_batch(batch, name, batch_id)

    return found.writeStream.option("checkpointLocation", house.checkpoint(f"rejected_{topic}")).foreachBatch(write)


def mirrored_table(
    house: Warehouse, source: str, topic: str, database: str, table: str, columns: dict[str, str], key: str,
    forget_deleted: timedelta | None = None,
) -> DataStreamWriter:
    """The rows of a source table as they come and go, with weights, from a topic of change envelopes to another topic."""
    envelopes = parse_json(house.topics.stream(source), schemas.ENVELOPE_SCHEMA).rows
    changes = normalise_changes(envelopes, keep=("before", "ts_ms"))
    rows = to_json_value(mirrored_stream(changes, database, table, columns, key, ["ts_ms"], forget_deleted))

    def write(batch: DataFrame, batch_id: int) -> None:
        house.topics.write_batch(batch, topic, batch_id)

    return rows.writeStream.outputMode("append").option("checkpointLocation", house.checkpoint(f"mirror_{topic}")).foreachBatch(write)


def mirrored_totals(
    house: Warehouse, topic: str, schema: str, by: dict[str, str], sums: dict[str, str], totals: StatsTable
) -> DataStreamWriter:
    """Totals over the rows that a mirrored table has now; `totals.latest` reads them."""
    rows = parse_json(house.topics.stream(topic), schema).rows
    found = weighted_totals(rows, by, sums)
    writer = found.writeStream.outputMode("update").option("checkpointLocation", house.checkpoint(f"totals_{topic}"))
    return writer.foreachBatch(totals.write)


def unique_visitors(house: Warehouse, delay: str = DELAY) -> DataStreamWriter:
    """First entry pages of a device and day, whole as they came."""
    pages = house.rows("page", schemas.LOG_SCHEMA, LINE)
    timed = with_device(pages).withColumn("_time", F.timestamp_millis("ts"))
    first = first_per_day_stream(timed, "_mid", "_time", ["ts", "_tie"], delay, is_entry("page.last_page_id"))
    lines = first.select(F.col(LINE).alias("value"))
    return house.emit_lines(lines, "unique_visitor", "unique_visitors", "update")


def bounced_visitors(house: Warehouse, timeout_seconds: int = BOUNCE_SECONDS, delay: str = DELAY) -> DataStreamWriter:
    """Bounced entry pages, whole as they came."""
    pages = house.rows("page", schemas.LOG_SCHEMA, LINE)
    timed = with_device(pages).withColumn("_time", F.timestamp_millis("ts"))
    found = bounces_stream(timed, "_mid", "_time", ["_tie"], is_entry("page.last_page_id"), timeout_seconds, delay)
    lines = found.select(F.col(LINE).alias("value"))
    return house.topics.write_stream(lines, TOPICS["bounce"], house.checkpoint("bounced_visitors"))


def _timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    return with_rowtime(df, column).withWatermark("rowtime", delay)


def order_wide(house: Warehouse, as_of: Column | None = None, delay: str = DELAY) -> DataStreamWriter:
    """Order wide rows; ages count up to `as_of`, today unless given."""
    orders = _timed(house.facts("order", schemas.ORDER_INFO_SCHEMA), "create_time", delay)
    details = _timed(house.facts("detail", schemas.ORDER_DETAIL_SCHEMA), "create_time", delay)
    day = F.current_date() if as_of is None else as_of
    return house.emit_batches(
        order_with_detail(orders, details, spread=SPREAD), "order_wide", "order_wide",
        lambda batch: enrich_order_wide(batch, house.dimensions_by_key(), day, few=True),
    )


def payment_wide_rows(house: Warehouse, delay: str = DELAY) -> DataStreamWriter:
    payments = _timed(house.facts("payment", schemas.PAYMENT_INFO_SCHEMA), "callback_time", delay)
    wide = _timed(house.rows("order_wide", schemas.ORDER_WIDE_SCHEMA), "create_time", delay)
    return house.emit(payment_wide(payments, wide, spread=SPREAD), "payment_wide", "payment_wide")


def visitor_statistics(
    house: Warehouse, table: StatsTable, timeout_seconds: int = BOUNCE_SECONDS, late: int = 3, size: str = stats.WINDOW
) -> DataStreamWriter:
    """Visitor statistics from the page, unique-visitor and bounce topics.

    Each topic has a watermark of its own, and windows close behind the slowest of the three, so a topic that
    runs behind the pages loses nothing. Bounces appear up to twice the timeout plus `late` seconds after their event
    time, which every watermark waits for.
    """
    branches = [
        m.page_views(house.rows("page", schemas.LOG_SCHEMA)),
        m.unique_visits(house.rows("unique_visitor", schemas.LOG_SCHEMA)),
        m.bounced_visits(house.rows("bounce", schemas.LOG_SCHEMA)),
    ]
    delay = f"{2 * timeout_seconds + late} seconds"
    timed = [b.withColumn("rowtime", F.timestamp_millis("ts")).withWatermark("rowtime", delay) for b in branches]
    rows = reduce(DataFrame.unionByName, timed)
    return table.write_stream(stats.visitor_stats(rows, size), house.checkpoint("visitor_statistics"))


def product_statistics(
    house: Warehouse, table: StatsTable, delay: str = DELAY, size: str = stats.WINDOW
) -> DataStreamWriter:
    paid_schema = f"sku_id BIGINT, order_id BIGINT, split_total_amount {schemas.MONEY}, callback_time STRING"
    facts = ProductFacts(
        pages=house.rows("page", schemas.LOG_SCHEMA),
        order_wide=house.rows("order_wide", schemas.ORDER_WIDE_SCHEMA),
        payment_wide=house.rows("payment_wide", paid_schema),
        favors=house.facts("favor", schemas.FAVOR_SCHEMA),
        carts=house.facts("cart", schemas.CART_SCHEMA),
        refunds=house.facts("refund", schemas.REFUND_SCHEMA),
        comments=house.facts("comment", schemas.COMMENT_SCHEMA),
    )
    # A watermark per branch, as in the visitor statistics: order and payment rows trail the pages.
    timed = product_measures(facts, lambda branch: branch.withWatermark("rowtime", delay))

    def write(batch: DataFrame, batch_id: int) -> None:
        with kept(batch) as rows:
            table.write(enrich_products(rows, house.dimensions_by_key(), with_price=True, few=True), batch_id)

    writer = stats.product_stats(timed, size).writeStream.outputMode("append")
    return writer.option("checkpointLocation", house.checkpoint("product_statistics")).foreachBatch(write)


KEYWORD_SQL = """
SELECT keyword, count(*) AS ct, 'SEARCH' AS source,
       date_format(window.start, 'yyyy-MM-dd HH:mm:ss') AS stt,
       date_format(window.end, 'yyyy-MM-dd HH:mm:ss') AS edt
FROM (SELECT k.keyword, p.rowtime
      FROM page_log p, LATERAL {function}(try_element_at(p.page, 'item')) AS k(keyword)
      WHERE try_element_at(p.page, 'page_id') = :page_id AND try_element_at(p.page, 'item') IS NOT NULL)
GROUP BY window(rowtime, :size), keyword
"""


def keyword_statistics(
    house: Warehouse, table: StatsTable, delay: str = DELAY, start: str = "latest", size: str = stats.WINDOW,
    page_id: str = "good_list", tokenizer: Tokenizer | None = None,
) -> DataStreamWriter:
    """Keyword statistics as SQL over a streaming view and a table function, a user's `tokenizer` if given."""
    spark = house.topics.spark
    # A session cannot turn a Python table function back into a SQL one, so each kind has a name of its own.
    function = "ik_analyze" if tokenizer is None else "ik_analyze_own"
    register_keyword_function(spark, function, tokenizer)
    house.topics.view(
        "page_log", TOPICS["page"], schemas.PAGE_MAP_SCHEMA,
        "to_timestamp(from_unixtime(ts div 1000, 'yyyy-MM-dd HH:mm:ss'))", delay, start,
    )
    found = spark.sql(KEYWORD_SQL.replace("{function}", function), args={"page_id": page_id, "size": size})
    return table.write_stream(found, house.checkpoint("keyword_statistics"))


def province_statistics(house: Warehouse, table: StatsTable, delay: str = DELAY) -> DataStreamWriter:
    wide = _timed(house.rows("order_wide", schemas.ORDER_WIDE_SCHEMA), "create_time", delay)
    return table.write_stream(stats.province_stats(wide), house.checkpoint("province_statistics"))
