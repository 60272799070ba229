"""The jobs on topics, end to end, with restarts, disorder and late rows."""

import json
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brookhouse import schemas
from brookhouse.operators import bounces, interval_join
from brookhouse.plans import jobs, stream_jobs
from brookhouse.plans.stream_jobs import Warehouse
from brookhouse.schemas import RULE_COLUMNS, TOPICS
from brookhouse.sources import DimensionStore, Topics, landed_logs
from brookhouse.streaming import FlagDays, StatsTable, bounces_stream, first_per_day_stream

BASE = 1_709_287_200_000  # 2024-03-01 10:00:00
FAR = BASE + 30 * 86_400_000
DAY = 86_400_000


class House:
    """A warehouse below a temporary folder, with helpers to feed and run it."""

    def __init__(self, spark, root):
        self.spark, self.root, self.files = spark, str(root), 0
        self.topics = Topics(spark, root=f"{self.root}/topics")
        self.store = DimensionStore(spark, f"{self.root}/dims")
        self.house = Warehouse(self.topics, self.store, f"{self.root}/checkpoints")

    def feed(self, topic, rows):
        folder = self.topics.path(topic)
        os.makedirs(folder, exist_ok=True)
        self.files += 1
        part = f"{folder}/.part{self.files}"
        with open(part, "w") as out:
            out.writelines((row if isinstance(row, str) else json.dumps(row)) + "\n" for row in rows)
        os.rename(part, f"{folder}/part{self.files}.txt")

    def run(self, writer):
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(400)
        return query

    def read(self, topic):
        return [json.loads(row.value) for row in self.topics.table(topic).collect()]

    def stats(self, name, columns):
        return StatsTable(self.spark, f"{self.root}/stats/{name}", columns)


@pytest.fixture
def house(spark, tmp_path):
    return House(spark, tmp_path)


def log(mid, ts, page_id="home", last=None, is_new="0", item=None, **more):
    return {"common": {"mid": mid, "vc": "v1", "ch": "c1", "ar": "a1", "is_new": is_new},
            "page": {"page_id": page_id, "last_page_id": last, "item": item, "during_time": 100}, "ts": ts, **more}


def change(table, data, kind="insert", ts=1):
    return {"database": "shop", "table": table, "type": kind, "data": data, "ts": ts}


FACTS = {
    "order_info": TOPICS["order"], "order_detail": TOPICS["detail"], "payment_info": TOPICS["payment"],
    "cart_info": TOPICS["cart"], "favor_info": TOPICS["favor"], "order_refund_info": TOPICS["refund"], "comment_info": TOPICS["comment"],
}
COLUMNS = {
    "order_info": "id,province_id,order_status,user_id,total_amount,create_time", "payment_info": "id,order_id,user_id,total_amount,subject,payment_type,create_time,callback_time",
    "order_detail": "id,order_id,sku_id,order_price,sku_num,sku_name,create_time,split_total_amount",
    "cart_info": "sku_id,create_time", "favor_info": "sku_id,create_time",
    "order_refund_info": "sku_id,order_id,refund_amount,create_time", "comment_info": "sku_id,appraise,create_time",
}


def rules(spark):
    rows = [(table, "insert", "kafka", topic, COLUMNS[table], None, None) for table, topic in FACTS.items()]
    for name, columns in schemas.DIMENSION_TABLES.values():
        rows += [(name[4:], kind, "hbase", name, ",".join(columns), "id", None) for kind in ("insert", "update")]
    return spark.createDataFrame(rows, ", ".join(f"{c} STRING" for c in RULE_COLUMNS))


def at(seconds, minute=0):
    return f"2024-03-01 10:{minute:02d}:{seconds:02d}"


def test_warehouse_end_to_end(house):
    spark, wh = house.spark, house.house
    house.feed(TOPICS["log"], [
        log("1", BASE, is_new="1"), log("1", BASE + 2000, "good_list", "home", item="Red ring"),
        log("1", BASE + 3000, "good_detail", "good_list", item="3", displays=[{"item": "3", "item_type": "sku_id"}, {"item": "z", "item_type": "activity"}]),
        log("2", BASE + 4000), {"common": {"mid": "3"}, "start": {"entry": "icon"}, "ts": BASE}, "{broken",
    ])
    days = FlagDays(spark, f"{house.root}/days")
    house.run(stream_jobs.log_routing(wh, days))
    # A second start of the same job: new rows only, and the flag is repaired by what the first one knew.
    house.feed(TOPICS["log"], [log("1", BASE + DAY, is_new="1"), log("end", FAR, "good_list", "home", item="end"),
        log("last", FAR, "good_detail", item="4", displays=[{"item": "4", "item_type": "sku_id"}]), log("later", FAR + 600_000, last="home")])
    house.run(stream_jobs.log_routing(wh, days))
    pages = house.read(TOPICS["page"])
    assert len(pages) == 8
    assert sorted((p["ts"], p["common"]["is_new"]) for p in pages if p["common"]["mid"] == "1") == [
        (BASE, "1"), (BASE + 2000, "0"), (BASE + 3000, "0"), (BASE + DAY, "0"),
    ]
    assert house.read(TOPICS["start"]) == [{"entry": "icon"}]
    assert {d["item"] for d in house.read(TOPICS["display"])} == {"3", "z", "4"}
    assert [row.value for row in house.topics.table(TOPICS["log"] + "_rejects").collect()] == ["{broken"]

    house.feed(TOPICS["changes"], [
        change("user_info", {"id": 7, "gender": "F", "birthday": "2000-03-01", "secret": "x"}),
        change("user_info", {"id": 7, "gender": "M", "birthday": "2000-03-01"}, "update", 2),
        change("base_province", {"id": 1, "name": "North", "area_code": "10", "iso_code": "N", "iso_3166_2": "X-N"}),
        change("sku_info", {"id": 3, "sku_name": "ring", "spu_id": 5, "category3_id": 6, "tm_id": 8, "price": "9.50"}),
        change("spu_info", {"id": 5, "spu_name": "rings"}), change("base_category3", {"id": 6, "name": "jewels"}),
        change("base_trademark", {"id": 8, "tm_name": "brand"}), change("unknown", {"id": 1}), change("order_info", {}),
    ])
    house.feed(TOPICS["changes"], [
        change("order_info", {"id": 1, "user_id": 7, "province_id": 1, "total_amount": 38.00, "create_time": at(1)}, "bootstrap-insert"),
        change("order_detail", {"id": 11, "order_id": 1, "sku_id": 3, "sku_num": 2, "order_price": 9.5, "split_total_amount": 19.00, "create_time": at(6)}),
        change("order_detail", {"id": 12, "order_id": 1, "sku_id": 3, "sku_num": 2, "order_price": 9.5, "split_total_amount": 19.00, "create_time": at(7)}),
        change("payment_info", {"id": 21, "order_id": 1, "user_id": 7, "total_amount": 38.00, "payment_type": "1101", "create_time": at(0, 20), "callback_time": at(0, 30)}),
        change("cart_info", {"sku_id": 3, "create_time": at(2)}), change("favor_info", {"sku_id": 3, "create_time": at(3)}),
        change("order_refund_info", {"sku_id": 3, "order_id": 1, "refund_amount": 4.00, "create_time": at(4)}),
        change("comment_info", {"sku_id": 3, "appraise": "1201", "create_time": at(5)}), change("comment_info", {"sku_id": 3, "appraise": "1203", "create_time": at(5)}),
        # Rows far ahead move the watermarks.
        change("order_info", {"id": 9, "user_id": 7, "province_id": 1, "create_time": "2024-03-31 00:00:00"}),
        change("order_detail", {"id": 99, "order_id": 9, "sku_id": 3, "sku_num": 1, "split_total_amount": 1, "create_time": "2024-03-31 00:00:00"}),
        change("payment_info", {"id": 98, "order_id": 9, "user_id": 7, "create_time": "2024-03-31 00:00:01", "callback_time": "2024-03-31 00:00:01"}),
        *[change(table, {"sku_id": 4, "create_time": "2024-03-31 00:00:00"}) for table in ("cart_info", "favor_info", "order_refund_info", "comment_info")],
        "{broken", {"database": "shop", "table": "user_info", "type": "update", "data": {"id": 7, "gender": "X"}, "ts": "soon"},
    ])
    house.run(stream_jobs.database_routing(wh, lambda: rules(spark)))
    # No line is lost: what cannot be read or has no rule stands in topics of its own.
    assert len(house.topics.table(TOPICS["changes"] + "_rejects").collect()) == 2
    assert [r["table"] for r in house.read(TOPICS["changes"] + "_unmatched")] == ["unknown"]
    user = wh.dimensions().user.collect()
    assert [(r.ID, r.GENDER) for r in user] == [("7", "M")]

    house.run(stream_jobs.unique_visitors(wh))
    assert sorted((r["common"]["mid"], r["ts"]) for r in house.read(TOPICS["unique_visitor"])) == [
        ("1", BASE), ("1", BASE + DAY), ("2", BASE + 4000), ("last", FAR),
    ]
    house.run(stream_jobs.bounced_visitors(wh))
    assert sorted((r["common"]["mid"], r["ts"]) for r in house.read(TOPICS["bounce"])) == [("1", BASE + DAY), ("2", BASE + 4000), ("last", FAR)]

    house.run(stream_jobs.order_wide(wh, F.lit("2024-03-01").cast("date")))
    wide = {r["detail_id"]: r for r in house.read(TOPICS["order_wide"])}
    assert sorted(wide) == [11, 99]
    assert (wide[11]["user_age"], wide[11]["user_gender"], wide[11]["province_name"]) == (24, "M", "North")
    assert (wide[11]["spu_name"], wide[11]["category3_name"], wide[11]["tm_name"]) == ("rings", "jewels", "brand")
    house.run(stream_jobs.payment_wide_rows(wh))
    assert sorted((r["payment_id"], r["detail_id"]) for r in house.read(TOPICS["payment_wide"])) == [(21, 11), (98, 99)]

    # Windows close behind the slowest topic; each of them has a row far ahead.
    visitors = house.stats("visitors", schemas.VISITOR_STATS_COLUMNS)
    house.run(stream_jobs.visitor_statistics(wh, visitors))
    got = {(r.stt, r.is_new): (r.uv_ct, r.pv_ct, r.sv_ct, r.uj_ct, r.dur_sum) for r in visitors.read().collect()}
    assert got == {
        (at(0), "1"): (1, 1, 1, 0, 100), (at(0), "0"): (1, 3, 1, 1, 300), ("2024-03-02 10:00:00", "0"): (1, 1, 1, 1, 100),
    }
    products = house.stats("products", schemas.PRODUCT_STATS_COLUMNS)
    house.run(stream_jobs.product_statistics(wh, products))
    row = next(r for r in products.read().collect() if r.stt == at(0))
    assert (row.click_ct, row.display_ct, row.cart_ct, row.favor_ct, row.comment_ct, row.good_comment_ct) == (1, 1, 1, 1, 2, 1)
    assert (row.order_ct, row.order_sku_num, row.order_amount, row.refund_order_ct, row.refund_amount) == (1, 2, Decimal("19.00"), 1, Decimal("4.00"))
    assert (row.sku_name, row.spu_name, row.tm_name, row.sku_price) == ("ring", "rings", "brand", Decimal("9.50"))
    paid = next(r for r in products.read().collect() if r.stt == at(0, 30))
    assert (paid.paid_order_ct, paid.payment_amount) == (1, Decimal("19.00"))

    keywords = house.stats("keywords", schemas.KEYWORD_STATS_COLUMNS)
    house.run(stream_jobs.keyword_statistics(wh, keywords, start="earliest"))
    assert sorted((r.keyword, r.ct, r.source, r.stt) for r in keywords.read().collect()) == [("red", 1, "SEARCH", at(0)), ("ring", 1, "SEARCH", at(0))]
    provinces = house.stats("provinces", schemas.PROVINCE_STATS_COLUMNS)
    house.run(stream_jobs.province_statistics(wh, provinces))
    assert [(r.stt, r.province_name, r.iso_3166_2, r.order_amount, r.order_count) for r in provinces.read().collect()] == [
        (at(0), "North", "X-N", Decimal("19.00"), 1),
    ]


def test_restart_repeats_nothing(house):
    """Stopped and started between any two files, and with a batch whose commit was lost."""
    house.feed(TOPICS["page"], [log("1", BASE), log("2", BASE + 1)])
    house.run(stream_jobs.unique_visitors(house.house))
    house.run(stream_jobs.unique_visitors(house.house))
    house.feed(TOPICS["page"], [log("1", BASE + 2), log("3", BASE + 3)])
    house.run(stream_jobs.unique_visitors(house.house))
    assert sorted(r["common"]["mid"] for r in house.read(TOPICS["unique_visitor"])) == ["1", "2", "3"]

    days = FlagDays(house.spark, f"{house.root}/days")
    house.feed(TOPICS["log"], [log("1", BASE, is_new="1")])
    house.run(stream_jobs.log_routing(house.house, days))
    pages = len(house.read(TOPICS["page"]))
    commits = f"{house.house.checkpoint('log_routing')}/commits"
    for name in os.listdir(commits):
        if name.strip(".").startswith("0"):
            os.remove(f"{commits}/{name}")
    house.run(stream_jobs.log_routing(house.house, days))
    assert len(house.read(TOPICS["page"])) == pages


def test_landing_feeds_the_routing(house):
    house.feed("raw", [log("1", BASE), "broken"])
    lines = house.spark.readStream.text(house.topics.path("raw"))
    house.run(stream_jobs.log_landing(house.house, lines, f"{house.root}/bronze"))
    house.feed("raw", [log("2", BASE + DAY)])
    house.run(stream_jobs.log_landing(house.house, lines, f"{house.root}/bronze"))
    landed = landed_logs(house.spark, f"{house.root}/bronze").groupBy("log_day", "good").count().collect()
    assert sorted(map(tuple, landed)) == [("20240301", True, 1), ("20240302", True, 1), ("none", False, 1)]
    house.run(stream_jobs.log_routing(house.house, FlagDays(house.spark, f"{house.root}/days")))
    assert sorted(p["common"]["mid"] for p in house.read(TOPICS["page"])) == ["1", "2"]


def test_flag_days_are_kept_and_folded(spark, tmp_path):
    days = FlagDays(spark, str(tmp_path / "days"))
    seen = {}
    rng = random.Random(3)
    for batch_id in range(5):
        rows = [(i, rng.randrange(6), batch_id + rng.randrange(2)) for i in range(8)]
        df = spark.createDataFrame([(i, d, "1", day) for i, d, day in rows], "i INT, device INT, flag STRING, day INT")
        day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("day"))
        for _ in range(2):  # each batch is tried twice
            got = {r.i: r.flag for r in days.repair(df, batch_id, "device", "flag", day, compact_every=2).collect()}
        fresh = {d: min(x for _, e, x in rows if e == d) for _, d, _ in rows}
        seen = {**fresh, **seen}
        assert got == {i: "1" if seen[d] == x else "0" for i, d, x in rows}


def shuffled_files(spark, tmp_path, late_seconds):
    """Events out of order by less than the watermark delay, in four files, and a closing row."""
    rng = random.Random(7)
    rows = [(i, rng.randrange(5), i * 3 + rng.randrange(3), rng.random() < 0.5) for i in range(300)]
    order = sorted(rows, key=lambda r: r[2] + rng.random() * late_seconds)
    folder = str(tmp_path / "events")
    schema = "id BIGINT, device INT, s BIGINT, entry BOOLEAN"
    for part in range(4):
        piece = order[part * 75:(part + 1) * 75]
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(-1, None, 10_000_000, False)], schema).coalesce(1).write.mode("append").parquet(folder)
    table = spark.createDataFrame(rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    return table, stream


def timed(df):
    return df.withColumn("t", F.timestamp_seconds("s"))


def drain(stream, folder):
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(400)
    return query


def test_bounces_do_not_depend_on_arrival_order(spark, tmp_path):
    table, stream = shuffled_files(spark, tmp_path, 20)
    drain(bounces_stream(timed(stream), "device", "t", ["id"], F.col("entry"), 10, "25 seconds"), tmp_path)
    got = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted(r.id for r in bounces(timed(table), "device", "t", ["id"], F.col("entry"), 10).collect())
    assert got == want and want


def test_rows_behind_the_watermark_are_counted_as_dropped(spark, tmp_path):
    schema = "device INT, t TIMESTAMP"
    folder = str(tmp_path / "rows")
    # A row is late against the watermark the micro-batch before it had reached.
    for second in (100, 1000, 1001, 101, 2000):
        spark.sql(f"SELECT 1 AS device, timestamp_seconds({second}) AS t").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder).withWatermark("t", "3 seconds")
    counted = stream.groupBy(F.window("t", "10 seconds"), "device").count()
    query = drain(counted, tmp_path)
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("count")).first()[0] == 3


def test_first_per_day_stream_passes_one_row_and_drops_state(spark, tmp_path):
    schema = "device INT, t TIMESTAMP"
    folder = str(tmp_path / "rows")
    for day in range(5):
        for begin in (0, 100):  # two files a day, the second one later
            spark.range(60).select(
                (F.col("id") % 3).cast("int").alias("device"),
                F.timestamp_seconds(F.lit(day * 86400 + begin) + F.col("id")).alias("t"),
            ).orderBy(F.desc("t")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    found = []

    def keep(batch, _):
        found.extend((r.device, r.s) for r in batch.select("device", F.unix_seconds("t").alias("s")).collect())

    query = (
        first_per_day_stream(stream, "device", "t", ["t"], "1 hour").writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(400)
    assert sorted(found) == sorted((d, day * 86400 + d) for d in range(3) for day in range(5))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


@pytest.mark.parametrize("spread", [1, 4])
def test_interval_join_stream_matches_the_table_form(spark, tmp_path, spread):
    table, stream = shuffled_files(spark, tmp_path, 20)

    def sides(df, delay=None):
        left = timed(df.filter("entry")).select(F.col("id").alias("l"), F.col("device").alias("ld"), F.col("t").alias("lt"))
        right = timed(df.filter("NOT entry")).select(F.col("id").alias("r"), F.col("device").alias("rd"), F.col("t").alias("rt"))
        return (left.withWatermark("lt", delay), right.withWatermark("rt", delay)) if delay else (left, right)

    drain(interval_join(*sides(stream, "25 seconds"), "ld", "rd", "lt", "rt", -5, 5, spread), tmp_path)
    got = sorted((r.l, r.r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r.l, r.r) for r in interval_join(*sides(table), "ld", "rd", "lt", "rt", -5, 5).collect())
    assert got == want and want


def test_table_and_stream_visitor_statistics_agree(house):
    """The table job takes all three measures from pages; the stream job takes them from topics."""
    rng = random.Random(11)
    logs = [log(str(rng.randrange(4)), BASE + i * 2500, rng.choice(["home", "good_list"]), rng.choice([None, "home"])) for i in range(80)]
    house.feed(TOPICS["page"], [*logs, log("last", FAR), log("later", FAR + 600_000, last="home")])
    house.run(stream_jobs.unique_visitors(house.house))
    house.run(stream_jobs.bounced_visitors(house.house))
    table = house.stats("visitors", schemas.VISITOR_STATS_COLUMNS)
    house.run(stream_jobs.visitor_statistics(house.house, table))
    from brookhouse.operators import parse_json
    pages = parse_json(house.topics.table(TOPICS["page"]), schemas.LOG_SCHEMA).rows.filter(F.col("ts") < FAR)
    want = jobs.visitor_statistics(pages)
    assert sum(r.uj_ct for r in want.collect()) > 0
    assert sorted(map(tuple, table.read().drop("ts").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
