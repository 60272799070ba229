"""Commits that readers respect, keyed state over many batches, late rows, rejects of facts."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brookhouse.operators import parse_fields, repair_new_flag
from brookhouse.plans import stream_jobs
from brookhouse.schemas import REFUND_SCHEMA, TOPICS
from brookhouse.sources import Topics, folders
from brookhouse.streaming import mirror
from brookhouse.streaming import LateRows, StatsTable, repair_new_flag_stream
from test_streams import BASE, DAY, House, log


@pytest.fixture
def house(spark, tmp_path):
    return House(spark, tmp_path)


@pytest.fixture
def two_partitions(spark):
    """A state partition costs a Python worker per micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def read_stream(spark, frame, folder):
    """All rows that a stream reader of a topic has seen so far."""
    writer = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("value STRING").parquet(f"{folder}/out")
    return Counter(r.value for r in found.collect())


@pytest.mark.parametrize("routed", [False, True])
def test_a_crash_inside_a_batch_shows_nothing_and_doubles_nothing(spark, tmp_path, monkeypatch, routed):
    topics = Topics(spark, root=str(tmp_path / "topics"))
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("r"), "id").alias("value"), F.concat(F.lit("t"), F.col("id") % 2).alias("sink_table"))
    write = (lambda df, n: topics.write_routed(df, n)) if routed else (lambda df, n: topics.write_batch(df, "t0", n))
    reader = (lambda: topics.routed_stream("t0")) if routed else (lambda: topics.stream("t0"))
    write(rows.filter("value = 'r0'"), 0)
    assert read_stream(spark, reader(), tmp_path) == {"r0": 1}

    # A task that dies after others have written their files.
    broken = rows.filter("value <> 'r0'").withColumn("value", F.when(F.col("value") == "r7", F.raise_error(F.lit("died"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="died"):
        write(broken, 1)
    assert read_stream(spark, reader(), tmp_path) == {"r0": 1}
    # All files written, and the driver dies before the batch is in its place.
    publish = folders.publish
    monkeypatch.setattr(folders, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        write(rows.filter("value <> 'r0'"), 1)
    monkeypatch.setattr(folders, "publish", publish)
    assert read_stream(spark, reader(), tmp_path) == {"r0": 1}
    # The batch is repeated, and once more after it has succeeded.
    write(rows.filter("value <> 'r0'"), 1)
    write(rows, 1)
    wanted = {f"r{i}": 1 for i in range(0, 40, 2 if routed else 1)}
    assert read_stream(spark, reader(), tmp_path) == wanted


def test_routing_by_state_goes_on_after_a_restart(house):
    """Five starts of the job: known devices keep their first day, broken lines are set aside, rows come out whole."""
    sent = []
    for day in range(5):
        rows = [log(f"d{i}", BASE + day * DAY + i, is_new="1", extra=i) for i in range(day, 12, 2)]
        rows += [log(None, BASE + day * DAY, is_new="1"), log("off", BASE, is_new="0")]
        sent += rows
        house.feed(TOPICS["log"], [*rows, "{broken", {"common": {"mid": "x", "is_new": "1"}, "ts": 9 * 10**18}])
        house.run(stream_jobs.log_routing_by_state(house.house))
    pages = house.read(TOPICS["page"])
    first = {}
    for row in sent:
        if row["common"]["mid"] and row["common"]["is_new"] == "1":
            first.setdefault(row["common"]["mid"], (row["ts"] - BASE) // DAY)
    for row in sent:
        mid = row["common"]["mid"]
        if mid in first and (row["ts"] - BASE) // DAY != first[mid]:
            row["common"]["is_new"] = "0"
    key = lambda row: json.dumps({k: v for k, v in row.items() if v is not None}, sort_keys=True)
    drop = lambda row: {**row, "common": {k: v for k, v in row["common"].items() if v is not None}, "page": {k: v for k, v in row["page"].items() if v is not None}}
    assert Counter(key(drop(r)) for r in pages) == Counter(key(drop(r)) for r in sent)
    rejects = Counter(r.value[:7] for r in house.topics.table(TOPICS["log"] + "_rejects").collect())
    assert rejects["{broken"] == 5 and sum(rejects.values()) == 10


def test_state_holds_one_row_per_device(house):
    """The state grows with the devices, not with the rows, and a later batch reads no table of known devices."""
    for day in range(3):
        house.feed(TOPICS["log"], [log(f"d{i % 7}", BASE + day * DAY + i, is_new="1") for i in range(200)])
        house.run(stream_jobs.log_routing_by_state(house.house))
    state = house.spark.read.format("statestore").option("stateVarName", "first_day").load(house.house.checkpoint("log_routing"))
    assert state.count() == 7


def test_flag_repair_of_odd_rows(spark, tmp_path):
    """Columns with odd names and types, null devices, flags and days; one batch agrees with the table form."""
    rows = [("a", "1", 1, [1], None), ("a", "1", 2, None, 1.5), ("a", None, 2, [], 2.5), (None, "1", 3, [3], None), ("b", "0", 1, [4], 0.0), ("b", "1", 5, [5], 1.0), ("c", "1", None, [6], None)]
    frame = spark.createDataFrame(rows, "_mid string, `a flag` string, d int, _list array<int>, first_day_of double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = repair_new_flag_stream(stream, "_mid", "a flag", day)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(*frame.columns)
    want = repair_new_flag(frame, "_mid", "a flag", day)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_late_rows_are_split_alike_on_retry(spark, tmp_path):
    late = LateRows(spark, str(tmp_path / "marks"), "at", 10)
    frame = lambda *seconds: spark.createDataFrame([(s,) for s in seconds], "s int").withColumn("at", F.timestamp_seconds("s"))
    pick = lambda both: tuple(sorted(r.s for r in part.collect()) for part in both)
    assert pick(late.split(frame(100, 5), 0)) == ([5, 100], [])
    second = frame(89, 90, 95, 300, 2)
    assert pick(late.split(second, 1)) == ([90, 95, 300], [2, 89])
    assert pick(late.split(second, 1)) == ([90, 95, 300], [2, 89])
    assert pick(late.split(frame(200, 290), 2)) == ([290], [200])
    # A batch without rows keeps the mark; one without times is in time.
    assert pick(late.split(frame(), 3)) == ([], [])
    assert pick(late.split(spark.createDataFrame([(None, None)], "s int, at timestamp"), 4))[1] == []
    assert pick(late.split(frame(289), 5)) == ([], [289])


def test_numbers_of_facts_that_cannot_be_read_are_rejected(spark):
    lines = [
        '{"sku_id":"1","order_id":2,"refund_amount":"12.50","create_time":"2024-01-01 00:00:00"}',
        '{"sku_id":"x1","refund_amount":"12.5","create_time":"2024-01-01 00:00:00"}',
        '{"sku_id":"1","refund_amount":"12,5","create_time":"2024-01-01 00:00:00"}',
        '{"sku_id":null,"create_time":"2024-01-01 00:00:00"}', '{"sku_id":"1","create_time":"soon"}', "[]", None,
    ]
    found = parse_fields(spark.createDataFrame([(x,) for x in lines], "value string"), REFUND_SCHEMA, times=("create_time",))
    assert sorted((r.sku_id or 0, r.order_id or 0, str(r.refund_amount)) for r in found.rows.collect()) == [(0, 0, "None"), (1, 2, "12.50")]
    assert Counter(r.reason for r in found.rejects.collect()) == {"number": 2, "time": 1, "json": 2}


def test_a_mirrored_table_takes_back_what_it_replaces(house, two_partitions):
    """Changes out of order, twice, and older than a delete, over restarts: rows and totals are those of the table."""
    def envelope(op, ts, key, value):
        row = None if key is None else {"id": key, "value": value}
        return {"source": {"db": "d", "table": "t"}, "op": op, "ts_ms": ts, "before": row if op == "d" else None, "after": None if op == "d" else row}

    batches = [
        [envelope("c", 1, "a", "1.50"), envelope("u", 3, "a", "3"), envelope("c", 1, "b", None), envelope("c", 2, None, None)],
        [envelope("u", 2, "a", "2"), envelope("d", 5, "b", None), envelope("r", 1, "c", "x"), {**envelope("c", 1, "z", "9"), "source": {"db": "d", "table": "other"}}],
        [envelope("u", 4, "b", "4"), envelope("u", 3, "a", "3"), envelope("u", 9, "c", "7"), envelope("d", None, "a", None)],
        [envelope("c", 6, "b", "6"), envelope("u", 6, "b", "5"), envelope("u", 9, "c", "8"), envelope("d", 9, "c", None)],
    ]
    columns = {"id": "string", "value": "decimal(16,2)"}
    totals = StatsTable(house.spark, f"{house.house.checkpoints}/out", ("all", "ct", "value"))
    want = [{"a": "3.00", "b": None}, {"a": "3.00", "c": None}, {"a": "3.00", "c": "7.00"}, {"a": "3.00", "b": "6.00"}]
    for number, lines in enumerate(batches):
        house.feed("envelopes", lines)
        house.run(stream_jobs.mirrored_table(house.house, "envelopes", "mirror", "d", "t", columns, "id"))
        found = house.topics.table("mirror").select(F.from_json("value", "id STRING, value DECIMAL(16,2), weight BIGINT").alias("v")).select("v.*")
        rows = {(r.id, None if r.value is None else str(r.value)): r.n for r in found.groupBy("id", "value").agg(F.sum("weight").alias("n")).collect() if r.n}
        assert rows == {row: 1 for row in want[number].items()}
        house.run(stream_jobs.mirrored_totals(house.house, "mirror", "id STRING, value DECIMAL(16,2), weight BIGINT", {"all": "1"}, {"value": "value"}, totals))
        got = totals.latest(["all"]).first()
        values = [float(v) for v in want[number].values() if v is not None]
        assert (got.ct, float(got.value)) == (len(want[number]), sum(values))
    # Five rows came and three of them went.
    assert found.count() == 8


def test_a_mirror_takes_the_keys_of_a_bucket_together_and_keeps_each_apart(house, two_partitions):
    """Python is called per bucket, not per key; the state is one row per key, live or deleted."""
    def envelope(op, ts, key):
        row = {"id": key, "value": str(ts)}
        return {"source": {"db": "d", "table": "t"}, "op": op, "ts_ms": ts, "before": row if op == "d" else None, "after": None if op == "d" else row}

    keys = [f"k{i}" for i in range(1500)]
    for lines in ([envelope("c", 1, k) for k in keys], [envelope("d" if i % 3 == 0 else "u", 2, k) for i, k in enumerate(keys)]):
        house.feed("envelopes", lines)
        house.run(stream_jobs.mirrored_table(house.house, "envelopes", "mirror", "d", "t", {"id": "string", "value": "int"}, "id"))
    found = house.topics.table("mirror").select(F.from_json("value", "id STRING, value INT, weight BIGINT").alias("v")).select("v.*")
    rows = {(r.id, r.value) for r in found.groupBy("id", "value").agg(F.sum("weight").alias("n")).filter("n <> 0").collect()}
    assert rows == {(k, 2) for i, k in enumerate(keys) if i % 3}
    of = lambda name: house.spark.read.format("statestore").option("stateVarName", name).load(house.house.checkpoint("mirror_mirror"))
    assert (of("live").count(), of("dead").count()) == (1000, 500)
    assert of("live").select("key").distinct().count() <= mirror.BUCKETS < 1500
