"""Change rows, routing rules and the dimension store."""

import json

from pyspark.sql import functions as F

from brookhouse.operators import (
    current_rules, current_table, latest_by_key, normalise_changes, parse_fields, parse_json, route_changes, valid_changes,
)
from brookhouse.schemas import CHANGE_SCHEMA, ENVELOPE_SCHEMA, RULE_COLUMNS
from brookhouse.sources import DimensionStore, Topics, land_logs, landed_logs, table_columns, with_snapshot


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(row),) for row in rows], "value STRING")


def changes(spark, rows):
    return parse_json(lines(spark, rows), CHANGE_SCHEMA).rows


def rules(spark, *rows):
    schema = ", ".join(f"{name} STRING" for name in RULE_COLUMNS)
    return spark.createDataFrame([row + (None,) * (7 - len(row)) for row in rows], schema)


def test_valid_changes(spark):
    rows = changes(spark, [
        {"table": "t", "data": {}}, {"table": "t", "data": None}, {"table": "t", "data": {"id": 1}}, {"table": "", "data": {"id": 2}},
    ])
    assert [r.data for r in valid_changes(rows).collect()] == [{"id": "1"}]


def test_normalise(spark):
    raw = parse_json(lines(spark, [
        {"source": {"db": "d", "table": "t"}, "op": op, "after": after}
        for op, after in (("c", {"id": 1}), ("r", {"id": 2}), ("u", {"id": 3}), ("d", None), ("CREATE", {"id": 4}))
    ]), ENVELOPE_SCHEMA).rows
    got = [(r.type, r.data) for r in normalise_changes(raw).collect()]
    assert got == [("insert", {"id": "1"}), ("read", {"id": "2"}), ("update", {"id": "3"}), ("delete", {}), ("insert", {"id": "4"})]


def test_bootstrap_rows_are_inserts_and_columns_are_pruned(spark):
    row = changes(spark, [{"database": "d", "table": "t", "type": "bootstrap-insert", "data": {"id": 1, "name": "n", "x": 0}}])
    routed = route_changes(row, rules(spark, ("t", "insert", "kafka", "out", "id,name")))
    got = routed.facts.first()
    assert (got.type, got.sink_table, got.data) == ("insert", "out", {"id": "1", "name": "n"})
    assert routed.dims.count() == routed.unmatched.count() == 0


def test_names_are_not_trimmed(spark):
    row = changes(spark, [{"table": "t", "type": "insert", "data": {"id": 1, "name": "n"}}])
    routed = route_changes(row, rules(spark, ("t", "insert", "hbase", "out", "id, name")))
    assert routed.dims.first().data == {"id": "1"}


def test_rows_without_rule_or_sink(spark):
    rows = changes(spark, [{"table": "a", "type": "insert", "data": {"id": 1}}, {"table": "b", "type": "insert", "data": {"id": 2}}])
    routed = route_changes(rows, rules(spark, ("b", "insert", "clickhouse", "out", "id"), ("b", "update", "kafka", "out", "id")))
    assert routed.facts.count() == routed.dims.count() == 0
    assert sorted(r.table for r in routed.unmatched.collect()) == ["a", "b"]


def test_rules_follow_the_last_change(spark):
    base = rules(spark, ("t", "insert", "kafka", "old", "id")).withColumn("type", F.lit("insert")).withColumn("seq", F.lit(1))
    newer = base.withColumn("sink_table", F.lit("new")).withColumn("type", F.lit("update")).withColumn("seq", F.lit(2))
    gone = base.withColumn("type", F.lit("delete")).withColumn("seq", F.lit(3))
    assert [r.sink_table for r in current_rules(base.union(newer), ["seq"]).collect()] == ["new"]
    assert current_rules(base.union(newer).union(gone), ["seq"]).count() == 0
    assert [r.sink_table for r in current_rules(base.union(newer).union(gone), ["seq"], keep_deleted=True).collect()] == ["new"]


def test_latest_by_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 3, "x")], "k INT, s INT, v STRING")
    assert sorted(r.v for r in latest_by_key(df, ["k"], ["s"]).collect()) == ["b", "x"]
    assert [r.v for r in latest_by_key(df, ["k"], ["s"], F.col("v") == "x").collect()] == ["b"]


def test_snapshot_comes_before_changes(spark):
    snapshot = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id INT, name STRING")
    rows = spark.createDataFrame(
        [("d", "t", "update", {"id": "1", "name": "A"}, 5), ("d", "t", "delete", {"id": "2"}, 6), ("d", "other", "insert", {"id": "9"}, 7)],
        "database STRING, `table` STRING, type STRING, data MAP<STRING, STRING>, ts_ms BIGINT",
    )
    both = with_snapshot(snapshot, "d", "t", rows)
    got = current_table(both, "d", "t", {"id": "int", "name": "string"}, "id", ["ts_ms"])
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "A"), (3, None)]


def test_table_columns(spark):
    got = table_columns(rules(
        spark, ("t", "insert", "hbase", "dim", "id,name"), ("t", "update", "hbase", "dim2", "id"), ("u", "insert", "kafka", "x", "id"),
    ))
    assert [(r.sink_table, r.position, r.column, r.is_key, r.extension) for r in got.collect()] == [
        ("dim", 0, "id", True, ""), ("dim", 1, "name", False, ""),
    ]


def dim_rows(spark, *rows):
    return spark.createDataFrame(
        [(kind, data, "dim_t", "id", seq) for kind, data, seq in rows],
        "type STRING, data MAP<STRING, STRING>, sink_table STRING, sink_pk STRING, seq BIGINT",
    )


def test_dimension_store(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path / "dims"))
    assert store.table("dim_t", ["id", "name"]).columns == ["ID", "NAME"] and store.table("dim_t", ["id"]).count() == 0

    def names():
        return sorted((r.ID, r.NAME) for r in store.table("dim_t", ["id", "name"]).collect())

    first = dim_rows(spark, ("insert", {"id": "1", "name": "a"}, 1), ("insert", {"id": "1", "name": "b"}, 2), ("insert", {"id": "2", "name": "c"}, 3))
    store.apply(first, 0, sequence="seq")
    assert names() == [("1", "b"), ("2", "c")]
    store.apply(first, 0, sequence="seq")  # the batch again
    assert names() == [("1", "b"), ("2", "c")]
    store.compact(0)
    store.apply(dim_rows(spark, ("update", {"id": "2", "name": "C"}, 1), ("delete", {"id": "1"}, 2)), 1, sequence="seq")
    assert names() == [("2", "C")]
    store.compact(1)
    store.apply(dim_rows(spark, ("insert", {"id": "1", "name": "z"}, 1)), 2, sequence="seq")
    assert names() == [("1", "z"), ("2", "C")]
    assert store.table("other", ["id"]).count() == 0


def test_deletes_can_be_written_as_rows(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path / "dims"))
    store.apply(dim_rows(spark, ("insert", {"id": "1"}, 1), ("delete", {"id": "1"}, 2)), 0, apply_deletes=False, sequence="seq")
    assert store.table("dim_t", ["id"]).count() == 1


def test_fields_written_as_text(spark):
    df = spark.createDataFrame([('{"id": "5", "price": "1.50", "name": 7}',), ('{"id": 6, "price": "x"}',), ("nothing",)], "value STRING")
    parsed = parse_fields(df, "id BIGINT, price DECIMAL(16,2), name STRING")
    assert [(r.id, str(r.price), r["name"]) for r in parsed.rows.collect()] == [(5, "1.50", "7")]
    # A number that cannot be read rejects its row; it used to become a null, which counted as an amount of 0.
    assert sorted(tuple(r) for r in parsed.rejects.collect()) == [("nothing", "json"), ('{"id": 6, "price": "x"}', "number")]


def test_landing(spark, tmp_path):
    df = spark.createDataFrame([('{"ts": 0}',), ('{"ts": 86400000}',), ("broken",), (" ",), ('{"x": 1}',)], "value STRING")
    topics = Topics(spark, root=str(tmp_path / "topics"))
    for _ in range(2):  # the second time repeats the batch
        land_logs(df, str(tmp_path / "bronze"), 0, topics)
    got = sorted((r.log_day, r.good, r.value) for r in landed_logs(spark, str(tmp_path / "bronze")).collect())
    assert got == [
        ("19700101", True, '{"ts": 0}'), ("19700102", True, '{"ts": 86400000}'), ("none", False, " "), ("none", False, "broken"), ("none", True, '{"x": 1}'),
    ]
    assert topics.table("ods_base_log").count() == 3


def test_kafka_options(spark):
    topics = Topics(spark, servers="a:9092,b:9092", options={"kafka.security.protocol": "SSL"})
    assert topics.source_options("t", "latest") == {
        "kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "t", "startingOffsets": "latest", "kafka.security.protocol": "SSL",
    }
    assert topics.sink_options("t")["topic"] == "t" and "topic" not in topics.sink_options()
