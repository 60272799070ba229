"""The dimension store over many batches, folds and retries; rules that come after their rows."""

import pytest
from pyspark.sql import Row

from brookhouse.operators import by_id
from brookhouse.schemas import RULE_COLUMNS
from brookhouse.sources import DimensionStore, RuleLog, StoredDimension, WaitingRows, folders

DIM = "type string, data map<string,string>, sink_table string, sink_pk string, seq bigint"


def batch(spark, *rows, table="dim_a"):
    return spark.createDataFrame([(kind, {"id": key, "v": value}, table, "id", n) for n, (kind, key, value) in enumerate(rows)], DIM).coalesce(1)


def read(store, name="dim_a"):
    return {r.ID: r.V for r in store.table(name, ["id", "v"]).collect()}


def test_reads_cost_the_same_after_many_batches(spark, tmp_path, monkeypatch):
    store = DimensionStore(spark, str(tmp_path / "dims"))
    assert read(store) == {}
    calls = []
    for name in ("numbers", "read_text", "exists", "committed"):
        found = getattr(folders, name)
        monkeypatch.setattr(folders, name, lambda *a, _f=found: (calls.append(a), _f(*a))[1])
    costs = []
    for n in range(12):
        store.apply(batch(spark, ("insert", f"k{n}", f"v{n}"), ("update", "same", f"s{n}")), n, sequence="seq")
        calls.clear()
        store._live_folders()
        costs.append(len(calls))
    assert len(set(costs)) == 1 and costs[0] <= 3
    assert read(store) == {**{f"k{n}": f"v{n}" for n in range(12)}, "same": "s11"}


def test_folds_retries_and_vacuum(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path / "dims"))
    want = {}
    for n in range(9):
        rows = [("insert", f"k{n}", "x"), ("update", "same", f"s{n}")] + ([("delete", f"k{n - 1}", None)] if n % 2 else [])
        for _ in range(2):
            store.apply(batch(spark, *rows), n, sequence="seq")
        want |= {f"k{n}": "x", "same": f"s{n}"}
        if n % 2:
            want.pop(f"k{n - 1}")
        if n % 3 == 2:
            store.compact(n)
            store.compact(n)
            store.vacuum()
        assert read(store) == want
    # What two folds have replaced is gone; a fold runs beside batches that came after its last one.
    assert folders.numbers(spark, f"{store.root}/base", "upto") == [5, 8]
    assert folders.numbers(spark, f"{store.root}/delta", "batch") == [6, 7, 8]
    store.apply(batch(spark, ("update", "same", "new")), 9, sequence="seq")
    store.apply(batch(spark, ("insert", "b", "1"), table="dim_b"), 10, sequence="seq")
    store.compact(9)
    assert read(store) == want | {"same": "new"} and read(store, "dim_b") == {"b": "1"}


def test_an_unfinished_batch_is_not_read(spark, tmp_path, monkeypatch):
    store = DimensionStore(spark, str(tmp_path / "dims"))
    store.apply(batch(spark, ("insert", "a", "1")), 0, sequence="seq")
    write = folders.write_text
    monkeypatch.setattr(folders, "write_text", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        store.apply(batch(spark, ("update", "a", "2")), 1, sequence="seq")
    assert read(store) == {"a": "1"}
    monkeypatch.setattr(folders, "write_text", write)
    store.apply(batch(spark, ("update", "a", "3")), 1, sequence="seq")
    assert read(store) == {"a": "3"}


def test_tables_follow_the_rules(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path / "dims"))
    rule = lambda table, columns, pk=None, extend=None: ("t", "insert", "hbase", table, columns, pk, extend)
    frame = lambda *rules: spark.createDataFrame(list(rules), ", ".join(f"{c} string" for c in RULE_COLUMNS))
    store.apply(batch(spark, ("insert", "1", "5"), ("insert", "2", "many")), 0, sequence="seq")
    found = store.tables(frame(rule("dim_a", "id,v", None, "v INT"), rule("dim_new", "code,name", "code")))
    assert sorted(map(tuple, found["dim_a"].collect())) == [("1", 5), ("2", None)]
    assert found["dim_new"].columns == ["code", "name"] and found["dim_new"].count() == 0


CHANGES = "database string, table string, type string, data map<string,string>"


def test_rows_wait_for_their_rule(spark, tmp_path):
    log = RuleLog(spark, str(tmp_path / "log"))
    waiting = WaitingRows(log, str(tmp_path / "waiting"))
    assert waiting.waiting() is None and log.rules().count() == 0

    def add(n, *rules):
        rows = [(t, "insert", "kafka", f"dwd_{t}", "id", None, None, kind, n) for t, kind in rules]
        for _ in range(2):
            log.append(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RULE_COLUMNS) + ", type string, seq bigint"), n)

    def route(n, *tables):
        rows = spark.createDataFrame([("shop", t, "insert", {"id": str(i)}) for t, i in tables], CHANGES)
        # A repeated batch gives the same rows, also if a version came in between.
        return [sorted((r.sink_table, r.data["id"]) for r in waiting.route(rows, n).facts.collect()) for _ in range(2)]

    left = lambda: sorted((r.table, r.data["id"]) for r in waiting.waiting().collect())
    assert route(0, ("a", 1), ("b", 2)) == [[], []]
    add(0, ("a", "insert"))
    assert route(0, ("a", 1), ("b", 2)) == [[], []]
    assert left() == [("a", "1"), ("b", "2")]
    assert route(1, ("a", 3), ("c", 4)) == [[("dwd_a", "1"), ("dwd_a", "3")]] * 2
    assert left() == [("b", "2"), ("c", "4")]
    assert route(2, ("b", 5)) == [[], []]
    add(1, ("b", "insert"), ("a", "delete"))
    assert route(3) == [[("dwd_b", "2"), ("dwd_b", "5")]] * 2
    assert route(4, ("a", 6), ("b", 7)) == [[("dwd_b", "7")]] * 2
    assert left() == [("a", "6"), ("c", "4")]


def test_a_lookup_by_key_reads_its_buckets_only(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path / "dims"), buckets=8)
    keys = [str(n) for n in range(200)] + ["007x", "0300", " 301"]
    store.apply(batch(spark, *[("insert", k, f"v{k}") for k in keys]), 0, sequence="seq")
    near = lambda *asked: store.near("dim_a", ["id", "v"], spark.createDataFrame([(k,) for k in asked], "k bigint"))
    assert near(3).count() == len(keys)  # not folded yet
    store.compact(0)
    store.apply(batch(spark, ("update", "3", "new"), ("delete", "5", None), ("insert", "999", "late")), 1, sequence="seq")
    everything = read(store)
    for asked in ((3, 5, 7), (300, 301), (999,), (12345,), (None,), ()):
        rows = near(*asked)
        got = {r.ID: r.V for r in rows.collect()}
        assert len(got) < len(everything) and got.items() <= everything.items()
        number = lambda k: int(k) if k.strip().isdigit() else None
        assert {k for k in everything if number(k) in asked and number(k) is not None} <= set(got)
    plan = near(3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and any("bucket" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])

    facts = spark.createDataFrame([(3,), (5,), (300,), (None,)], "k bigint")
    found = by_id(facts, StoredDimension(store, "dim_a", ["id", "v"]), "k", {"v": "V"}, few=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, [Row(k=3, v="new"), Row(k=5, v=None), Row(k=300, v="v0300"), Row(k=None, v=None)]))
    # The few keys are broadcast to the rows of the dimension, which meet them before any shuffle.
    batch_rows = facts.persist()
    found = by_id(batch_rows, StoredDimension(store, "dim_a", ["id", "v"]), "k", {"v": "V"}, few=True)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin [_key0" in final
    batch_rows.unpersist()
    # A base has its own number of buckets, whatever the store is set to now.
    other = DimensionStore(spark, store.root, buckets=3)
    other.compact(1)
    assert {r.ID: r.V for r in store.near("dim_a", ["id", "v"], facts).collect()}["3"] == "new" and read(store) == everything
