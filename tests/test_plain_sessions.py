"""Streams in sessions and on workers that know nothing of this package."""

import datetime as dt
import os
import subprocess
import sys
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from brookhouse.streaming import bounces_by_timer
from brookhouse.streaming.mirror import _versions
from brookhouse.plans import catalog, topic_queries
from brookhouse.session import KEYED, VERSIONS, stream_settings
from brookhouse.streaming import replay as replays
from brookhouse.streaming.replay import Played, replay
from brookhouse.streaming.stateful import _first_day, _quiet

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LOAD = """
import sys
from pyspark import cloudpickle
cloudpickle.loads(sys.stdin.buffer.read())
assert not [m for m in sys.modules if m.startswith("brookhouse")]
"""


@pytest.mark.parametrize("processor", [
    _first_day("c0", None), _versions(None), _quiet(StructType().add("at", LongType()).add("entry", BooleanType()), 0, [], 1000),
], ids=lambda p: type(p).__name__)
def test_a_processor_loads_where_the_package_is_missing(processor, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", LOAD], input=cloudpickle.dumps(processor), cwd=tmp_path, env=env, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()[-500:]


def test_keyed_state_runs_in_a_session_with_the_default_state_store(spark, tmp_path):
    start = dt.datetime(2024, 3, 1)
    rows = [(1, "in", 0), (1, "on", 5), (2, "in", 0), (1, "in", 100)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame([(d, kind, start + dt.timedelta(seconds=s)) for d, kind, s in rows], "device INT, kind STRING, ts TIMESTAMP").write.parquet(path)
    ours, partitions = spark.conf.get(PROVIDER), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = replay(spark, Played(path, "ts", {"kind": "close"}), lambda events: bounces_by_timer(
            events, "device", "ts", [], F.col("kind") == "in", 10, "1 second"), keyed=True)
        assert sorted((r.device, (r.ts - start).seconds) for r in found.collect()) == [(1, 100), (2, 0)]
        assert "HDFSBacked" in spark.conf.get(PROVIDER)
    finally:
        spark.conf.set(PROVIDER, ours)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_a_join_in_step_keeps_the_rows_of_its_interval_only(spark, tmp_path, monkeypatch):
    days = spark.range(2000).selectExpr("id", "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(int(id)) AS at")
    days.selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "1.0D AS o_totalprice", "at AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    days.selectExpr("id AS l_orderkey", "id AS l_partkey", "1 AS l_linenumber", "2.0D AS l_extendedprice", "at AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = f"{tmp_path}/run"
    monkeypatch.setattr(replays, "working_dir", lambda *_: folder)
    found = catalog.QUERIES["stream_interval_join"](spark, str(tmp_path))
    assert found.count() == 2000
    states = [spark.read.format("statestore").option("joinSide", side).load(f"{folder}/checkpoint").count() for side in ("left", "right")]
    # Two copies of 2000 orders, and 2000 lines, would be there if none went; the last slice and 120 days before it may be.
    assert 0 < states[0] < 2 * 800 and 0 < states[1] < 800


def test_timers_settle_the_devices_of_a_bucket_together_and_keep_each_apart():
    """Rows of several devices wait in one list; what one device does ends no visit of another."""

    class Handle:
        """A list and the timers of one bucket."""

        def __init__(self):
            self.entries, self.timers = [], []

        def getListState(self, *_):  # noqa: N802
            return self

        def appendValue(self, entry):  # noqa: N802
            self.entries.append(entry)

        def get(self):
            return iter(list(self.entries))

        def put(self, entries):
            self.entries = list(entries)

        def clear(self):
            self.entries = []

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 30_000

    schema = StructType().add("device", LongType()).add("us", LongType()).add("entry", BooleanType())
    processor, handle = _quiet(schema, 1, [], 10_000), Handle()
    processor.init(handle)
    rows = [(1, 1, True), (2, 3, True), (1, 5, True), (None, 4, True), (3, 25, True), (2, 30, False)]
    for part in (rows[:4], rows[4:]):
        frame = pd.DataFrame([(None, d, s * 1_000_000, entry) for d, s, entry in part], columns=["t", "device", "us", "entry"])
        assert [len(out) for out in processor.handleInputRows((7,), iter([frame]), None)] == [0]
    assert handle.timers == [11_001, 35_001]
    found = [r for out in processor.handleExpiredTimer((7,), handle, None) for r in out.itertuples(index=False, name=None)]
    # Settled are rows up to second 20: device 1 came again after 4 seconds and left after 5, device 2 came back 27 seconds later.
    assert sorted((d if d == d else None, us // 1_000_000) for d, us in found if d == d) == [(1, 5), (2, 3)]
    assert sum(d != d or d is None for d, _ in found) == 1
    assert handle.timers[-1] == 35_001 and len(handle.entries) == 1


def test_a_stream_keeps_one_version_in_memory_and_the_session_as_it_was(spark):
    names = [VERSIONS, PROVIDER, *KEYED]
    spark.conf.unset(VERSIONS)
    before = [spark.conf.get(n, None) for n in names]
    with stream_settings(spark):
        assert spark.conf.get(VERSIONS) == "1"
    with stream_settings(spark, keyed=True):
        assert "RocksDB" in spark.conf.get(PROVIDER) and {n: spark.conf.get(n) for n in KEYED} == KEYED
    assert [spark.conf.get(n, None) for n in names] == before


def test_product_statistics_keep_their_state_off_the_heap(spark, tmp_path, monkeypatch):
    """Whatever the session's state store, a row per order, product and window goes to RocksDB."""
    class Seen(Exception):
        pass

    def play(spark, job, steps, keyed=False):
        with stream_settings(spark, keyed):
            raise Seen(spark.conf.get(PROVIDER))

    monkeypatch.setattr(topic_queries, "play", play)
    monkeypatch.setattr(topic_queries, "_feed", lambda *_, **__: [])
    row = spark.sql("SELECT 1L AS sku_id, 1L AS order_id, 1.0 AS split_total_amount, '' AS callback_time, TIMESTAMP '2024-01-01 00:00:00' AS rowtime")
    names = ("pages", "order_wide", "payment_wide", "favors", "carts", "refunds", "comments")
    monkeypatch.setattr(topic_queries, "_product_facts", lambda _: SimpleNamespace(**dict.fromkeys(names, row)))
    ours = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(Seen, match="RocksDB"):
            catalog.QUERIES["stream_product_stats"](spark, str(tmp_path))
    finally:
        spark.conf.set(PROVIDER, ours)
