"""Visitor operators on hand-made rows, and against brute force on random ones."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from brookhouse.operators import bounces, first_per_day, is_entry, parse_json, repair_new_flag, split_logs, to_json_value
from brookhouse.plans import jobs
from brookhouse.schemas import LOG_SCHEMA

DAY = 86_400_000


def pages(spark, rows):
    lines = [(json.dumps(row),) for row in rows]
    return parse_json(spark.createDataFrame(lines, "value STRING"), LOG_SCHEMA).rows


def page(mid, ts, page_id="home", last=None, is_new="0", **more):
    return {"common": {"mid": mid, "is_new": is_new, "vc": "v1", "ch": "c1", "ar": "a1"},
            "page": {"page_id": page_id, "last_page_id": last, **more}, "ts": ts}


def test_bounce_example(spark):
    rows = pages(spark, [
        page("101", 10000), page("102", 12000), page("102", 15000, "good_list", "home"),
        page("102", 30000, "good_list", "detail"),
    ])
    assert [(r.common.mid, r.ts) for r in jobs.bounced_visitors(rows).collect()] == [("101", 10000)]


@pytest.mark.parametrize("gap, found", [(9_999, 1), (10_000, 2), (20_000, 2), (19_999, 2)])
def test_bounce_boundary(spark, gap, found):
    """At exactly ten seconds the first page has timed out; both pages are entries here."""
    rows = pages(spark, [page("1", 7_000), page("1", 7_000 + gap)])
    assert jobs.bounced_visitors(rows).count() == found


def test_bounce_same_time_and_empty_next_page(spark):
    same = pages(spark, [page("1", 5_000), page("1", 5_000, "good_list", "home")])
    # Equal times are ordered by content, so the entry either has a successor or is the successor.
    assert jobs.bounced_visitors(same).count() in (0, 1)
    empty = pages(spark, [page("1", 5_000), page("1", 6_000, "", "home")])
    assert jobs.bounced_visitors(empty).count() == 0


def test_flag_repair(spark):
    rows = pages(spark, [
        page("1", 0, is_new="1"), page("1", 10, is_new="1"), page("1", DAY, is_new="1"), page("1", 2 * DAY, is_new="0"),
    ])
    fixed = sorted((r.ts, r.common.is_new) for r in jobs.repair_logs(rows).collect())
    assert fixed == [(0, "1"), (10, "1"), (DAY, "0"), (2 * DAY, "0")]


def test_flag_repair_ignores_unflagged_days_and_missing_devices(spark):
    rows = pages(spark, [page("1", 0, is_new="0"), page("1", DAY, is_new="1"), page(None, 0, is_new="1"), page(None, DAY, is_new="1")])
    fixed = sorted((r.common.mid or "", r.ts, r.common.is_new) for r in jobs.repair_logs(rows).collect())
    assert fixed == [("", 0, "1"), ("", DAY, "1"), ("1", 0, "0"), ("1", DAY, "1")]


def test_unique_visitors(spark):
    rows = pages(spark, [page("1", 1), page("1", 2), page("1", DAY, last="home"), page("1", DAY + 5)])
    assert sorted(r.ts for r in jobs.unique_visitors(rows).collect()) == [1, DAY + 5]


def test_empty_last_page_counts_as_entry(spark):
    df = spark.createDataFrame([(None,), ("",), ("home",)], "last_page_id STRING")
    assert df.filter(is_entry()).count() == 2


def test_log_split(spark):
    start = {"common": {"mid": "1"}, "start": {"entry": "icon"}, "displays": [{"item": "9"}], "ts": 1}
    shown = page("2", 5, "home") | {"displays": [{"item": "1", "page_id": "own"}, {"item": "2"}]}
    empty = page("3", 6) | {"displays": [], "start": {}}
    logs = split_logs(pages(spark, [start, shown, empty]))
    assert [json.loads(r.value) for r in logs.start.select(F.to_json("start").alias("value")).collect()] == [{"entry": "icon"}]
    assert sorted(r.common.mid for r in logs.page.collect()) == ["2", "3"]
    found = sorted((r.display for r in logs.display.collect()), key=lambda d: d["item"])
    assert found == [{"item": "1", "page_id": "home", "ts": "5"}, {"item": "2", "page_id": "home", "ts": "5"}]


def test_broken_lines_are_rejected(spark):
    lines = spark.createDataFrame([("{",), (None,), ("",), ("  ",), ("[1]",), ('{"ts": 1}',), ("{}",)], "value STRING")
    parsed = parse_json(lines, "ts BIGINT")
    assert parsed.rows.count() + parsed.rejects.count() == 7
    assert sorted(str(r.ts) for r in parsed.rows.collect() if r.ts is not None) == ["1"]
    rejected = {r.value for r in parsed.rejects.collect()}
    assert {"{", None, "", "  "} <= rejected


def test_json_value_leaves_out_nulls(spark):
    row = spark.createDataFrame([(1, None)], "a INT, b STRING")
    assert to_json_value(row).first().value == '{"a":1}'


EVENTS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.booleans()), max_size=25)
QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, events):
    rows = [(i, device, second, entry) for i, (device, second, entry) in enumerate(events)]
    df = spark.createDataFrame(rows, "id BIGINT, device INT, s BIGINT, entry BOOLEAN")
    return df.withColumn("t", F.timestamp_seconds("s"))


@QUICK
@given(events=EVENTS, timeout=st.integers(1, 20))
def test_bounces_against_brute_force(spark, events, timeout):
    rows = [(i, *event) for i, event in enumerate(events)]
    expected = []
    for i, device, second, entry in rows:
        later = sorted((s, j) for j, d, s, _ in rows if d == device and (s, j) > (second, i))
        if entry and (not later or later[0][0] - second >= timeout):
            expected.append(i)
    got = bounces(frame(spark, events), "device", "t", ["id"], F.col("entry"), timeout)
    assert sorted(r.id for r in got.collect()) == expected


@QUICK
@given(events=EVENTS)
def test_flag_repair_against_brute_force(spark, events):
    """Ten seconds stand for a day."""
    rows = [(i, device, second // 10, "1" if entry else "0") for i, (device, second, entry) in enumerate(events)]
    first = {}
    for _, device, day, flag in rows:
        if flag == "1":
            first[device] = min(day, first.get(device, day))
    expected = [(i, "0" if flag == "1" and day != first[device] else flag) for i, device, day, flag in rows]
    df = spark.createDataFrame(rows, "id BIGINT, device INT, day INT, flag STRING")
    got = repair_new_flag(df, "device", "flag", F.col("day"))
    assert sorted((r.id, r.flag) for r in got.collect()) == expected


@QUICK
@given(events=EVENTS)
def test_first_per_day_against_brute_force(spark, events):
    best = {}
    for i, (device, second, entry) in enumerate(events):
        if entry:
            key = (device, second // 10)
            best[key] = min((second, i), best.get(key, (second, i)))
    got = first_per_day(frame(spark, events), "device", F.floor(F.col("s") / 10), ["t", "id"], F.col("entry"))
    assert sorted(r.id for r in got.collect()) == sorted(i for _, i in best.values())
