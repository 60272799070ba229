"""Interval joins, lookups, wide rows and statistics on hand-made rows."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from brookhouse import schemas
from brookhouse.codes import CODES, code_table
from brookhouse.operators import (
    Dimensions, interval_join, lookup, measures as m, merge_wide, order_with_detail, payment_wide, product_stats,
    union_measures, with_rowtime,
)
from brookhouse.plans import jobs

TIME = "2024-03-01 10:00:{:02d}"


def typed(spark, schema, rows):
    """Rows given as dicts; fields left out are null."""
    names = [part.strip().split(" ")[0] for part in schema.replace("DECIMAL(16,2)", "D").split(",")]
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schema)


def orders(spark, *rows):
    return typed(spark, schemas.ORDER_INFO_SCHEMA, [{"total_amount": Decimal("50.00"), "user_id": 7, "province_id": 1, **r} for r in rows])


def details(spark, *rows):
    base = {"sku_id": 3, "sku_num": 2, "order_price": Decimal("9.50"), "split_total_amount": Decimal("19.00")}
    return typed(spark, schemas.ORDER_DETAIL_SCHEMA, [{**base, **r} for r in rows])


def dims(spark):
    def of(schema, *rows):
        return spark.createDataFrame(rows, schema)

    return Dimensions(
        user=of("ID STRING, GENDER STRING, BIRTHDAY STRING", ("7", "F", "2000-03-01")),
        province=of("ID STRING, NAME STRING, AREA_CODE STRING, ISO_CODE STRING, ISO_3166_2 STRING", ("1", "North", "10", "N", "X-N")),
        sku=of("ID STRING, SKU_NAME STRING, SPU_ID STRING, CATEGORY3_ID STRING, TM_ID STRING, PRICE STRING", ("3", "phone", "5", "6", None, "9.50")),
        spu=of("ID STRING, SPU_NAME STRING", ("5", "phones")),
        category3=of("ID STRING, NAME STRING", ("6", "mobile")),
        trademark=of("ID STRING, TM_NAME STRING", ("8", "brand")),
    )


def test_order_detail_bounds(spark):
    """Both ends of the five seconds belong to the interval, a millisecond more does not."""
    left = orders(spark, {"id": 1, "create_time": TIME.format(10)})
    right = details(spark, *[{"id": i, "order_id": 1, "create_time": TIME.format(s)} for i, s in enumerate((4, 5, 10, 15, 16))])
    joined = order_with_detail(with_rowtime(left), with_rowtime(right))
    assert sorted(r.detail_id for r in joined.collect()) == [1, 2, 3]
    late = right.withColumn("rowtime", F.expr("TIMESTAMP '2024-03-01 10:00:15.001'"))
    assert order_with_detail(with_rowtime(left), late).count() == 0


def test_order_wide_columns_and_missing_dimensions(spark):
    wide = jobs.order_wide(
        orders(spark, {"id": 1, "create_time": TIME.format(1)}, {"id": 2, "create_time": TIME.format(1), "user_id": None, "province_id": 99}),
        details(spark, {"id": 11, "order_id": 1, "create_time": TIME.format(1)}, {"id": 12, "order_id": 2, "sku_id": 404, "sku_name": "own", "create_time": TIME.format(1)}),
        dims(spark), F.lit("2024-03-01").cast("date"),
    )
    assert wide.columns == list(schemas.ORDER_WIDE_COLUMNS) and len(wide.columns) == 35
    full, bare = sorted(wide.collect(), key=lambda r: r.detail_id)
    assert (full.user_age, full.user_gender, full.province_name, full.province_3166_2_code) == (24, "F", "North", "X-N")
    assert (full.sku_name, full.spu_id, full.spu_name, full.category3_name, full.tm_id, full.tm_name) == ("phone", 5, "phones", "mobile", None, None)
    assert (full.create_date, full.create_hour, full.expire_time) == ("2024-03-01", "10", None)
    assert (bare.sku_name, bare.spu_name, bare.user_age, bare.province_name) == ("own", None, None, None)


def test_payment_bounds_and_names(spark):
    pay = typed(spark, schemas.PAYMENT_INFO_SCHEMA, [{
        "id": 5, "order_id": 1, "user_id": 70, "total_amount": Decimal("49.00"), "subject": "s", "payment_type": "1101",
        "create_time": "2024-03-01 10:20:00", "callback_time": "2024-03-01 10:30:00",
    }])
    times = ["2024-03-01 09:59:59", "2024-03-01 10:00:00", "2024-03-01 10:30:00", "2024-03-01 10:30:01"]
    wide = spark.createDataFrame(
        [(i, 1, 7, Decimal("50.00"), t) for i, t in enumerate(times)],
        "detail_id BIGINT, order_id BIGINT, user_id BIGINT, total_amount DECIMAL(16,2), create_time STRING",
    )
    missing = [c for c in schemas.ORDER_WIDE_COLUMNS if c not in wide.columns]
    wide = wide.select("*", *[F.lit(None).cast(schemas.ORDER_WIDE_COLUMNS[c]).alias(c) for c in missing])
    rows = payment_wide(with_rowtime(pay, "callback_time"), with_rowtime(wide)).collect()
    assert sorted(r.detail_id for r in rows) == [1, 2]
    row = rows[0]
    assert (row.payment_id, row.user_id, row.total_amount) == (5, 70, Decimal("49.00"))
    assert row.payment_create_time == "2024-03-01 10:20:00" and row.order_create_time in times
    assert tuple(row.__fields__) == schemas.PAYMENT_WIDE_COLUMNS


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.lists(st.tuples(st.integers(0, 2), st.integers(-40, 40)), max_size=12),
    right=st.lists(st.tuples(st.integers(0, 2), st.integers(-40, 40)), max_size=12),
    lower=st.integers(-15, 5), width=st.integers(0, 20), spread=st.sampled_from([1, 3]), zoned=st.booleans(),
)
def test_interval_join_against_brute_force(spark, left, right, lower, width, spread, zoned):
    def of(rows, prefix):
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"{prefix}i INT, {prefix}k INT, {prefix}s BIGINT")
        time = F.timestamp_seconds(f"{prefix}s")
        return df.withColumn(f"{prefix}t", time if zoned else time.cast("timestamp_ntz"))

    upper = lower + width
    expected = sorted(
        (i, j) for i, (k, s) in enumerate(left) for j, (q, r) in enumerate(right) if k == q and s + lower <= r <= s + upper
    )
    got = interval_join(of(left, "l"), of(right, "r"), "lk", "rk", "lt", "rt", lower, upper, spread)
    assert sorted((r.li, r.ri) for r in got.collect()) == expected


def test_lookup_on_two_keys_and_repeated_keys(spark):
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "k INT, g STRING")
    dim = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "y")], "id INT, kind STRING, name STRING")
    got = lookup(facts, dim, {"k": "id", "g": "kind"}, {"name": "name"}, unique=False)
    assert sorted(got.collect(), key=str) == sorted([(None, "a", None), (1, "a", "x"), (1, "b", None)], key=str)


def test_merge_wide(spark):
    first = spark.createDataFrame([(1, None, None), (2, "a", None)], "order_id INT, order_status STRING, split_total_amount INT")
    second = spark.createDataFrame([(1, "z", 5), (2, "b", 6)], "order_id INT, order_status STRING, split_total_amount INT")
    got = merge_wide(first, second, ["order_id"], ("order_status",)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "z", None), (2, "a", None)]


def test_comments_and_single_orders(spark):
    comments = spark.createDataFrame([(3, "1201", TIME.format(1)), (3, "1203", TIME.format(2))], "sku_id BIGINT, appraise STRING, create_time STRING")
    refunds = typed(spark, schemas.REFUND_SCHEMA, [{"sku_id": 3, "order_id": 1, "refund_amount": Decimal("4.00"), "create_time": TIME.format(3)}])
    twice = refunds.unionByName(refunds)
    row = product_stats(union_measures([m.product_comments(comments), m.product_refunds(twice)])).first()
    assert (row.comment_ct, row.good_comment_ct, row.refund_order_ct, row.refund_amount) == (2, 1, 1, Decimal("8.00"))
    assert (row.stt, row.edt) == (TIME.format(0), TIME.format(10))


def test_product_statistics_has_all_columns(spark):
    page_rows = spark.createDataFrame([], schemas.LOG_SCHEMA)
    wide = jobs.order_wide(
        orders(spark, {"id": 1, "create_time": TIME.format(1)}), details(spark, {"id": 11, "order_id": 1, "create_time": TIME.format(1)}),
        dims(spark), F.lit("2024-03-01").cast("date"),
    )
    paid = jobs.payment_wide_rows(typed(spark, schemas.PAYMENT_INFO_SCHEMA, []), wide)
    facts = jobs.ProductFacts(
        page_rows, wide, paid, typed(spark, schemas.FAVOR_SCHEMA, []), typed(spark, schemas.CART_SCHEMA, []),
        typed(spark, schemas.REFUND_SCHEMA, []), typed(spark, schemas.COMMENT_SCHEMA, []),
    )
    row = jobs.product_statistics(facts, dims(spark))
    assert set(row.columns) == set(schemas.PRODUCT_STATS_COLUMNS) - {"ts"}
    only = row.collect()
    assert len(only) == 1 and (only[0].order_ct, only[0].order_sku_num, only[0].sku_price) == (1, 2, Decimal("9.50"))


@pytest.mark.parametrize("code, name", [("1004", "finished"), ("1201", "good")])
def test_codes(spark, code, name):
    table = code_table(spark)
    assert table.count() == len(CODES)
    assert table.filter(F.col("code") == code).first().code_name == name
