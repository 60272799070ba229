"""One key with a third of the rows: same results, and no task that holds it all."""

from pyspark.sql import functions as F

from brookhouse.operators import first_flag_days, heavy_keys, interval_join, latest_by_key, spread_join
from brookhouse.operators.skew import HEAVY_PARTS

ROWS = 30_000


def skewed(spark):
    """Device 0 has a third of the rows, the others about as many each as they are."""
    df = spark.range(ROWS)
    return df.select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("device"),
        F.timestamp_seconds(F.col("id") * 7).alias("t"), F.lit("1").alias("flag"),
    )


def test_heavy_keys_are_few_and_sized(spark):
    first = first_flag_days(skewed(spark), "device", "flag", F.to_date("t"))
    heavy = heavy_keys(first, ["device"]).collect()
    assert len(heavy) < HEAVY_PARTS
    assert {r.device: r.pieces for r in heavy} == {0: 334}


def test_spread_join_gives_the_plain_join(spark):
    df = skewed(spark)
    first = first_flag_days(df, "device", "flag", F.to_date("t"))
    got = spread_join(df, first, ["device"])
    plain = df.join(first.drop("n"), "device", "left")
    assert got.count() == ROWS
    assert got.select(*sorted(got.columns)).exceptAll(plain.select(*sorted(got.columns))).count() == 0


def test_spread_join_balances_the_heavy_key(spark):
    """With every join shuffled, no partition gets the whole heavy key."""
    df = skewed(spark)
    first = first_flag_days(df, "device", "flag", F.to_date("t"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(df, first, ["device"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == ROWS and max(sizes) < ROWS / 4


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_adaptive_execution_splits_a_hot_key_of_an_interval_join(spark):
    """Both inputs reach the join from their shuffles, so a hot slot can be split."""
    left = spark.range(500).select(F.col("id").alias("order_id"), F.timestamp_seconds(F.lit(1_000_000)).alias("ot"))
    right = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("key"),
        F.timestamp_seconds(F.lit(1_000_001)).alias("dt"), F.sha2(F.col("id").cast("string"), 512).alias("load"),
    ).repartition(16)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = interval_join(left, right, "order_id", "key", "ot", "dt", -5, 5)
        plan = plan_of(joined)
        assert joined.count() == 60_000
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "skew=true" in plan


def test_map_side_limits_before_the_shuffle(spark):
    plan = latest_by_key(skewed(spark), ["device"], ["id"])._jdf.queryExecution().executedPlan().toString()
    limit = plan.index("WindowGroupLimit")
    assert plan.index("WindowGroupLimit", limit + 1) > plan.index("Exchange hashpartitioning")
