import pytest
from pyspark.sql import functions as F

from clipquest.operators.skew import (SkewPolicy, hot_keys, large_keys, lookup_join, only_keys,
                                      rows_per_key)

POLICY = SkewPolicy(rows_per_slice=100, max_hot_keys=30)


@pytest.fixture(scope="module")
def sides(spark):
    # One key holds a third of the rows; some keys have no partner.
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("key"),
        F.col("id").alias("pos"))
    right = spark.range(30).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
                                   F.col("id").alias("value"))
    return left, right.union(spark.createDataFrame([("hot", 99)], "key string, value bigint"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("policy", [POLICY, SkewPolicy(7, 1000), SkewPolicy()])
def test_slicing_changes_no_row(sides, how, policy):
    left, right = sides
    plain = left.join(right, "key", how)
    cut = lookup_join(left, right, ["key"], spread=["pos"], how=how, policy=policy)
    assert cut.columns == plain.columns
    assert sorted(cut.collect(), key=str) == sorted(plain.collect(), key=str)


def test_hot_keys_are_bounded_and_counted(sides):
    left, _ = sides
    large = large_keys(rows_per_key(left, ["key"]), ["key"], POLICY)
    assert list(large.values()) == [1000]
    fine = SkewPolicy(rows_per_slice=100, max_hot_keys=1000)
    assert len(large_keys(rows_per_key(left, ["key"]), ["key"], fine, growth=10)) == 41
    coarse = SkewPolicy(rows_per_slice=1, max_hot_keys=5)
    assert list(large_keys(rows_per_key(left, ["key"]), ["key"], coarse).values()) == [1000]


def test_every_hot_key_is_split(spark):
    """However many there are: no slice holds more than its share."""
    left = spark.range(6000 * 20).select((F.col("id") % 6000).alias("key"), F.col("id").alias("pos"))
    policy = SkewPolicy(rows_per_slice=10)
    large = large_keys(rows_per_key(left, ["key"]), ["key"], policy)
    assert len(large) == 6000
    right = spark.range(6000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    joined = lookup_join(left, right, ["key"], spread=["pos"], large=large, policy=policy)
    assert joined.filter("value = key * 2").count() == 120_000


def test_a_hot_key_meets_several_tasks(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        def largest_task(df):
            hot = df.filter("key = 'hot'").groupBy(F.spark_partition_id()).count()
            return hot.agg(F.max("count")).first()[0]

        assert largest_task(left.join(right, "key", "left")) == 1000
        assert largest_task(lookup_join(left, right, ["key"], spread=["pos"], policy=POLICY)) < 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_only_keys(sides):
    left, _ = sides
    large = large_keys(rows_per_key(left, ["key"]), ["key"], POLICY)
    assert only_keys(left, ["key"], large).count() == 1000


def test_other_joins_are_refused(sides):
    with pytest.raises(ValueError):
        lookup_join(*sides, ["key"], spread=["pos"], how="full")


@pytest.mark.parametrize("least", [1, 10, 40, 41, 1000])
def test_hot_keys_are_those_of_exact_counts(spark, least):
    df = spark.range(400).select(F.when(F.col("id") < 40, None).when(F.col("id") < 80, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 30).cast("string"))).alias("k"))
    for policy in (SkewPolicy(rows_per_slice=least), SkewPolicy(rows_per_slice=1, max_hot_keys=10)):
        assert hot_keys(df, ["k"], policy) == large_keys(rows_per_key(df, ["k"]), ["k"], policy)
    assert hot_keys(df.limit(0), ["k"]) == {}
