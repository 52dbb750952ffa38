import random

import pytest
from pyspark.sql import functions as F

from quern.operators import access, predicates

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 6), rng.choice(["", "a", "ab", "abc", "b"]), rng.randint(-3, 3)) for _ in range(400)]
    rows += [(None, "a", 1), (0, None, 0)]
    return rows, spark.createDataFrame(rows, "a int, b string, c int").cache()


def inside(row, low, high, low_open, high_open):
    def side(key, more, openly):
        for v, k in zip(row, key, strict=False):
            if v is None:
                return False
            if v != k:
                return (v > k) == more
        return not openly

    if row[0] is None:
        return False
    return (low is None or side(low, True, low_open)) and (high is None or side(high, False, high_open))


@pytest.mark.parametrize("seed", range(12))
def test_ranges(table, seed):
    rows, df = table
    rng = random.Random(seed)
    key = lambda: [rng.randint(-1, 7), rng.choice(["", "a", "ab", "abc"]), rng.randint(-3, 3)][: rng.randint(1, 3)]
    low, high = rng.choice([None, key()]), rng.choice([None, key()])
    lo, ho = rng.random() < 0.5, rng.random() < 0.5
    got = sorted(map(repr, map(tuple, access.range_scan(df, COLUMNS, low, high, low_open=lo, high_open=ho).collect())))
    assert got == sorted(repr(r) for r in rows if inside(r, low, high, lo, ho))


def test_lookup_of_null_and_prefix(table):
    rows, df = table
    assert access.lookup(df, COLUMNS, [None]).count() == 1
    assert access.lookup(df, COLUMNS, [2, "ab"]).count() == sum(r[:2] == (2, "ab") for r in rows)


def test_positioned_reads(spark):
    df = spark.createDataFrame([(i // 2, i) for i in range(20)], "k int, v int")
    assert access.read_after(df, ["k", "v"], [4]).collect()[0].v == 10
    assert access.read_before(df, ["k", "v"], [4]).collect()[0].v == 7
    assert access.read_at_or_after(df, ["k", "v"], [4]).collect()[0].v == 8
    assert access.read_prefix_last(df, ["k", "v"], [4]).collect()[0].v == 9
    assert access.read_after(df, ["k", "v"], [9]).isEmpty()


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = access.range_scan(df, ["o_custkey"], [5], [40]).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,5)" in plan and "LessThanOrEqual(o_custkey,40)" in plan
    assert "o_totalprice" not in plan


def test_floats_compare_the_right_way(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, -0.0, 0.0, 2.5, float("inf"), None)], "x double")
    assert predicates.select_where(df, (">", "x", 0)).count() == 2
    assert predicates.select_where(df, ("<=", "x", 0)).count() == 3


def test_unknown_operators_are_errors(spark):
    with pytest.raises(ValueError):
        predicates.condition(spark.range(1), ("resembles", "id", 3))


def test_constants_out_of_range_match_nothing(spark):
    df = spark.range(3).select(F.col("id").cast("int").alias("i"))
    assert predicates.select_where(df, ("=", "i", 2**40)).count() == 0
    assert predicates.select_where(df, ("<", "i", 1.5)).count() == 2


def test_sorted_layout(spark, tmp_path):
    access.cluster_by_key(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"], str(tmp_path / "t"), partitions=4)
    assert access.lookup(spark.read.parquet(str(tmp_path / "t")), ["k"], [500]).count() == 1
