import random

import pytest

from quern.operators import statistics
from quern.operators.temporal import asof_join, range_join


@pytest.mark.parametrize("seed", range(3))
def test_asof_against_brute_force(spark, seed):
    rng = random.Random(seed)
    some = lambda p: None if rng.random() < p else rng.randint(0, 40)
    left = [(i, some(0.1) and rng.choice([1, 2, 3]), some(0.1)) for i in range(60)]
    right = [(some(0.1) and rng.choice([1, 2]), some(0.1), i, rng.choice([None, i])) for i in range(40)]
    l = spark.createDataFrame([(*r, "x") for r in left], "id int, k int, at int, v string")
    r = spark.createDataFrame([(*x, "y") for x in right], "k int, at int, n int, v int, extra string")
    got = {x.id: (x.asof_v, x.asof_n) for x in asof_join(l, r, "k", "at", ["v", "n"], tie="n", width=[3.0, 7.0, 1000.0][seed]).collect()}
    for i, k, at in left:
        fits = [x for x in right if None not in (k, at, x[0], x[1]) and x[0] == k and x[1] <= at]
        best = max(fits, key=lambda x: (x[1], x[2]), default=None)
        assert got[i] == ((best[3], best[2]) if best else (None, None))


def test_range_join_against_brute_force(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([None, rng.uniform(-20, 20)])) for i in range(80)]
    ranges = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(30)] + [(99, None, 3.0)]
    got = range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, low double, high double"), "x", "low", "high", 3.0)
    want = sorted((p, r) for p, x in points for r, a, b in ranges if None not in (x, a, b) and a <= x <= b)
    assert sorted((r.p, r.r) for r in got.collect()) == want


def test_a_wide_range_does_not_multiply_rows(spark):
    points = spark.createDataFrame([(i, float(i)) for i in range(50)], "p int, x double")
    ranges = spark.createDataFrame([(1, -1e12, 1e12), (2, 3.0, 3.0), (3, 4.5, 9.0), (4, float("-inf"), 1.0), (5, float("nan"), 1.0)], "r int, low double, high double")
    got = sorted((r.p, r.r) for r in range_join(points, ranges, "x", "low", "high", 0.001).collect())
    assert got == sorted([(i, 1) for i in range(50)] + [(3, 2)] + [(i, 3) for i in range(5, 10)])


def test_column_report(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "x int, y string")
    for exact in (False, True):
        found = {r.column_name: (r.nulls, r.distinct, r.min, r.max) for r in statistics.column_report(df, ["x", "y"], exact=exact).collect()}
        assert found == {"x": (0, 2, "1", "2"), "y": (1, 2, "a", "b")}


def test_statistics_policy():
    policy = statistics.StatisticsPolicy()
    assert not policy.due(100, 105, 0, now=1000)
    assert policy.due(100, 120, 0, now=61) and not policy.due(100, 120, 0, now=59)
    assert policy.due(100, 100, 0, now=3001)
    files = [{"bytes": 100 << 20}] * 4
    assert statistics.read_cost(files, files) == pytest.approx(1) and statistics.read_cost(files, files[:1]) == pytest.approx(0.25)
    assert statistics.read_cost(files, files, columns_share=0.5) < 0.55 and statistics.read_cost([], []) == 0


def test_density_of_nothing(spark):
    assert [r.rows_per_key for r in statistics.rows_per_key(spark.createDataFrame([], "a int, b int"), ["a", "b"]).collect()] == [None, None]
