import random

import pytest
from pyspark.sql import functions as F

from quern.llm.topn import top_n_per_group

SCHEMA = "g string, s double, t long, g2 string, rank long"


def brute(rows, n):
    out = []
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and r[1] is not None]
        own.sort(key=lambda r: (0 if r[1] != r[1] else 1, -r[1] if r[1] == r[1] else 0, r[2] is not None, r[2] or 0))
        out += [(r[0], repr(r[1]), r[2]) for r in own[:n]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("max_bounds", [1, 1000])
def test_against_brute_force(spark, seed, max_bounds):
    rng = random.Random(seed)
    score = lambda: rng.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.5, rng.random()])
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), score(), rng.choice([None, rng.randint(0, 9), rng.randint(0, 999)]), "x", 1) for _ in range(900)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = top_n_per_group(df, "g", "s", "t", 4, block_rows=64, max_bounds=max_bounds)
    assert sorted(((r.g, repr(r.s), r.t) for r in got.collect()), key=repr) == brute(rows, 4)


def test_bounds_thin_out_the_hot_group(spark):
    df = spark.range(200_000, numPartitions=4).select(F.lit(1).alias("g"), F.hash("id").alias("s"), F.col("id").alias("t"))
    got = top_n_per_group(df, "g", "s", "t", 3, block_rows=10_000)
    want = sorted(df.collect(), key=lambda r: (-r.s, r.t))[:3]
    assert [r.t for r in got.orderBy("rank_in_group").collect()] == [r.t for r in want]


def test_empty(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), "g", "s", "t", 2).isEmpty()


def test_all_equal(spark):
    df = spark.createDataFrame([("a", 1.0, i, "x", 0) for i in range(5000)], SCHEMA)
    assert sorted(r.t for r in top_n_per_group(df, "g", "s", "t", 3, block_rows=100).collect()) == [0, 1, 2]
