import math
import random
from decimal import Decimal

import pytest

from quern.llm import logsketch

SCHEMA = "g string, x decimal(12,2), sign string, bucket string"
Q = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def frame(spark, values, group="a"):
    return spark.createDataFrame([(group, None if v is None else Decimal(f"{v:.2f}"), "s", "b") for v in values], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_relative_error_is_bounded(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([1, -1, 1]) * round(10 ** rng.uniform(-2, 7), 2) for _ in range(3000)] + [0.0] * 50 + [99999999.99] * 3
    got = {r.quantile: r.value for r in logsketch.percentiles(logsketch.bucket_counts(frame(spark, [*values, None]), ["g"], "x"), ["g"], Q).collect()}
    ranked = sorted(values)
    for q in Q:
        exact = ranked[math.floor(q * (len(ranked) - 1))]
        assert abs(got[q] - exact) <= logsketch.ACCURACY * abs(exact) * (1 + 1e-9)


def test_parts_add_up(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1000) for _ in range(500)]
    whole = logsketch.bucket_counts(frame(spark, values), ["g"], "x")
    parts = logsketch.bucket_counts(frame(spark, values[:200]), ["g"], "x").unionByName(logsketch.bucket_counts(frame(spark, values[200:]), ["g"], "x"))
    assert sorted(whole.collect()) == sorted(logsketch.merge_counts(parts, ["g"]).collect())


def test_empty_null_and_special_values(spark):
    assert logsketch.percentiles(logsketch.bucket_counts(frame(spark, []), ["g"], "x"), ["g"], Q).isEmpty()
    assert logsketch.bucket_counts(frame(spark, [None, None]), ["g"], "x").isEmpty()
    odd = spark.createDataFrame([(None, float("nan")), (None, float("inf")), (None, 4.0)], "g string, x double")
    rows = logsketch.percentiles(logsketch.bucket_counts(odd, ["g"], "x"), ["g"], [0.5]).collect()
    assert len(rows) == 1 and rows[0].g is None and rows[0].n_values == 1
