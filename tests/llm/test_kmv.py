import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import kmv

SCHEMA = "g string, item long, g_h string"


def test_small_sets_are_exact(spark):
    df = spark.createDataFrame([("a", 1, ""), ("a", 1, ""), ("a", 2, ""), ("b", None, ""), (None, 5, "")], SCHEMA)
    got = {r.g: (r.distinct_items, r.distinct_items_low, r.distinct_items_high) for r in kmv.distinct_counts(kmv.sketch(df, ["g"], ["item"]), ["g"]).collect()}
    assert got == {"a": (2, 2, 2), "b": (0, 0, 0), None: (1, 1, 1)}
    assert kmv.distinct_counts(kmv.sketch(df.limit(0), ["g"], ["item"]), ["g"]).isEmpty()


def test_large_sets_within_bounds_and_parts_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 21_000).alias("item"))
    k = 1024
    whole = kmv.sketch(df, ["g"], ["item"], k)
    parts = kmv.sketch(df.where("item < 9000"), ["g"], ["item"], k).unionByName(kmv.sketch(df.where("item >= 8000"), ["g"], ["item"], k))
    assert sorted(whole.collect()) == sorted(kmv.merge(parts, ["g"], k).collect())
    for r in kmv.distinct_counts(whole, ["g"], k).collect():
        assert r.distinct_items == pytest.approx(7000, rel=0.12)
        assert r.distinct_items_low <= 7000 <= r.distinct_items_high or abs(r.distinct_items - 7000) < 3.5 * 7000 / k**0.5


def test_bounds_cover_most_of_the_time(spark):
    k = 64
    df = spark.range(200 * 500).select((F.col("id") % 200).alias("g"), F.col("id").alias("item"))
    counted = kmv.distinct_counts(kmv.sketch(df, ["g"], ["item"], k), ["g"], k).collect()
    covered = sum(r.distinct_items_low <= 500 <= r.distinct_items_high for r in counted)
    assert covered >= 180  # 95 % asked for
    assert sum(r.distinct_items for r in counted) / 200 == pytest.approx(500, rel=0.04)


def test_set_operations(spark):
    df = spark.range(0, 12_000).select(F.lit("a").alias("g"), F.col("id").alias("item")).union(spark.range(8_000, 20_000).select(F.lit("b"), F.col("id")))
    for k, near in ((65_536, 0.0), (2048, 0.12)):
        packed = kmv.pack(kmv.sketch(df, ["g"], ["item"], k), ["g"], k)
        r = kmv.compare(packed, F.col("g") == "a", F.col("g") == "b", "a", "b").collect()[0]
        assert r.in_union == pytest.approx(20_000, rel=near or 1e-9)
        assert r.in_both == pytest.approx(4_000, rel=near or 1e-9)
        assert r.only_a == pytest.approx(8_000, rel=near or 1e-9)
        assert r.in_both_low <= r.in_both <= r.in_both_high
    none = kmv.compare(packed, F.col("g") == "a", F.col("g") == "missing", "a", "missing").collect()[0]
    assert none.in_both == 0 and none.only_a == none.in_union


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_cut_to_the_smallest(spark, monkeypatch, block):
    monkeypatch.setattr(kmv, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2]), rng.choice([None, *range(60)])) for _ in range(900)]
    got = kmv.merge(spark.createDataFrame(rows, "g string, p int, h long").repartition(5), ["g", "p"], 20).collect()
    want = []
    for group in {r[:2] for r in rows}:
        values = sorted({r[2] for r in rows if r[:2] == group}, key=lambda v: (v is None, v))
        want += [(*group, v) for v in values[:20]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("k", [64, 256])
def test_orders_within_bounds(spark, k):
    """Groups of many more customers than k: estimates, bounds and sets against exact counts."""
    orders = spark.read.parquet("/root/testdata/sf0.1/tpch_orders.parquet").select(F.upper(F.trim("o_orderpriority")).alias("p"), "o_custkey").dropna().distinct()
    exact = {}
    for r in orders.collect():
        exact.setdefault(r.p, set()).add(r.o_custkey)
    sketches = kmv.sketch(orders, ["p"], ["o_custkey"], k)
    counted = {r.p: r for r in kmv.distinct_counts(sketches, ["p"], k).collect()}
    assert min(map(len, exact.values())) > 4 * k
    held = [(len(exact[p]), r.distinct_items, r.distinct_items_low, r.distinct_items_high) for p, r in counted.items()]
    packed = kmv.pack(sketches, ["p"], k).cache()
    for a, b in itertools.combinations(sorted(exact), 2):
        r = kmv.compare(packed, F.col("p") == a, F.col("p") == b, a, b).first()
        for name, true in (("in_union", exact[a] | exact[b]), ("in_both", exact[a] & exact[b]), ("only_a", exact[a] - exact[b])):
            held.append((len(true), r[name], r[f"{name}_low"], r[f"{name}_high"]))
    assert sum(low <= n <= high for n, _, low, high in held) >= 0.85 * len(held)
    assert all(abs(value - n) <= 5 * max(n, len(exact["2-FAST"])) / k**0.5 for n, value, _, _ in held)
