"""Files, functions of one's own and the small operators, on clean and odd rows."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.hostlike import aggregate_by, divide, null_if, pad_equal, register_table, substring
from quern.operators.access import not_in
from quern.operators.predicates import condition, constant, select_where
from quern.operators.statistics import approximate_rows_per_key, take_statistics
from quern.session import application_dir, materialize, scratch, sweep
from quern.sources.files import read_files, write_files


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_files_keep_odd_values(spark, tmp_path, kind):
    schema = T.StructType.fromDDL("k bigint, v string, x double, at timestamp_ntz")
    df = spark.createDataFrame([(1, None, None, None), (None, "", 0.5, None), (2, 'say "a, b"', -1e300, None)], schema)
    write_files(df, f"file://{tmp_path}/f", kind)
    assert sorted(map(repr, read_files(spark, f"file://{tmp_path}/f", kind, schema).collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(ValueError):
        write_files(df, f"file://{tmp_path}/g", "xml")
    with pytest.raises(ValueError):
        read_files(spark, f"file://{tmp_path}/f", "xml", schema)


def test_host_functions(spark):
    df = spark.createDataFrame([(1.0, 0.0, "ab  ", "ab"), (3.0, 2.0, None, "ab"), (None, 1.0, "a", "ab")], "a double, b double, s string, t string")
    found = df.select(divide(F.col("a"), F.col("b")).alias("d"), null_if(F.col("a"), F.lit(1.0)).alias("n"), pad_equal(F.col("s"), F.col("t")).alias("e"), substring(F.col("t"), 0).alias("z"), substring(F.col("t"), -1).alias("l")).collect()
    assert [tuple(r) for r in found] == [(None, None, True, "", "b"), (1.5, 3.0, None, "", "b"), (None, None, False, "", "b")]


def test_constants_take_the_type_of_the_column(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    kinds = df.select(constant(5, T.IntegerType()).alias("a"), constant(2.5, T.IntegerType()).alias("b"), constant(2**40, T.IntegerType()).alias("c"), constant(None, T.StringType()).alias("d")).schema
    assert [kinds[c].dataType.simpleString() for c in "abc"] == ["int", "double", "bigint"]
    assert [r.k for r in select_where(df, (">", "k", 1.5)).collect()] == [2]
    assert select_where(df, ("<", "k", 2**40)).count() == 2 and select_where(df, ("=", "v", None)).isEmpty()
    for tree in (("near", "k", 1), ("and",)):
        with pytest.raises(ValueError):
            condition(df, tree)


def test_not_in_is_that_of_sql(spark):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (5,)], "n int")
    values = lambda df: sorted((r.k for r in df.collect()), key=repr)
    assert values(not_in(left, "k", right, "n")) == [1]
    assert values(not_in(left, "k", right.union(spark.createDataFrame([(None,)], "n int")), "n")) == []
    assert values(not_in(left, "k", right.limit(0), "n")) == [1, 2, None]


def test_own_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), (None, 2.0), ("b", -3.0)], "g string, x double").repartition(3)
    partial = lambda pdf: {"n": len(pdf), "most": pdf["x"].max()}
    assert {r.g: (r.n, r.most) for r in aggregate_by(df, ["g"], ["x"], partial, {"n": "sum", "most": "max"}).collect()} == {"a": (2, 5), None: (1, 2), "b": (1, -3)}
    assert aggregate_by(df.limit(0), ["g"], ["x"], partial, {"n": "sum", "most": "max"}).isEmpty()
    with pytest.raises(ValueError):
        aggregate_by(df, ["g"], ["x"], partial, {"n": "mean"})


def test_own_table_functions(spark):
    class Twice:
        def eval(self, x: int):
            yield (x,)
            yield (x,)

    register_table(spark, "quern_twice_rows", Twice, "y int")
    assert spark.sql("SELECT y FROM VALUES (1), (2) t(x), LATERAL quern_twice_rows(x)").count() == 4


def test_rough_statistics(spark):
    df = spark.range(10_000).select((F.col("id") % 500).alias("k"))
    row = approximate_rows_per_key(df, "k").first()
    assert abs(row.distinct_keys - 500) <= 50 and abs(row.rows_per_key - 20) <= 2
    nothing = take_statistics(df.limit(0), {"by_k": ["k"]})
    assert nothing["rows"] == 0 and nothing["rows_per_key"] == {"by_k.1": 0.0}


def test_written_tables_go_with_their_scope(spark):
    kept = materialize(spark.range(3), "kept")
    with scratch():
        gone = materialize(spark.range(4), "gone")
        assert gone.count() == 4
        path = gone.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3
    root = application_dir(spark).removeprefix("file://").rsplit("/", 1)[0]
    os.makedirs(f"{root}/quern-app-of-a-dead-driver/table")
    assert sweep(spark, 3600) == 0 and sweep(spark, -1) >= 1 and kept.count() == 3
