"""Access paths: scans, lookups, ranges and positioned reads by a key of one or more columns.

All of them are filters and orders over columns, so that pruning and pushdown reach the files; a sorted or
bucketed layout makes them cheap. Bounds are exact: open where asked to be, never a superset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All rows, only the columns asked for."""
    return df.select(*columns) if columns else df


def key_equals(columns: Sequence[str], key: Sequence[Any]) -> Column:
    """The first len(key) columns equal the key; a null in the key asks for null."""
    parts = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in zip(columns, key, strict=False)]
    return reduce(Column.__and__, parts, F.lit(True))


def key_compares(columns: Sequence[str], key: Sequence[Any], operator: str) -> Column:
    """Row comparison of the first len(key) columns with the key: '<', '<=', '>' or '>='.

    A key shorter than the columns is compared with their prefix: '<=' then takes in, and '>' leaves out,
    every row that begins with it. The first column is bounded on its own as well, which is what files
    can be skipped by.
    """
    names = list(columns[: len(key)])
    if len(names) == 1 and key[0] is not None:
        column, value = F.col(names[0]), F.lit(key[0])
        return {"<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[operator]
    strict = operator[0]
    ahead = (lambda c, v: F.col(c) > F.lit(v)) if strict == ">" else (lambda c, v: F.col(c) < F.lit(v))
    result = key_equals(names, key) if operator.endswith("=") else F.lit(False)
    for depth in range(len(names) - 1, -1, -1):
        result = result | (key_equals(names[:depth], key[:depth]) & ahead(names[depth], key[depth]))
    if len(names) > 1:
        edge = F.col(names[0]) >= F.lit(key[0]) if strict == ">" else F.col(names[0]) <= F.lit(key[0])
        result = edge & result
    return result


def lookup(df: DataFrame, columns: Sequence[str], key: Sequence[Any]) -> DataFrame:
    """Rows whose key, or its leading columns, equals the one given."""
    return df.where(key_equals(columns, key))


def lookup_many(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """Rows whose key is among keys (columns of the same names): a semi join, each row once."""
    return df.join(keys.select(*columns), list(columns), "left_semi")


def not_in(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """Rows whose value is in no row of others, as SQL's NOT IN has it: none if others holds a null, all if
    others is empty, and otherwise no row with a null. An anti join by key, so others may be of any size."""
    seen = others.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(other).isNull()).alias("nulls"))
    kept = df.where(F.col(column).isNotNull() | (seen.select("n").scalar() == 0)).where(seen.select("nulls").scalar() == 0)
    keys = others.where(F.col(other).isNotNull()).select(F.col(other).alias("__other"))
    return kept.join(keys, F.col(column) == F.col("__other"), "left_anti")


def range_scan(
    df: DataFrame, columns: Sequence[str], low: Sequence[Any] | None = None, high: Sequence[Any] | None = None,
    *, low_open: bool = False, high_open: bool = False,
) -> DataFrame:
    """Rows between two keys, either of which may be missing, a prefix, or excluded. Null keys are in no range."""
    where = F.col(columns[0]).isNotNull()
    if low is not None:
        where = where & key_compares(columns, low, ">" if low_open else ">=")
    if high is not None:
        where = where & key_compares(columns, high, "<" if high_open else "<=")
    return df.where(where)


def ordered(df: DataFrame, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """Rows in key order; nulls first ascending, last descending."""
    return df.orderBy(*(F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in columns))


def first(df: DataFrame, columns: Sequence[str], n: int = 1) -> DataFrame:
    return ordered(df, columns).limit(n)


def last(df: DataFrame, columns: Sequence[str], n: int = 1) -> DataFrame:
    return ordered(df, columns, descending=True).limit(n)


def read_at_or_after(df: DataFrame, columns: Sequence[str], key: Sequence[Any], n: int = 1) -> DataFrame:
    return first(range_scan(df, columns, low=key), columns, n)


def read_after(df: DataFrame, columns: Sequence[str], key: Sequence[Any], n: int = 1) -> DataFrame:
    """The n rows that follow every row with this key."""
    return first(range_scan(df, columns, low=key, low_open=True), columns, n)


def read_before(df: DataFrame, columns: Sequence[str], key: Sequence[Any], n: int = 1) -> DataFrame:
    """The n rows that come before every row with this key, nearest first."""
    return last(range_scan(df, columns, high=key, high_open=True), columns, n)


def read_prefix_last(df: DataFrame, columns: Sequence[str], prefix: Sequence[Any], n: int = 1, or_previous: bool = False) -> DataFrame:
    """The last rows that begin with the prefix; with or_previous, those before them too."""
    rows = range_scan(df, columns, high=prefix) if or_previous else lookup(df, columns, prefix)
    return last(rows, columns, n)


def cluster_by_key(df: DataFrame, columns: Sequence[str], path: str, *, partitions: int | None = None) -> None:
    """Write in key order: the layout by which lookups and ranges skip files and row groups."""
    keys = [F.col(c) for c in columns]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)
