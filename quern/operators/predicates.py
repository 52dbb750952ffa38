"""Conditions as trees, turned into columns.

A tree is ("and" | "or", tree, ...), ("not", tree) or (operator, column, constant...). An operator that is
not known is an error, never a condition that lets everything pass.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "<=>": lambda c, v: c.eqNullSafe(v),
}


def constant(value: Any, kind: T.DataType) -> Column:
    """A constant in the column's type. One that does not fit it is compared in its own type instead."""
    if value is None or isinstance(value, bool):
        return F.lit(value)
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if whole and (isinstance(value, float) or not isinstance(value, (int, str))):
        return F.lit(value)
    if whole and isinstance(value, int) and abs(value) >= 2 ** {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[kind.simpleString()]:
        return F.lit(value) if abs(value) < 2**63 else F.lit(str(value)).cast("decimal(38,0)")
    return F.lit(value).cast(kind)


def condition(df: DataFrame, tree: tuple) -> Column:
    """The column a tree stands for over df."""
    head, *rest = tree
    if head in ("and", "or"):
        parts = [condition(df, t) for t in rest]
        if not parts:
            raise ValueError(f"{head} of nothing")
        return reduce(Column.__and__ if head == "and" else Column.__or__, parts)
    if head == "not":
        return ~condition(df, rest[0])
    name = rest[0]
    column, kind = F.col(name), df.schema[name].dataType
    if head in COMPARISONS:
        return COMPARISONS[head](column, constant(rest[1], kind))
    if head == "is null":
        return column.isNull()
    if head == "is not null":
        return column.isNotNull()
    if head == "in":
        return column.isin(*(constant(v, kind) for v in rest[1]))
    if head == "between":
        return column.between(constant(rest[1], kind), constant(rest[2], kind))
    if head == "like":
        return column.like(rest[1])
    raise ValueError(f"unknown operator {head}")


def select_where(df: DataFrame, tree: tuple, columns: list[str] | None = None) -> DataFrame:
    found = df.where(condition(df, tree))
    return found.select(*columns) if columns else found
