"""Scalar functions with the host's behaviour where Spark's differs, and a registry for functions of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def divide(a: Column, b: Column) -> Column:
    """a / b, null when b is zero; Spark in ANSI mode raises."""
    return F.try_divide(a, b)


def null_if(a: Column, b: Column) -> Column:
    return F.when(~a.eqNullSafe(b), a)


def substring(text: Column, start: int, length: int | None = None) -> Column:
    """From the start-th character, counted from the end if negative; position 0 gives an empty string."""
    if start == 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.substring(text, start, length if length is not None else 2**31 - 1)


def pad_equal(a: Column, b: Column) -> Column:
    """Equality that overlooks trailing blanks, as fixed-width columns compare."""
    return F.rtrim(a) == F.rtrim(b)


def register(spark: SparkSession, name: str, function: Callable, returns: T.DataType | str, *, vectorized: bool = True):
    """A function of one's own for SQL and DataFrames; over Arrow batches unless told otherwise."""
    made = F.pandas_udf(function, returns) if vectorized else F.udf(function, returns)
    return spark.udf.register(name, made)


def register_table(spark: SparkSession, name: str, handler: type, returns: T.StructType | str):
    """A table function of one's own for SQL: a class whose eval yields rows for the arguments of one call."""
    return spark.udtf.register(name, F.udtf(handler, returnType=returns))


#: How states of an aggregate of one's own are put together.
MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


def aggregate_by(df: DataFrame, groups: Sequence[str], columns: Sequence[str], partial: Callable[[pd.DataFrame], Mapping[str, float]], merges: Mapping[str, str]) -> DataFrame:
    """(groups, states): an aggregate of one's own whose states are numbers that add up or have a least or greatest.

    partial gives the states of a part of a group's rows, as a mapping with the keys of merges; parts are
    Arrow batches, so no group is ever gathered in one place, and states are put together in the JVM by
    "sum", "min" or "max". Null groups are groups; an empty table has none.
    """
    unknown = set(merges.values()) - set(MERGES)
    if unknown:
        raise ValueError(f"unknown merge {sorted(unknown)}")
    names, used = list(groups), [*groups, *columns]
    schema = T.StructType([*(df.schema[g] for g in names), *(T.StructField(s, T.DoubleType()) for s in merges)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for key, part in pdf.groupby(names, dropna=False, sort=False):
                state = partial(part[list(columns)])
                found.append([*(None if pd.isna(k) else k for k in key), *(state[s] for s in merges)])
            if found:
                yield pd.DataFrame(found, columns=[*names, *merges])

    parts = df.select(*dict.fromkeys(used)).mapInPandas(run, schema)
    return parts.groupBy(*names).agg(*(MERGES[how](s).alias(s) for s, how in merges.items()))
