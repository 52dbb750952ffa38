"""Joins with a table that has one row a key, where some keys hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one part in this many of all counted rows is split; so there are fewer such keys than this.
HOT_PARTS = 1_000


def salts(count: Column, total: int, parts: int = HOT_PARTS) -> Column:
    """Into how many pieces a key's rows are cut: one, or as many as make a piece total / parts rows."""
    return F.greatest(F.lit(1), F.ceil(count.cast("double") * F.lit(float(parts)) / F.lit(float(max(1, total))))).cast("int")


def join_counted(df: DataFrame, lookup: DataFrame, keys: Sequence[str], count: str, total: int, spread_by: Sequence[str], *, parts: int = HOT_PARTS) -> DataFrame:
    """Inner join of df with lookup, whose rows are one a key and say in `count` how many rows of df the key has.

    total is the sum of those counts, or more. A key with more than total / parts rows has its rows cut
    into pieces by a hash of spread_by, and its row of lookup repeated once a piece; the pieces of all such
    keys are 2 * parts at most, and the keys, which are broadcast, fewer than parts. No task gets more of
    one key than a piece. The result has df's columns, the lookup's others and __salt, the piece. Null keys
    join with nothing; an empty side gives an empty result.
    """
    names = list(keys)
    cut = salts(F.col(count), total, parts)
    hot = lookup.where(cut > 1).select(*names, cut.alias("__cut"))
    left = df.join(F.broadcast(hot), names, "left")
    left = left.withColumn("__salt", F.when(F.col("__cut").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread_by), F.col("__cut"))).cast("int")).drop("__cut")
    right = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), cut - 1)))
    return left.join(right, [*names, "__salt"])
