"""Percentiles from counts in signed logarithmic buckets.

A value x lies in the bucket ceil(log_g |x|) of its sign, g = (1 + a) / (1 - a); every value of a bucket
is within the share a of the bucket's middle. Counts of equal buckets add up over parts and days in any
order, and a percentile is the middle of the bucket that holds its rank: the error of the value is at
most the share a of it, whatever the distribution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest relative error of a percentile.
ACCURACY = 0.005
#: Values nearer to zero than this count as zero.
LEAST = 1e-9


def gamma(accuracy: float = ACCURACY) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket(value: Column, accuracy: float = ACCURACY) -> tuple[Column, Column]:
    """Sign and index of a value's bucket."""
    x = value.cast("double")
    sign = F.when(F.abs(x) < LEAST, F.lit(0)).otherwise(F.signum(x).cast("int"))
    index = F.when(sign == 0, F.lit(0)).otherwise(F.ceil(F.log(F.greatest(F.abs(x), F.lit(LEAST))) / F.lit(math.log(gamma(accuracy)))).cast("int"))
    return sign, index


def bucket_counts(df: DataFrame, groups: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(groups, sign, bucket, n): the sketch. Nulls, NaN and infinities are not counted; null groups are groups.

    The number of rows per group is bounded by the logarithm of the range of values, 4600 for decimals of
    ten digits, so the shuffle is small whatever the input: counting happens on the map side.
    """
    x = F.col(value).cast("double")
    sign, index = bucket(F.col(value), accuracy)
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return df.where(good).groupBy(*groups, sign.alias("sign"), index.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of parts, days or finer groups, put together."""
    return sketches.groupBy(*groups, "sign", "bucket").agg(F.sum("n").alias("n"))


def group_levels(sketches: DataFrame, groups: list[str], levels: dict[str, list[Column]]) -> DataFrame:
    """(level, groups, sign, bucket, n): sketches put together for several groupings at once, in one pass.

    Each level gives the values its rows have in the columns of groups.
    """
    rows = [F.struct(F.lit(name).alias("level"), *(c.alias(g) for c, g in zip(columns, groups, strict=True))) for name, columns in levels.items()]
    spread = sketches.select(F.explode(F.array(*rows)).alias("__g"), "sign", "bucket", "n").select("__g.*", "sign", "bucket", "n")
    return merge_counts(spread, ["level", *groups])


def percentiles(sketches: DataFrame, groups: list[str], quantiles: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """(groups, quantile, value, n_values): of n sorted values the one at place floor(q * (n - 1)), within the accuracy."""
    g = gamma(accuracy)
    side = Window.partitionBy(*groups)
    ordered = side.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    upto = sketches.withColumn("__upto", F.sum("n").over(ordered)).withColumn("__all", F.sum("n").over(side))
    middle = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * F.lit(2.0) * F.pow(F.lit(g), F.col("bucket").cast("double")) / F.lit(g + 1))
    place = lambda q: F.floor(q * (F.col("__all") - 1))
    hit = F.filter(F.array(*(F.lit(float(q)) for q in quantiles)), lambda q: (F.col("__upto") > place(q)) & (F.col("__upto") - F.col("n") <= place(q)))
    return upto.select(*groups, middle.alias("value"), F.col("__all").alias("n_values"), F.explode(hit).alias("quantile"))
