"""Rows delivered more than once: keep the latest version of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_version(df: DataFrame, key: list[str], version: str, values: list[str]) -> DataFrame:
    """One row per key with the values of its latest version; exact copies collapse.

    Equal versions are settled by the greatest values, so the result never depends on the order of rows.
    A row with a null in any key column has no identity to be superseded by: such rows only lose their
    exact copies. Null versions are older than any other. Empty in, empty out. Columns beside key,
    version and values are pruned before the shuffle; the aggregate combines on the map side first.
    """
    payload = [version, *values]
    keyed = F.lit(True)
    for k in key:
        keyed = keyed & F.col(k).isNotNull()
    whole: Column = F.when(keyed, F.lit(None)).otherwise(F.struct(*payload))
    return (
        df.select(*key, *payload)
        .groupBy(*key, whole.alias("__whole"))
        .agg(F.max(F.struct(*payload)).alias("__last"))
        .select(*key, *(F.col(f"__last.{c}").alias(c) for c in payload))
    )
