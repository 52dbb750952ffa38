"""What a planner wants to know of a table."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.access import range_scan


def row_count(df: DataFrame) -> DataFrame:
    """Exact number of rows; answered from footers where the source can."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def records_in_range(df: DataFrame, columns: Sequence[str], low: Sequence[Any] | None, high: Sequence[Any] | None) -> DataFrame:
    """Exact number of rows in a closed key range."""
    return range_scan(df, columns, low, high).agg(F.count(F.lit(1)).alias("records"))


def rows_per_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per distinct key for every leading part of a composite key; a null is a value.

    Rows are combined per whole key on the map side, and every shorter part is counted from the next longer one.
    """
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    found = []
    for width in range(len(columns), 0, -1):
        part = list(columns[:width])
        counts = counts.groupBy(*part).agg(F.sum("n").alias("n")) if width < len(columns) else counts
        whole = counts.agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"))
        found.append(whole.select(F.lit(",".join(part)).alias("key_part"), F.col("d").alias("distinct_keys"), F.try_divide(F.col("n").cast("double"), F.col("d").cast("double")).alias("rows_per_key")))
    return reduce(DataFrame.unionByName, reversed(found))


def approximate_rows_per_key(df: DataFrame, column: str, error: float = 0.02) -> DataFrame:
    """rows_per_key of one column in one pass with a fixed-size sketch."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(column, error).alias("distinct_keys")).select("distinct_keys", F.try_divide("n", "distinct_keys").alias("rows_per_key"))


def column_report(df: DataFrame, columns: Sequence[str], *, exact: bool = False, error: float = 0.02) -> DataFrame:
    """Rows that are null, distinct values, least and greatest of each column, as strings.

    Distinct values come from sketches of fixed size in one pass over all columns, within the error (one
    standard deviation). If exact, each column is grouped on its own, so that a pass moves one value a
    distinct value and partition and no row is copied per column.
    """
    names = ("nulls", "distinct", "min", "max")
    if exact:
        each = []
        for c in columns:
            held = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            whole = held.agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct"), F.min("v").cast("string").alias("min"), F.max("v").cast("string").alias("max"))
            each.append(whole.select(F.lit(c).alias("column_name"), *names))
        return reduce(DataFrame.unionByName, each)
    parts = []
    for c in columns:
        parts += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_nulls"), F.approx_count_distinct(c, error).alias(f"{c}_distinct"), F.min(c).cast("string").alias(f"{c}_min"), F.max(c).cast("string").alias(f"{c}_max")]
    wide = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column_name"), *(F.col(f"{c}_{x}").alias(x) for x in names)) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


@dataclass
class StatisticsPolicy:
    """When statistics are taken again: much has changed and some time has passed, or a long time has."""

    # They are part of the declared behaviour.
    changed_share: float = 0.10
    least_seconds: float = 60
    most_seconds: float = 3000

    def due(self, rows_then: int, rows_now: int, taken_at: float, now: float | None = None) -> bool:
        age = (time.time() if now is None else now) - taken_at
        if age > self.most_seconds:
            return True
        if age < self.least_seconds:
            return False
        return abs(rows_now - rows_then) > self.changed_share * max(1, rows_then)


def read_cost(files: Sequence[Mapping[str, Any]], touched: Sequence[Mapping[str, Any]], columns_share: float = 1.0, open_bytes: int = 4 << 20) -> float:
    """Bytes a read moves: the touched files' part for its columns, and for each file what opening it is worth
    (spark.sql.files.openCostInBytes), relative to a scan of all files and columns. 1.0 is a full scan."""
    whole = sum(f["bytes"] + open_bytes for f in files)
    return sum(f["bytes"] * columns_share + open_bytes for f in touched) / whole if whole else 0.0


def take_statistics(df: DataFrame, indexes: Mapping[str, Sequence[str]], error: float = 0.02) -> dict[str, Any]:
    """Number of rows, and rows per key of every leading part of each index, from sketches of fixed size in one pass.

    A null in a key is a value of its own. An empty table has 0 rows and densities of 0.
    """
    wanted = {f"{name}.{i + 1}": list(columns[: i + 1]) for name, columns in indexes.items() for i in range(len(columns))}
    sketches = [F.approx_count_distinct(F.xxhash64(*columns), error).alias(f"d{i}") for i, columns in enumerate(wanted.values())]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sketches).first()
    densities = {part: (row["n"] / row[f"d{i}"] if row[f"d{i}"] else 0.0) for i, part in enumerate(wanted)}
    return {"rows": row["n"], "rows_per_key": densities, "taken_at": time.time()}
