"""Distinct counts from the k smallest hash values of a group.

A sketch in long form is at most k rows (group, h) with h the signed 64-bit hash of an item. Sketches of
parts, days or groups are put together by taking the k smallest of what they hold. Fewer than k values
mean that the count is exact (but for equal hashes of 64 bits); otherwise the k-th smallest says how
densely the hash range is filled. Sets are combined below the smaller of their k-th values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values kept; relative standard error 1 / sqrt(K - 2) beyond K items, so 1.6 % here.
K = 4096
#: Half width of the confidence interval in standard errors (95 %).
Z = 1.96
#: Rows looked at together before a partition's sketches are cut again.
BLOCK_ROWS = 200_000
#: Pieces in which a group's sketches are put together before the last step, which so gets SALTS * k values of a group.
SALTS = 32


def item_hash(*columns: str) -> Column:
    """Hash of an item; null if any part of it is null."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, F.xxhash64(*columns))


def smallest_values(table: pa.Table, k: int) -> pa.Table:
    """The rows with the k smallest different values of the last column for each value of the others; a null is the largest."""
    rows = table.num_rows
    if not rows:
        return table
    code = np.zeros(rows, dtype="int64")
    for name in table.column_names[:-1]:
        column = table[name].combine_chunks()
        part = (column if pa.types.is_dictionary(column.type) else column.dictionary_encode(null_encoding="encode")).indices.to_numpy(zero_copy_only=False)
        code = np.unique(code * (int(part.max()) + 1) + part, return_inverse=True)[1]
    h = table[table.column_names[-1]].combine_chunks()
    missing = h.is_null().to_numpy(zero_copy_only=False)
    value = h.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((value, missing, code))
    code, missing, value = code[order], missing[order], value[order]
    first = np.r_[True, code[1:] != code[:-1]]
    new = first | np.r_[True, (value[1:] != value[:-1]) | (missing[1:] != missing[:-1])]
    place = np.cumsum(new)
    start = np.maximum.accumulate(np.where(first, place, 0))
    return table.take(pa.array(order[new & (place - start < k)]))


def _cut(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                kept = smallest_values(pa.Table.from_batches(held), k)
                if kept.num_rows > BLOCK_ROWS // 2:  # many groups: holding on to them would save little
                    yield from kept.to_batches()
                    kept = kept.slice(0, 0)
                held, size = kept.to_batches(), kept.num_rows
        if held:
            yield from smallest_values(pa.Table.from_batches(held), k).to_batches()

    return run


def _smallest(hashes: DataFrame, groups: list[str], k: int) -> DataFrame:
    # Each partition keeps its k smallest different values of a group, so no more than that is shuffled whatever the
    # input; a group's values meet in SALTS pieces first, which keep k each, and only those are ranked together.
    local = hashes.select(*groups, "h")
    cut = local.mapInArrow(_cut(k), local.schema)
    pieces = cut.repartition(*groups, F.pmod(F.coalesce("h", F.lit(0)), F.lit(SALTS))).mapInArrow(_cut(k), local.schema)
    order = Window.partitionBy(*groups).orderBy(F.col("h").asc_nulls_last())
    placed = pieces.withColumn("__r", F.dense_rank().over(order)).withColumn("__n", F.row_number().over(order)).withColumn("__b", F.lag("h").over(order))
    return placed.where((F.col("__r") <= k) & ((F.col("__n") == 1) | ~F.col("h").eqNullSafe(F.col("__b")))).drop("__r", "__n", "__b")


def sketch(df: DataFrame, groups: list[str], items: list[str], k: int = K) -> DataFrame:
    """(groups, h): the k smallest hashes of each group.

    Null items are not counted; a group that has only those keeps one row with a null h. Null groups are
    groups. An empty table has no groups.
    """
    return _smallest(df.select(*groups, item_hash(*items).alias("h")), groups, k)


def merge(sketches: DataFrame, groups: list[str], k: int = K) -> DataFrame:
    """Sketches of parts or of finer groups, put together to the given groups."""
    return _smallest(sketches, groups, k)


def pack(sketches: DataFrame, groups: list[str], k: int = K) -> DataFrame:
    """(groups, hashes, theta): one row a group; theta null while the sketch holds every item."""
    hashes = F.array_sort(F.collect_list("h"))
    full = sketches.groupBy(*groups).agg(hashes.alias("hashes"))
    theta = F.when(F.size("hashes") >= k, F.element_at("hashes", k))
    return full.withColumn("theta", theta).withColumn("hashes", F.when(F.col("theta").isNull(), F.col("hashes")).otherwise(F.slice("hashes", 1, k - 1)))


def share_below(theta: Column) -> Column:
    """The part of the hash range below theta; 1 if theta is null."""
    return F.coalesce((theta.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64), F.lit(1.0))


def estimates(count: Column, theta: Column, name: str) -> list[Column]:
    """Estimate and bounds from the number of values kept below theta: each item is kept with its share's
    probability, so the count kept is binomial and the bounds are Wilson's for it. Exact when theta is null."""
    p = share_below(theta)
    c = count.cast("double")
    z2 = F.lit(Z * Z)
    spread = F.lit(Z) * F.sqrt((c + z2 / 4) * (F.lit(1.0) - p))
    low = F.greatest(c, (c + z2 / 2 * (F.lit(1.0) - p) - spread) / p)
    high = (c + z2 / 2 * (F.lit(1.0) - p) + spread) / p
    return [
        F.round(c / p).cast("long").alias(name),
        F.when(theta.isNull(), count.cast("long")).otherwise(F.floor(low)).cast("long").alias(f"{name}_low"),
        F.when(theta.isNull(), count.cast("long")).otherwise(F.ceil(high)).cast("long").alias(f"{name}_high"),
    ]


def distinct_counts(sketches: DataFrame, groups: list[str], k: int = K, name: str = "distinct_items") -> DataFrame:
    """Estimate and confidence bounds of each group."""
    summary = sketches.groupBy(*groups).agg(F.count("h").alias("__c"), F.max("h").alias("__m"))
    theta = F.when(F.col("__c") >= k, F.col("__m"))
    kept = F.when(theta.isNull(), F.col("__c")).otherwise(F.col("__c") - 1)
    return summary.select(*groups, *estimates(kept, theta, name))


def compare(packed: DataFrame, left_on: Column, right_on: Column, name_left: str, name_right: str) -> DataFrame:
    """Union, intersection and difference of two sets of a packed table, with bounds: one row.

    Each condition names one row of packed; a set that is not there is empty.
    """
    held = F.struct("hashes", "theta")
    both = packed.agg(F.max(F.when(left_on, held)).alias("l"), F.max(F.when(right_on, held)).alias("r")).select(
        F.lit(name_left).alias("set_a"), F.lit(name_right).alias("set_b"),
        F.coalesce("l.hashes", F.array().cast("array<bigint>")).alias("__a"), F.col("l.theta").alias("__ta"),
        F.coalesce("r.hashes", F.array().cast("array<bigint>")).alias("__b"), F.col("r.theta").alias("__tb"),
    )
    theta = F.least(F.coalesce("__ta", "__tb"), F.coalesce("__tb", "__ta"))
    below = lambda hashes: F.when(F.col("__t").isNull(), hashes).otherwise(F.filter(hashes, lambda h: h < F.col("__t")))
    ready = both.withColumn("__t", theta)
    sized = lambda hashes: F.size(below(hashes))
    columns: list[Column] = []
    for name, hashes in (
        ("in_union", F.array_union("__a", "__b")),
        ("in_both", F.array_intersect("__a", "__b")),
        ("only_a", F.array_except("__a", "__b")),
    ):
        columns += estimates(sized(hashes), F.col("__t"), name)
    return ready.select("set_a", "set_b", *columns)
