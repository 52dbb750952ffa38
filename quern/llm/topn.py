"""The N best items of every group, by partition lower bounds.

The N-th best item of a group within any block of rows is a lower bound of the group's true N-th best.
Blocks are looked through where they lie; per group the highest of their bounds is joined back, and only
rows at or above it are shuffled and ranked. Of a group spread over B blocks at most N * B rows survive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import materialize

#: Rows looked at together; memory of a task is a few times this.
BLOCK_ROWS = 200_000
#: Bounds that are broadcast at most. Groups without one are small beside the whole and are ranked as they are.
MAX_BOUNDS = 50_000


def block_bounds(batch: pa.Table, n: int) -> pa.Table:
    """(g, s, t, rows): per group with n or more rows its n-th best in this block; s falls, t rises."""
    ok = pc.is_valid(batch["t"])
    if pa.types.is_floating(batch.schema.field("s").type):
        ok = pc.and_(ok, pc.invert(pc.is_nan(batch["s"])))  # a bound from part of the rows is still a bound
    batch = batch.filter(ok)
    order = pc.sort_indices(batch, sort_keys=[("g", "ascending"), ("s", "descending"), ("t", "ascending")])
    batch = batch.take(order)
    if not len(batch):
        return batch.append_column("rows", pa.array([], pa.int64()))
    codes = batch["g"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    lengths = np.diff(np.r_[starts, len(codes)])
    full = lengths >= n
    return batch.take(pa.array(starts[full] + n - 1)).append_column("rows", pa.array(lengths[full], pa.int64()))


def partition_bounds(df: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bounds of every block of df(g, s, t), found without a shuffle."""
    schema = T.StructType([*df.schema.fields, T.StructField("rows", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block_rows:
                yield from block_bounds(pa.Table.from_batches(held), n).to_batches()
                held, size = [], 0
        if held:
            yield from block_bounds(pa.Table.from_batches(held), n).to_batches()

    return df.mapInArrow(run, schema)


def top_n_per_group(
    df: DataFrame, group: str, score: str, tie: str, n: int, *, block_rows: int = BLOCK_ROWS, max_bounds: int = MAX_BOUNDS
) -> DataFrame:
    """The n rows of each group with the highest score, equal scores by the smaller tie; with their rank.

    Rows with a null score are no candidates; rows with a null group form a group of their own; a null tie
    comes first among equals; NaN is the highest score, as Spark orders it. Groups with fewer than n rows
    keep all of them. Rows equal in score and tie share the places left among them, each counted. All
    columns of df are kept, whatever their names. An empty table gives an empty one.

    Bounds are broadcast for at most max_bounds groups: those that hold the largest shares of the rows.
    With T rows in groups that have a bound, only groups of T / max_bounds rows or more are taken, so
    there can be no more than max_bounds of them; the others are too small to need one.
    """
    work = df.where(F.col(score).isNotNull())
    keys = work.select(F.col(group).alias("g"), F.col(score).alias("s"), F.col(tie).alias("t"))
    # Read twice below; one row a block and group of n rows or more.
    local = materialize(partition_bounds(keys, n, block_rows), "bounds")
    best = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("t").asc())
    sizes = Window.partitionBy("g")
    bounds = local.select("*", F.row_number().over(best).alias("r"), F.sum("rows").over(sizes).alias("held")).where("r = 1")
    limit = local.agg(F.coalesce(F.sum("rows"), F.lit(0)) / F.lit(max_bounds)).scalar()
    heavy = bounds.where(F.col("held") >= limit).select(F.col("g").alias("__g"), F.col("s").alias("__s"), F.col("t").alias("__t"))

    joined = work.join(F.broadcast(heavy), F.col(group).eqNullSafe(F.col("__g")), "left")
    above = (F.col(score) > F.col("__s")) | ((F.col(score) == F.col("__s")) & (F.col(tie).isNull() | (F.col(tie) <= F.col("__t"))))
    survivors = joined.where(F.col("__s").isNull() | above).drop("__g", "__s", "__t")
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc_nulls_first())
    return survivors.withColumn("rank_in_group", F.row_number().over(order)).where(F.col("rank_in_group") <= n)
