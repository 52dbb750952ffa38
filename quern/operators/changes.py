"""Inserts, updates and deletes as functions from rows to rows.

A table's new state is computed from its old one and the change, and published as a version of a store
(quern.sources.snapshots); nothing is altered in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialize


class DuplicateKey(ValueError):
    """Rows break a unique key."""


def _held(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # A null in a unique key equals nothing, so such rows never clash.
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole)


def _unheld(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull()
    return df.where(absent)


def rejected(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that would repeat a key of target or of an earlier row of the batch (by order)."""
    taken = target.select(*keys).distinct().withColumn("__taken", F.lit(True))
    place = Window.partitionBy(*keys).orderBy(*order)
    checked = _held(rows, keys).join(taken, list(keys), "left").withColumn("__place", F.row_number().over(place))
    return checked.where(F.col("__taken").isNotNull() | (F.col("__place") > 1)).select(*rows.columns)


def insertable(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that may be added: new keys, the first of each by order, and rows with a null key."""
    new = _held(rows, keys).join(target.select(*keys), list(keys), "left_anti").select(*rows.columns)
    place = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")
    return first.unionByName(_unheld(rows, keys))


def insert_unique(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, ignore: bool = False) -> DataFrame:
    """target with rows added. A clash is an error unless ignore, then the later row is left out."""
    if not ignore and not rejected(target, rows, keys, order).isEmpty():
        raise DuplicateKey(f"duplicate {tuple(keys)}")
    return target.unionByName(insertable(target, rows, keys, order))


def with_auto_increment(target: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows with a null key given the numbers after the largest of target and rows, in the order given.

    Numbers are dense: partitions are ranged by the order, counted, and numbered from their offset, so
    no task holds all rows. The ranged rows are written once with their partition, because another run of
    the same plan may cut the ranges elsewhere.
    """
    wanted = rows.where(F.col(key).isNull()).drop(key)
    largest = target.select(key).unionByName(rows.select(key)).agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("m"))
    spread = [F.col(c) for c in order] + [F.xxhash64(*wanted.columns).alias("__tie")]  # equal orders need not share a partition
    ranged = materialize(wanted.repartitionByRange(*spread).withColumn("__p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    offset = sizes.withColumn("__o", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = ranged.join(F.broadcast(offset), "__p").withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    given = numbered.withColumn(key, (largest.scalar() + F.col("__o") + F.col("__r")).cast("long")).select(*rows.columns)
    return rows.where(F.col(key).isNotNull()).unionByName(given)


def update_where(target: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """target with the columns of values set in rows that meet the condition; null conditions do not."""
    return target.select(*(F.when(where, values[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in values else F.col(c) for c in target.columns))


def changed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new that differ from the row of old with their key, with the names of the columns that do."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    both = b.join(a, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in rest)))
    return both.select("b.*", names.alias("changed_columns")).where(F.size("changed_columns") > 0)


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """target with rows replacing those of the same key, the last of a batch's rows for a key, and the rest added.

    A null in a key equals nothing: such rows replace none and are all added.
    """
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    newest = _held(rows, keys).withColumn("__place", F.row_number().over(last)).where("__place = 1").drop("__place")
    kept = target.join(newest.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(newest).unionByName(_unheld(rows, keys))


def delete_where(target: DataFrame, where: Column) -> DataFrame:
    """Rows that do not meet the condition; those for which it is null stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_keys(target: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*columns), list(columns), "left_anti").select(*target.columns)


def truncate(target: DataFrame) -> DataFrame:
    return target.where(F.lit(False))
