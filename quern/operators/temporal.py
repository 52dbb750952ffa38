"""Joins over ranges and time that have no equality to shuffle by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of a cell of time in the as-of join: a day for moments and dates, and as many units for numbers.
CELL = 86_400.0
#: Levels of range width told apart at most; widths double from one to the next.
LEVELS = 64


def _cell(at: str, kind: T.DataType, width: float) -> Column:
    c = F.col(at)
    if isinstance(kind, T.TimestampNTZType):
        c = F.col(at).cast("timestamp")
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(c) * F.lit(86_400.0 / width)).cast("long")
    return F.floor(c.cast("double") / F.lit(float(width))).cast("long")


def asof_join(
    left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], tie: str | None = None, prefix: str = "asof_", *, width: float = CELL
) -> DataFrame:
    """left with the values of the latest row of right of the same key at or before its moment.

    Both sides are laid into one stream per key and cell of time, `width` seconds or units long, and the
    last value seen is carried on inside it; what the earlier cells of the key end with is found from one
    row a cell and joined to the stream. So a key with most of the rows is spread over its cells, and no
    pairs are formed. Rows of left without match, key or moment keep nulls; of equal moments the greatest
    tie is the latest, then the greatest values.
    """
    kind = left.schema[at].dataType
    carried = F.struct(*(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    tied = F.col(tie) if tie else F.lit(None).cast("int")
    l = left.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(tied).schema[0].dataType).alias("__tie"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("__v"))
    kept = right.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    r = kept.select(F.col(by).alias("__by"), F.col(at).cast(kind).alias("__at"), F.lit(0).alias("__side"), tied.alias("__tie"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), carried.alias("__v"))
    cell = ["__by", "__cell"]

    ends = r.withColumn("__cell", _cell("__at", kind, width)).groupBy(*cell).agg(F.max(F.struct("__at", "__tie", "__v")).alias("__end"))
    # A cell inherits from the one before it that right has rows in: cells of left take part without a value.
    asked = l.where(F.col("__by").isNotNull() & F.col("__at").isNotNull()).withColumn("__cell", _cell("__at", kind, width)).select(*cell).distinct()
    line = ends.unionByName(asked.withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))).groupBy(*cell).agg(F.max("__end").alias("__end"))
    earlier = Window.partitionBy("__by").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    inherited = line.select(*cell, F.last("__end", ignorenulls=True).over(earlier).getField("__v").alias("__before"))

    order = [F.col("__at").asc(), F.col("__side").asc(), F.col("__tie").asc_nulls_first(), F.col("__v").asc_nulls_first()]
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stream = l.unionByName(r).withColumn("__cell", _cell("__at", kind, width))
    seen = stream.withColumn("__seen", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1").join(inherited, cell, "left")
    there = F.col("__by").isNotNull() & F.col("__at").isNotNull()
    found = seen.withColumn("__got", F.when(there, F.coalesce("__seen", "__before")))
    return found.select("__row.*", *(F.col(f"__got.v{i}").alias(f"{prefix}{v}") for i, v in enumerate(values)))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at <= high, by equality of cells and an exact check.

    A range lies in cells of about its own length, `width` times a power of two, of which it touches two at
    most; a point is looked up in the cells of the lengths that ranges have, LEVELS at most. So neither a
    very wide range nor a small width multiplies rows. Nulls join with nothing; an upside-down range holds
    nothing, nor does one that is not finite.
    """
    span = F.col(high).cast("double") - F.col(low).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(float(width))) / F.lit(float(width))))).cast("int")
    level = F.least(level, F.lit(LEVELS - 1))
    cell = lambda c: F.floor(F.col(c).cast("double") / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__l")))).cast("long")
    good = (F.col(low) <= F.col(high)) & ~F.isnan(span) & (span < F.lit(float("inf")))
    spread = ranges.where(good).withColumn("__l", level).withColumn("__b", F.explode(F.sequence(cell(low), cell(high))))
    levels = spread.agg(F.sort_array(F.collect_set("__l"))).scalar()  # LEVELS values at most
    asked = points.where(F.col(at).isNotNull()).withColumn("__l", F.explode(levels)).withColumn("__b", cell(at))
    return asked.join(spread, ["__l", "__b"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__l", "__b")
