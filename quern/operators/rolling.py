"""Totals over trailing periods, days without activity included.

Amounts are first summed per entity and day on the map side, so an entity holds at most one row a day
however many rows it has; then each entity's days pass, sorted, through one two-stack queue per period.
The queue keeps a monoid (total, count, least, greatest): nothing is ever subtracted, so least and
greatest, which have no inverse, cost the same as totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Element = tuple[int, int, Any, Any]
EMPTY: Element = (0, 0, None, None)


def combine(a: Element, b: Element) -> Element:
    """The monoid: totals and counts add, least and greatest are kept; EMPTY is neutral."""
    if not a[1]:
        return b
    if not b[1]:
        return a
    return a[0] + b[0], a[1] + b[1], a[2] if a[2] <= b[2] else b[2], a[3] if a[3] >= b[3] else b[3]


class WindowQueue:
    """First in, first out, with the combination of everything inside at hand in constant time.

    The back stack has a running aggregate; the front stack holds, with each element, the aggregate of
    itself and all that came after it there. When the front runs dry the back is turned over onto it.
    """

    __slots__ = ("back", "back_total", "days", "front")

    def __init__(self, days: int) -> None:
        self.days = days
        self.clear()

    def clear(self) -> None:
        self.front: list[tuple[int, Element]] = []
        self.back: list[tuple[int, Element]] = []
        self.back_total = EMPTY

    def push(self, day: int, element: Element) -> None:
        self.back.append((day, element))
        self.back_total = combine(self.back_total, element)

    def oldest(self) -> int | None:
        if self.front:
            return self.front[-1][0]
        return self.back[0][0] if self.back else None

    def evict(self, today: int) -> None:
        """Drop what is dated today - days or before."""
        edge = today - self.days
        while True:
            if not self.front:
                if not self.back or self.back[0][0] > edge:
                    return
                total = EMPTY
                while self.back:
                    day, element = self.back.pop()
                    total = combine(element, total)
                    self.front.append((day, total))
                self.back_total = EMPTY
            if self.front[-1][0] > edge:
                return
            self.front.pop()

    def total(self) -> Element:
        return combine(self.front[-1][1], self.back_total) if self.front else self.back_total


def _runs(batches: Iterator[pd.DataFrame], periods: list[int], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of days over which every window stays the same, from sorted (entity, day, element) rows."""
    queues = [WindowQueue(p) for p in periods]
    out: list[tuple] = []
    entity: Any = None
    at: int | None = None  # first day of the run that is open

    def drain(until: int | None) -> None:
        """Emit the runs that end before day `until`; None empties the queues."""
        nonlocal at
        while at is not None:
            leaves = [q.oldest() + q.days for q in queues if q.oldest() is not None]
            change = min(leaves) if leaves else None
            if change is None:
                if until is not None and at < until:
                    out.append((entity, at, until - 1, *(x for _ in queues for x in EMPTY)))
                at = until
                return
            end = change if until is None else min(change, until)
            if end > at:
                out.append((entity, at, end - 1, *(x for q in queues for x in q.total())))
            at = end
            if until is not None and end == until:
                return
            for q in queues:
                q.evict(end)

    for pdf in batches:
        for name, day, total, count, least, most in zip(*(pdf[c].tolist() for c in ("__e", "__d", "__t", "__n", "__lo", "__hi")), strict=True):
            if at is None or name != entity:
                drain(None)
                for q in queues:
                    q.clear()
                entity, at = name, day
            else:
                drain(day)
            element = (total, count, least, most) if count else EMPTY
            for q in queues:
                q.evict(day)
                q.push(day, element)
        if len(out) >= 50_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    drain(None)
    if out:
        yield pd.DataFrame(out, columns=columns)


def rolling_runs(df: DataFrame, entity: str, day: str, amount: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per entity the runs of calendar days from its first day to max(periods) - 1 days after its last.

    Columns: entity, from_day, to_day and for each period p total_p, count_p, avg_p, min_p, max_p over the
    days D-p+1 to D. amount is a decimal or an integer; the sums are exact. A null amount adds nothing but
    makes the day one with activity; a row without entity or day is left out. An empty period has total 0,
    count 0 and null for the rest. avg_p is the mean of the amounts inside, not of days.
    Extra columns are pruned. The entity may be of any type that orders.
    """
    scale, kind = 0, df.schema[amount].dataType
    if isinstance(kind, T.DecimalType):
        scale = kind.scale
    elif not isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        raise TypeError(f"{amount} must be a decimal or an integer, not {kind.simpleString()}")
    units = (F.col(amount).cast("decimal(38,6)") * F.lit(10**scale)).cast("long") if scale else F.col(amount).cast("long")
    daily = (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .select(F.col(entity).alias("__e"), F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).alias("__d"), units.alias("__u"))
        .groupBy("__e", "__d")
        .agg(
            F.coalesce(F.sum("__u"), F.lit(0)).cast("long").alias("__t"),
            F.count("__u").alias("__n"),
            F.coalesce(F.min("__u"), F.lit(0)).cast("long").alias("__lo"),
            F.coalesce(F.max("__u"), F.lit(0)).cast("long").alias("__hi"),
        )
    )
    columns = ["__e", "__from", "__to", *(f"__{x}{p}" for p in periods for x in "tnlh")]
    schema = T.StructType(
        [T.StructField("__e", df.schema[entity].dataType), T.StructField("__from", T.IntegerType()), T.StructField("__to", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in columns[3:]]
    )
    spans = list(periods)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(batches, spans, columns):
            yield pdf.astype({c: "Int64" for c in columns[3:]})

    runs = daily.repartition("__e").sortWithinPartitions("__e", "__d").mapInPandas(run, schema)
    money = f"decimal(38,{scale})"
    plain = lambda c: (F.col(c).cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(10,0)")).cast(money) if scale else F.col(c)
    picked = [F.col("__e").alias(entity), F.date_add(F.lit("1970-01-01").cast("date"), F.col("__from")).alias("from_day"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("__to")).alias("to_day")]
    for p in spans:
        picked += [
            plain(f"__t{p}").alias(f"total_{p}"),
            F.col(f"__n{p}").alias(f"count_{p}"),
            F.when(F.col(f"__n{p}") > 0, plain(f"__t{p}").cast("double") / F.col(f"__n{p}")).alias(f"avg_{p}"),
            plain(f"__l{p}").alias(f"min_{p}"),
            plain(f"__h{p}").alias(f"max_{p}"),
        ]
    return runs.select(*picked)


def expand_days(runs: DataFrame, day: str) -> DataFrame:
    """One row per calendar day of each run."""
    rest = [c for c in runs.columns if c not in ("from_day", "to_day")]
    return runs.select(*rest, F.explode(F.sequence("from_day", "to_day")).alias(day))


def rolling_totals(df: DataFrame, entity: str, day: str, amount: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """rolling_runs with one row for every entity and calendar day, days without activity included."""
    return expand_days(rolling_runs(df, entity, day, amount, periods), day)
