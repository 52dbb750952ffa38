"""References to records that do not exist, from signed counts of changes.

Every change of a table is a delta: a row that comes adds one reference to the key it names and one
existence of its own key; a row that goes takes both back. Counts per key add up in any order, so the
state of many days is the sum of their deltas, and a key with references but no existence is an orphan.
For the question "was the parent there when the child came" the same ledger is kept by day: references
that came on a day on which their key's existence count was zero throughout are orphans, and only on days
on which it changed between them the deltas are looked at one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.skew import join_counted, salts
from quern.session import materialize


@dataclass(frozen=True)
class Reference:
    """child.field names parent.parent_key; row_key and row_line identify the child's row."""

    child: str
    field: str
    parent: str
    parent_key: str
    row_key: str
    row_line: str | None = None


def change_deltas(df: DataFrame, key: str, loaded: str, deleted: str | None, count: str) -> DataFrame:
    """(key, at, count): +1 when a row comes, -1 when it goes. Null keys are left out.

    A row removed before it came is taken back at once, so that no moment sees a negative count of it.
    """
    base = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(loaded).alias("__in"), (F.col(deleted) if deleted else F.lit(None).cast("timestamp_ntz")).alias("__out")
    )
    steps = F.array(
        F.struct(F.col("__in").alias("at"), F.lit(1).cast("long").alias("d")),
        F.struct(F.greatest("__in", "__out").alias("at"), F.when(F.col("__out").isNotNull(), F.lit(-1)).cast("long").alias("d")),
    )
    return base.select("key", F.inline(steps)).where(F.col("d").isNotNull()).select("key", "at", F.col("d").alias(count))


def ledger(references: DataFrame, existences: DataFrame) -> DataFrame:
    """(key, refs, exist): the state after these deltas. Each side is combined per key before it is shuffled."""
    both = references.select("key", F.col("refs"), F.lit(0).cast("long").alias("exist")).unionByName(
        existences.select("key", F.lit(0).cast("long").alias("refs"), F.col("exist"))
    )
    return both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"))


def merge_ledgers(*states: DataFrame) -> DataFrame:
    """The state of several periods or parts: counts of equal keys add up."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    return whole.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return state.where((F.col("refs") > 0) & (F.col("exist") <= 0)).select("key", "refs")


#: What a cell of the ledger says about the references that came in it.
ALL_ORPHANS, MIXED = "all", "mixed"


def dated_ledger(references: DataFrame, existences: DataFrame) -> DataFrame:
    """The ledger by key and day: (ref, key, day, refs, exist, had_refs, had, first_in, first_out, first_ref, last_ref).

    references and existences are signed deltas (ref, key, at, refs) and (ref, key, at, exist), ref telling
    the keys of one table from those of another. refs and exist are what the day changed, had_refs and had
    the counts it began with; the moments are the day's first existence won and lost and its first and last
    reference won. Deltas are summed per key and day on the map side, so a key with any number of them has
    a row a day, and only those are carried on in order of time. Deltas without a moment are left out.
    """
    none = F.lit(None).cast("long")
    both = references.select("ref", "key", "at", "refs", none.alias("exist")).unionByName(existences.select("ref", "key", "at", none.alias("refs"), "exist"))
    cells = (
        both.where(F.col("at").isNotNull())
        .groupBy("ref", "key", F.col("at").cast("date").alias("day"))
        .agg(
            F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"),
            F.coalesce(F.sum("exist"), F.lit(0)).alias("exist"),
            F.min(F.when(F.col("exist") > 0, F.col("at"))).alias("first_in"),
            F.min(F.when(F.col("exist") < 0, F.col("at"))).alias("first_out"),
            F.min(F.when(F.col("refs") > 0, F.col("at"))).alias("first_ref"),
            F.max(F.when(F.col("refs") > 0, F.col("at"))).alias("last_ref"),
        )
    )
    before = Window.partitionBy("ref", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("had_refs", F.coalesce(F.sum("refs").over(before), F.lit(0))).withColumn("had", F.coalesce(F.sum("exist").over(before), F.lit(0)))


def doubtful_cells(dated: DataFrame) -> DataFrame:
    """(ref, key, day, refs, had, verdict): the cells in which references came while their key may not have existed.

    A cell whose key existed from its first reference to its last is left out; one whose key did not exist
    before its last is "all"; in the others ("mixed") the order within the day decides.
    """
    there_first = (F.col("had") > 0) | (F.col("first_in") <= F.col("first_ref"))
    stayed = F.col("first_out").isNull() | (F.col("first_out") > F.col("last_ref"))
    never = (F.col("had") <= 0) & (F.col("first_in").isNull() | (F.col("first_in") > F.col("last_ref")))
    verdict = F.when(never, ALL_ORPHANS).when(~(F.coalesce(there_first, F.lit(False)) & stayed), MIXED)
    return dated.where(F.col("first_ref").isNotNull()).withColumn("verdict", verdict).where(F.col("verdict").isNotNull()).select("ref", "key", "day", "refs", "had", "verdict")


def orphan_rows(sources: list[tuple[DataFrame, DataFrame, Reference]], loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """Rows whose parent was not there when they were loaded, as (ref_field, row_key, row_line, loaded_at).

    sources are (child, parent, reference); all go through one ledger, told apart by their field. A row
    without a reference is no case, one without a moment always is. Rows delivered again appear as often as
    they are cases. Parents may repeat, go and come back; those with a null key or moment exist for nobody.
    An empty parent makes every reference an orphan. Only the columns named are read; clashing names do no
    harm.

    The ledger's doubtful cells, few beside the rows, are written once and joined to the rows that
    came in them, a key that holds many of those cut into pieces; in mixed cells existence and reference
    deltas are then run through in order of time, existence first where moments are equal.
    """
    rows, deltas = [], []
    for at, (child, parent, r) in enumerate(sources):
        gone = deleted if deleted in parent.columns else None
        number = F.lit(at).cast("tinyint").alias("ref")
        deltas.append(change_deltas(parent, r.parent_key, loaded, gone, "exist").select(number, "key", "at", "exist"))
        rows.append(
            child.where(F.col(r.field).isNotNull()).select(
                number,
                F.col(r.field).cast("long").alias("key"),
                F.col(r.row_key).cast("long").alias("row_key"),
                (F.col(r.row_line).cast("int") if r.row_line else F.lit(0)).alias("row_line"),
                F.col(loaded).alias("at"),
            )
        )
    references, existences = reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, deltas)
    counted = references.select("ref", "key", "at", F.lit(1).cast("long").alias("refs"))
    doubtful = materialize(doubtful_cells(dated_ledger(counted, existences)), "doubtful")
    total = int(doubtful.agg(F.coalesce(F.sum("refs"), F.lit(0))).first()[0])

    cell = ["ref", "key", "day"]
    came = references.withColumn("day", F.col("at").cast("date"))
    met = join_counted(came, doubtful, cell, "refs", total, ["row_key", "row_line"])
    wanted = ["ref", "row_key", "row_line", "at"]
    certain = met.where(F.col("verdict") == ALL_ORPHANS).select(*wanted)
    mixed = doubtful.where(F.col("verdict") == MIXED).select(*cell, "had", F.explode(F.sequence(F.lit(0), salts(F.col("refs"), total) - 1)).alias("__salt"))
    moved = existences.where(F.col("at").isNotNull()).withColumn("day", F.col("at").cast("date")).join(mixed, cell)
    piece = [*cell, "__salt"]
    line = moved.select(*piece, "at", F.lit(0).alias("kind"), "had", "exist", F.lit(None).cast("long").alias("row_key"), F.lit(None).cast("int").alias("row_line")).unionByName(
        met.where(F.col("verdict") == MIXED).select(*piece, "at", F.lit(1).alias("kind"), "had", F.lit(0).cast("long").alias("exist"), "row_key", "row_line")
    )
    so_far = Window.partitionBy(*piece).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    decided = line.withColumn("now", F.col("had") + F.sum("exist").over(so_far)).where((F.col("kind") == 1) & (F.col("now") <= 0)).select(*wanted)
    undated = references.where(F.col("at").isNull()).select(*wanted)
    fields = F.array(*(F.lit(r.field) for _, _, r in sources))
    found = certain.unionByName(decided).unionByName(undated)
    return found.select(F.get(fields, F.col("ref").cast("int")).alias("ref_field"), "row_key", "row_line", F.col("at").alias("loaded_at"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan rows counted by reference and month of loading."""
    month = F.date_format("loaded_at", "yyyy-MM")
    return orphans.groupBy("ref_field", month.alias("loaded_month")).agg(F.count(F.lit(1)).alias("orphan_rows"))
