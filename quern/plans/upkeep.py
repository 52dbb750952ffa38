"""Queries over the delivered star schema: rolling totals (p4) and orphan references (p6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.orphans import Reference, change_deltas, ledger, orphan_keys, orphan_report, orphan_rows
from quern.operators.rolling import expand_days, rolling_runs, rolling_totals
from quern.operators.versions import latest_version
from quern.sources.tables import table

REFERENCES = {
    "tpch_lineitem": Reference("tpch_lineitem", "l_orderkey", "tpch_orders", "o_orderkey", "l_orderkey", "l_linenumber"),
    "tpch_orders": Reference("tpch_orders", "o_custkey", "tpch_customer", "c_custkey", "o_orderkey"),
    "tpch_customer": Reference("tpch_customer", "c_nationkey", "tpch_nation", "n_nationkey", "c_custkey"),
    "tpch_nation": Reference("tpch_nation", "n_regionkey", "tpch_region", "r_regionkey", "n_nationkey"),
}


def orders_once(spark: SparkSession, folder: str, values: list[str]) -> DataFrame:
    return latest_version(table(spark, folder, "tpch_orders"), ["o_orderkey"], "loaded_at", values)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    orders = orders_once(spark, folder, ["o_custkey", "o_orderdate", "o_totalprice"])
    runs = rolling_runs(orders, "o_custkey", "o_orderdate", "o_totalprice", (7, 30))
    hit = runs.where((F.col("total_7") >= 600000) & (F.col("total_30") < 1200000))
    return expand_days(hit, "day").select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("case_day"))


def p4_rolling(spark: SparkSession, folder: str) -> DataFrame:
    orders = orders_once(spark, folder, ["o_custkey", "o_orderdate", "o_totalprice"])
    days = rolling_totals(orders, "o_custkey", "o_orderdate", "o_totalprice", (7, 30))
    return days.select(
        "o_custkey", "o_orderdate",
        *(F.col(f"total_{p}").cast("decimal(18,2)").alias(f"total_{p}") for p in (7, 30)),
        *(F.col(f"avg_{p}") for p in (7, 30)),
        *(F.col(f"max_{p}").cast("decimal(18,2)").alias(f"max_{p}") for p in (7, 30)),
    )


def _all_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_rows([(table(spark, folder, r.child), table(spark, folder, r.parent), r) for r in REFERENCES.values()])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _all_orphans(spark, folder).select("ref_field", "row_key", "row_line").distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_all_orphans(spark, folder))


def p6_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that are referred to and missing after all changes, with the number of live references."""
    parts = []
    for r in REFERENCES.values():
        child, parent = table(spark, folder, r.child), table(spark, folder, r.parent)
        gone = lambda df: "deleted_at" if "deleted_at" in df.columns else None
        state = ledger(
            change_deltas(child, r.field, "loaded_at", gone(child), "refs"),
            change_deltas(parent, r.parent_key, "loaded_at", gone(parent), "exist"),
        )
        parts.append(orphan_keys(state).select(F.lit(r.field).alias("ref_field"), F.col("key").alias("missing_key"), F.col("refs").alias("live_references")))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p4_found": p4_found, "p4_rolling": p4_rolling, "p6_found": p6_found, "p6_report": p6_report, "p6_ledger": p6_ledger}

#: Orders counted once: the row with the latest loaded_at.
ORDERS_ONCE = """o AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY loaded_at DESC, o_custkey, o_orderdate, o_totalprice) AS rn FROM tpch_orders)
  WHERE rn = 1)"""

_DAYS = f"""WITH {ORDERS_ONCE},
d AS (SELECT o_custkey, o_orderdate, coalesce(sum(o_totalprice), 0) AS t, count(o_totalprice) AS n, max(o_totalprice) AS m
      FROM o WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL),
span AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) + 29 AS b FROM d GROUP BY ALL),
cal AS (SELECT o_custkey, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM span),
w AS (SELECT c.o_custkey, c.day,
  coalesce(sum(t) OVER w7, 0) AS t7, coalesce(sum(n) OVER w7, 0) AS n7, max(m) OVER w7 AS m7,
  coalesce(sum(t) OVER w30, 0) AS t30, coalesce(sum(n) OVER w30, 0) AS n30, max(m) OVER w30 AS m30
  FROM cal c LEFT JOIN d ON d.o_custkey = c.o_custkey AND d.o_orderdate = c.day
  WINDOW w7 AS (PARTITION BY c.o_custkey ORDER BY c.day ROWS 6 PRECEDING), w30 AS (PARTITION BY c.o_custkey ORDER BY c.day ROWS 29 PRECEDING))
"""


def _orphan_sql(r: Reference) -> str:
    line = f"c.{r.row_line}" if r.row_line else "0"
    return f"""SELECT '{r.field}' AS ref_field, c.{r.row_key}::BIGINT AS row_key, {line}::INTEGER AS row_line, c.loaded_at
  FROM {r.child} c WHERE c.{r.field} IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM {r.parent} p WHERE p.{r.parent_key} = c.{r.field} AND p.loaded_at <= c.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > c.loaded_at))"""


_ORPHANS = " UNION ALL ".join(_orphan_sql(r) for r in REFERENCES.values())


def _ledger_sql(r: Reference) -> str:
    alive = "" if r.child == "tpch_lineitem" else "AND deleted_at IS NULL"
    return f"""SELECT '{r.field}' AS ref_field, {r.field}::BIGINT AS missing_key, count(*)::BIGINT AS live_references FROM {r.child}
  WHERE {r.field} IS NOT NULL {alive} AND {r.field} NOT IN (SELECT {r.parent_key} FROM {r.parent} WHERE deleted_at IS NULL AND {r.parent_key} IS NOT NULL) GROUP BY ALL"""


ORACLES = {
    "p4_found": _DAYS + "SELECT o_custkey, strftime(day, '%Y-%m-%d') AS case_day FROM w WHERE t7 >= 600000 AND t30 < 1200000",
    "p4_rolling": _DAYS
    + """SELECT o_custkey, day AS o_orderdate, t7::DECIMAL(18,2) AS total_7, t30::DECIMAL(18,2) AS total_30,
  CASE WHEN n7 > 0 THEN t7::DOUBLE / n7 END AS avg_7, CASE WHEN n30 > 0 THEN t30::DOUBLE / n30 END AS avg_30,
  m7::DECIMAL(18,2) AS max_7, m30::DECIMAL(18,2) AS max_30 FROM w""",
    "p6_found": f"SELECT DISTINCT ref_field, row_key, row_line FROM ({_ORPHANS})",
    "p6_report": f"SELECT ref_field, strftime(loaded_at, '%Y-%m') AS loaded_month, count(*)::BIGINT AS orphan_rows FROM ({_ORPHANS}) GROUP BY ALL",
    "p6_ledger": " UNION ALL ".join(_ledger_sql(r) for r in REFERENCES.values()),
}
