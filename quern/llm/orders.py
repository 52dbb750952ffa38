"""Queries p1, p2 and p3 over orders and lines, each delivery counted once."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kmv, logsketch
from quern.llm.topn import top_n_per_group
from quern.operators.versions import latest_version
from quern.plans.upkeep import ORDERS_ONCE
from quern.session import materialize
from quern.sources.tables import table

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
#: The priorities an order may have; every two of them are compared.
PRIORITIES = ["1-RUSH", "2-FAST", "3-USUAL", "4-SLACK", "5-UNSET"]
PAIRS = list(combinations(PRIORITIES, 2))


def _priced_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders once each, written: the operator reads them for the bounds and for the ranks."""
    orders = latest_version(table(spark, folder, "tpch_orders"), ["o_orderkey"], "loaded_at", ["o_custkey", "o_totalprice"])
    return materialize(orders.select("o_custkey", "o_totalprice", "o_orderkey"), "orders")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    orders = _priced_orders(spark, folder).where(F.col("o_custkey").isNotNull())
    return top_n_per_group(orders, "o_custkey", "o_totalprice", "o_orderkey", 3).select("o_custkey", "o_orderkey")


def p1_ranked(spark: SparkSession, folder: str) -> DataFrame:
    best = top_n_per_group(_priced_orders(spark, folder), "o_custkey", "o_totalprice", "o_orderkey", 3)
    return best.select("o_custkey", "o_orderkey", "o_totalprice", "rank_in_group")


def _placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = latest_version(table(spark, folder, "tpch_orders"), ["o_orderkey"], "loaded_at", ["o_custkey", "o_orderdate", "o_orderpriority"])
    return orders.select(F.col("o_orderdate").alias("order_day"), F.upper(F.trim("o_orderpriority")).alias("priority"), "o_custkey")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    orders = _placed_orders(spark, folder).dropna()
    groups = ["order_day", "priority"]
    counted = kmv.distinct_counts(kmv.sketch(orders, groups, ["o_custkey"]), groups, name="customers")
    busy = orders.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_orders")).where("n_orders >= 40")
    return (
        counted.join(busy, groups)
        .where(F.col("customers") * 2 <= F.col("n_orders"))
        .select(F.date_format("order_day", "yyyy-MM-dd").alias("order_day"), "priority")
    )


def p2_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Customers per day, priority and both; the coarser sketches are put together from the finest."""
    fine = materialize(kmv.sketch(_placed_orders(spark, folder), ["order_day", "priority"], ["o_custkey"]), "sketch")
    parts = []
    for level, groups in (("day and priority", ["order_day", "priority"]), ("day", ["order_day"]), ("priority", ["priority"])):
        of_level = fine if len(groups) == 2 else kmv.merge(fine, groups)
        counted = kmv.distinct_counts(of_level, groups, name="customers")
        whole = {"order_day": F.date_format("order_day", "yyyy-MM-dd"), "priority": F.col("priority")}
        columns = [(whole[c] if c in groups else F.lit(None).cast("string")).alias(c) for c in whole]
        parts.append(counted.select(F.lit(level).alias("level"), *columns, "customers", "customers_low", "customers_high"))
    return reduce(DataFrame.unionByName, parts)


def p2_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of every two priorities: in either, in both, only in the first. Orders without a date count too."""
    placed = _placed_orders(spark, folder).dropna(subset=["priority", "o_custkey"])
    packed = materialize(kmv.pack(kmv.sketch(placed, ["priority"], ["o_custkey"]), ["priority"]), "packed")
    return reduce(DataFrame.unionByName, [kmv.compare(packed, F.col("priority") == a, F.col("priority") == b, a, b) for a, b in PAIRS])


def _day_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """(day, l_returnflag, l_linestatus, sign, bucket, n): bucket counts of the prices of each day, each line once.

    Flags are trimmed, in upper case, blank as null.
    """
    lines = latest_version(table(spark, folder, "tpch_lineitem"), ["l_orderkey", "l_linenumber"], "loaded_at", ["l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice"])
    clean = lambda c: F.when(F.trim(c) != "", F.upper(F.trim(c))).alias(c)
    named = lines.select(F.col("l_shipdate").alias("day"), clean("l_returnflag"), clean("l_linestatus"), "l_extendedprice")
    return logsketch.bucket_counts(named, ["day", "l_returnflag", "l_linestatus"], "l_extendedprice")


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of price per flag, status and both over all days, and per both for each day and month of shipping.

    The counts of days are partial results: months and the whole are put together from them, in one pass.
    Lines without a day count in the whole and have a day and month of null.
    """
    day, flag, status, none = F.date_format("day", "yyyy-MM-dd"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(None).cast("string")
    levels = {
        "flag and status": [none, flag, status], "flag": [none, flag, none], "status": [none, none, status],
        "day, flag and status": [day, flag, status], "month, flag and status": [F.date_format("day", "yyyy-MM"), flag, status],
    }
    groups = ["period", "l_returnflag", "l_linestatus"]
    counts = logsketch.group_levels(_day_sketch(spark, folder), groups, levels)
    found = logsketch.percentiles(counts, ["level", *groups], QUANTILES)
    return found.select("level", *groups, "quantile", F.round("value", 4).alias("price"), "n_values")


def p3_days(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of price per status for each day of shipping and for the months put together from the days' counts."""
    counts = logsketch.group_levels(
        _day_sketch(spark, folder),
        ["period", "l_linestatus"],
        {"day": [F.date_format("day", "yyyy-MM-dd"), F.col("l_linestatus")], "month": [F.date_format("day", "yyyy-MM"), F.col("l_linestatus")]},
    )
    found = logsketch.percentiles(counts, ["level", "period", "l_linestatus"], [0.5, 0.95])
    return found.select("level", "period", "l_linestatus", "quantile", F.round("value", 4).alias("price"), "n_values")


def p3_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """The days' bucket counts themselves, as they would be kept and added up later."""
    return _day_sketch(spark, folder).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


QUERIES = {
    "p1_found": p1_found, "p1_ranked": p1_ranked, "p2_found": p2_found, "p2_distinct": p2_distinct, "p2_sets": p2_sets, "p3_percentiles": p3_percentiles, "p3_days": p3_days, "p3_sketch": p3_sketch,
}

_PLACED = f"""WITH {ORDERS_ONCE}, s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_day, upper(trim(o_orderpriority)) AS priority, o_custkey FROM o)
"""


def _level_sql(level: str, day: str, priority: str) -> str:
    return f"""SELECT '{level}' AS level, {day} AS order_day, {priority} AS priority, count(DISTINCT o_custkey)::BIGINT AS customers,
  count(DISTINCT o_custkey)::BIGINT AS customers_low, count(DISTINCT o_custkey)::BIGINT AS customers_high FROM s GROUP BY ALL"""


def _sets_sql(a: str, b: str) -> str:
    def triple(name: str, sets: str) -> str:
        n = f"(SELECT count(*) FROM ({sets}))::BIGINT"
        return f"{n} AS {name}, {n} AS {name}_low, {n} AS {name}_high"

    x, y = (f"SELECT o_custkey FROM full_rows WHERE priority = '{p}'" for p in (a, b))
    return f"SELECT '{a}' AS set_a, '{b}' AS set_b, {triple('in_union', f'{x} UNION {y}')}, {triple('in_both', f'{x} INTERSECT {y}')}, {triple('only_a', f'{x} EXCEPT {y}')}"


_G = repr(logsketch.gamma())
_LINES = """WITH keyed AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, upper(nullif(trim(l_returnflag), '')) AS f, upper(nullif(trim(l_linestatus), '')) AS s, l_extendedprice::DOUBLE AS x FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY loaded_at DESC) AS rn FROM tpch_lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) WHERE rn = 1
  UNION ALL
  SELECT strftime(l_shipdate, '%Y-%m-%d'), upper(nullif(trim(l_returnflag), '')), upper(nullif(trim(l_linestatus), '')), l_extendedprice::DOUBLE FROM (
    SELECT DISTINCT l_orderkey, l_linenumber, loaded_at, l_shipdate, l_returnflag, l_linestatus, l_extendedprice FROM tpch_lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL)),
"""
_BUCKET = f"CASE WHEN x = 0 THEN 0 ELSE ceil(ln(abs(x)) / ln({_G}::DOUBLE))::INTEGER END"


def _exact_sql(levels: dict[str, tuple[str, ...]], columns: list[str], quantiles: list[float]) -> str:
    """The exact value at each rank, by sorting, and the middle of its bucket; a row only where that is within the accuracy."""
    names = ", ".join(columns)
    rows = " UNION ALL ".join(f"SELECT '{level}' AS level, {', '.join(f'{v} AS {c}' for v, c in zip(values, columns, strict=True))}, x FROM keyed WHERE x IS NOT NULL" for level, values in levels.items())
    return (
        _LINES
        + f"""u AS ({rows}),
r AS (SELECT *, row_number() OVER (PARTITION BY level, {names} ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY level, {names}) AS n_values FROM u),
e AS (SELECT level, {names}, quantile, x, n_values, {_BUCKET} AS bucket FROM r, (SELECT unnest({quantiles!r}::DOUBLE[]) AS quantile) q WHERE place = floor(quantile * (n_values - 1))),
m AS (SELECT *, CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * 2.0 * pow({_G}::DOUBLE, bucket::DOUBLE) / ({_G}::DOUBLE + 1) END AS middle FROM e)
SELECT level, {names}, quantile, round(middle, 4) AS price, n_values::BIGINT AS n_values FROM m WHERE abs(middle - x) <= {logsketch.ACCURACY} * abs(x) * (1 + 1e-9)"""
    )


ORACLES = {
    "p1_found": f"""WITH {ORDERS_ONCE} SELECT o_custkey, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM o WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL) WHERE place <= 3""",
    "p1_ranked": f"""WITH {ORDERS_ONCE} SELECT o_custkey, o_orderkey, o_totalprice, place::INTEGER AS rank_in_group FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM o WHERE o_totalprice IS NOT NULL) WHERE place <= 3""",
    "p2_found": _PLACED
    + """SELECT order_day, priority FROM s WHERE order_day IS NOT NULL AND priority IS NOT NULL AND o_custkey IS NOT NULL
GROUP BY ALL HAVING count(*) >= 40 AND count(DISTINCT o_custkey) * 2 <= count(*)""",
    "p2_distinct": _PLACED
    + " UNION ALL ".join((_level_sql("day and priority", "order_day", "priority"), _level_sql("day", "order_day", "NULL::VARCHAR"), _level_sql("priority", "NULL::VARCHAR", "priority"))),
    "p2_sets": _PLACED
    + ", full_rows AS (SELECT * FROM s WHERE priority IS NOT NULL AND o_custkey IS NOT NULL)\n"
    + " UNION ALL ".join(_sets_sql(a, b) for a, b in PAIRS),
    "p3_percentiles": _exact_sql(
        {
            "flag and status": ("NULL::VARCHAR", "f", "s"), "flag": ("NULL::VARCHAR", "f", "NULL::VARCHAR"), "status": ("NULL::VARCHAR", "NULL::VARCHAR", "s"),
            "day, flag and status": ("day", "f", "s"), "month, flag and status": ("substr(day, 1, 7)", "f", "s"),
        },
        ["period", "l_returnflag", "l_linestatus"],
        QUANTILES,
    ),
    "p3_days": _exact_sql({"day": ("day", "s"), "month": ("substr(day, 1, 7)", "s")}, ["period", "l_linestatus"], [0.5, 0.95]),
    "p3_sketch": _LINES
    + f"""b AS (SELECT day, f AS l_returnflag, s AS l_linestatus, sign(x)::INTEGER AS sign, {_BUCKET} AS bucket FROM keyed WHERE x IS NOT NULL)
SELECT *, count(*)::BIGINT AS n FROM b GROUP BY ALL""",
}
