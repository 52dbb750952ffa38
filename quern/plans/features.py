"""The host's operators one by one: joins, aggregates, windows, order, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.operators.access import not_in
from quern.operators.temporal import asof_join, range_join
from quern.plans.decision import run
from quern.sources.tables import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = lambda spark, folder: f(Catalog(spark, folder))
    if sql:
        ORACLES[name] = sql


def _key(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


# Joins

_C = "c_custkey, c_name"
query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", lambda c: c.read("orders").join(c.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"))
query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey", lambda c: c.read("customer").join(c.read("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey"))
query("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000", lambda c: c.read("orders").join(c.read("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 100000), "right").select("c_custkey", "o_orderkey"))
query("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 7", lambda c: c.read("customer").join(c.read("supplier"), F.col("c_custkey") == F.col("s_suppkey") * 7, "full").select("c_custkey", "s_suppkey"))
query("join_semi", f"SELECT {_C} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", lambda c: c.read("customer").join(c.read("orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name"))
query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", lambda c: c.read("orders").join(c.read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey"))
query("join_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", lambda c: not_in(c.read("customer").select("c_custkey"), "c_custkey", c.read("orders").where("o_totalprice > 250000"), "o_custkey"))
query("join_not_in_null", "SELECT c_custkey FROM tpch_customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM tpch_nation WHERE n_nationkey IS NOT NULL)", lambda c: not_in(table(c.spark, c.folder, "tpch_customer"), "c_nationkey", table(c.spark, c.folder, "tpch_nation").where("n_nationkey IS NOT NULL"), "n_nationkey").select("c_custkey"))
query("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", lambda c: c.read("nation").alias("a").join(c.read("nation").alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name")))
query("join_cross", "SELECT r_name, s_suppkey FROM region, supplier", lambda c: c.read("region").crossJoin(c.read("supplier")).select("r_name", "s_suppkey"))
query("join_theta", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey", lambda c: c.read("nation").join(c.read("region"), F.col("n_regionkey") > F.col("r_regionkey")).select("n_name", "r_name"))
query(
    "join_range",
    "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 1 AND s_acctbal + 1",
    lambda c: range_join(c.read("part").select("p_partkey", "p_retailprice"), c.read("supplier").select("s_suppkey", (F.col("s_acctbal") - 1).alias("low"), (F.col("s_acctbal") + 1).alias("high")), "p_retailprice", "low", "high", 2.0).select("p_partkey", "s_suppkey"),
)
query(
    "join_asof",
    """SELECT event_id, (SELECT p.value FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) AS last_purchase
FROM events e WHERE event_type = 'click'""",
    lambda c: asof_join(c.read("events").where("event_type = 'click'").select("event_id", "user_id", "ts"), c.read("events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value"), "user_id", "ts", ["value"], tie="event_id").select("event_id", F.col("asof_value").alias("last_purchase")),
)
query("join_index_probe", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 15", lambda c: c.read("orders").where("o_custkey = 15").join(c.read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber"))

# Aggregates

def _price() -> Column:
    return F.col("o_totalprice").cast("decimal(18,2)")


query("agg_global", "SELECT count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders", lambda c: c.read("orders").agg(F.count(F.lit(1)).alias("n"), F.sum(_price()).cast("double").alias("total"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")))
query("agg_group", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean FROM orders GROUP BY ALL", lambda c: c.read("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), (F.sum(_price()).cast("double") / F.count(F.lit(1))).alias("mean")))
query("agg_having", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", lambda c: c.read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12"))
query("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey)::BIGINT AS customers FROM orders GROUP BY ALL", lambda c: c.read("orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers")))
query("agg_spread", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var FROM lineitem GROUP BY ALL", lambda c: c.read("lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var")))
query("agg_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY ALL", lambda c: c.read("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names")))
query("agg_bits", "SELECT p_brand, bit_and(p_size)::INT AS b_and, bit_or(p_size)::INT AS b_or, bit_xor(p_size)::INT AS b_xor FROM part GROUP BY ALL", lambda c: c.read("part").groupBy("p_brand").agg(F.bit_and("p_size").alias("b_and"), F.bit_or("p_size").alias("b_or"), F.bit_xor("p_size").alias("b_xor")))
for _kind, _f in (("rollup", DataFrame.rollup), ("cube", DataFrame.cube)):
    query(f"agg_{_kind}", f"SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY {_kind.upper()}(l_returnflag, l_linestatus)", lambda c, f=_f: f(c.read("lineitem"), "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))
query("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", lambda c: run(c.spark, c.folder, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
query(
    "agg_approx_distinct",
    "SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, true AS sketch_is_near FROM events GROUP BY ALL",
    lambda c: c.read("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("rough")).select("event_type", "users", (F.abs(F.col("rough") - F.col("users")) <= 0.06 * F.col("users")).alias("sketch_is_near")),
)
query("agg_filter", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS done, count(*) FILTER (WHERE o_totalprice > 1000)::BIGINT AS large FROM orders", lambda c: c.read("orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 1000).alias("large")))
query("agg_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS \"O\" FROM lineitem GROUP BY ALL", lambda c: c.read("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0))

# Windows

def _by_customer() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


query(
    "win_rank",
    """SELECT o_orderkey, row_number() OVER w::INT AS rn, rank() OVER p::INT AS rk, dense_rank() OVER p::INT AS dr, ntile(4) OVER w::INT AS tile FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
    lambda c: c.read("orders").select("o_orderkey", F.row_number().over(_by_customer()).alias("rn"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("rk"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dr"), F.ntile(4).over(_by_customer()).alias("tile")),
)
query(
    "win_share",
    "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)",
    lambda c: c.read("orders").select("o_orderkey", F.round(F.percent_rank().over(Window.partitionBy("o_custkey").orderBy("o_totalprice")), 9).alias("pr"), F.round(F.cume_dist().over(Window.partitionBy("o_custkey").orderBy("o_totalprice")), 9).alias("cd")),
)
query(
    "win_neighbours",
    """SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER f AS second FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    lambda c: c.read("orders").select("o_orderkey", F.lag("o_orderkey").over(_by_customer()).alias("before"), F.lead("o_orderkey").over(_by_customer()).alias("after"), F.first("o_orderkey").over(_by_customer()).alias("first"), F.nth_value("o_orderkey", 2).over(_by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second")),
)
query(
    "win_frames",
    """SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING)::DOUBLE AS last_three,
  count(*) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1990-01-01', o_orderdate::DATE) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW)::BIGINT AS in_90_days FROM orders""",
    lambda c: c.read("orders").select("o_orderkey", F.sum(_price()).over(_by_customer().rowsBetween(-2, 0)).cast("double").alias("last_three"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey").orderBy(F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))).rangeBetween(-90, 0)).alias("in_90_days")),
)

# Order, limits and sets

query("sort_composite", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem", lambda c: c.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_orderkey", F.desc("l_linenumber")))
query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", lambda c: c.read("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25))
query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 45", lambda c: c.read("orders").select("o_orderkey").orderBy("o_orderkey").offset(45).limit(30))
_A, _B = "SELECT n_nationkey AS k FROM nation", "SELECT c_nationkey AS k FROM customer"
_a, _b = lambda c: c.read("nation").select(F.col("n_nationkey").alias("k")), lambda c: c.read("customer").select(F.col("c_nationkey").alias("k"))
query("set_union_all", f"{_A} UNION ALL {_B}", lambda c: _a(c).unionAll(_b(c)))
query("set_union", f"{_A} UNION {_B}", lambda c: _a(c).union(_b(c)).distinct())
query("set_intersect", f"{_A} INTERSECT {_B}", lambda c: _a(c).intersect(_b(c)))
query("set_except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem", lambda c: c.read("orders").select(F.col("o_orderkey").alias("k")).subtract(c.read("lineitem").select("l_orderkey")))
query("set_except_all", "SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders", lambda c: c.read("lineitem").select(F.col("l_orderkey").alias("k")).exceptAll(c.read("orders").select("o_orderkey")))
query("set_distinct", "SELECT DISTINCT p_brand, p_type FROM part", lambda c: c.read("part").select("p_brand", "p_type").distinct())

# Scalar functions

query(
    "fn_dates",
    """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, (o_orderdate::DATE + INTERVAL 90 DAY)::DATE AS plus_days,
  make_date(y3, m3, least(day(o_orderdate), day(last_day(make_date(y3, m3, 1))))) AS plus_months, last_day(o_orderdate::DATE) AS month_end, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS age
FROM (SELECT *, (year(o_orderdate) + CASE WHEN month(o_orderdate) > 9 THEN 1 ELSE 0 END)::INT AS y3, ((month(o_orderdate) + 2) % 12 + 1)::INT AS m3 FROM orders)""",
    lambda c: c.read("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"), F.quarter("o_orderdate").alias("q"), F.date_add(F.col("o_orderdate").cast("date"), 90).alias("plus_days"), F.add_months(F.col("o_orderdate").cast("date"), 3).alias("plus_months"), F.last_day(F.col("o_orderdate").cast("date")).alias("month_end"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("age")),
)
query(
    "fn_math",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity % 7)::INT AS rest, floor(l_quantity / 7.0)::INT AS whole, abs(20 - l_quantity)::INT AS off, l_quantity::DOUBLE / NULLIF(l_linenumber - 1, 0) AS ratio, floor(l_extendedprice)::BIGINT AS down, ceil(l_extendedprice)::BIGINT AS up FROM lineitem",
    lambda c: c.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") % 7).cast("int").alias("rest"), F.floor(F.col("l_quantity") / 7).cast("int").alias("whole"), F.abs(F.lit(20) - F.col("l_quantity")).cast("int").alias("off"), F.try_divide(F.col("l_quantity").cast("double"), (F.col("l_linenumber") - 1).cast("double")).alias("ratio"), F.floor("l_extendedprice").alias("down"), F.ceil("l_extendedprice").alias("up")),
)
query(
    "fn_strings",
    "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, substring(c_name, 1, 8) AS s, length(c_name)::INT AS n, c_name || '/' || c_mktsegment AS j, replace(c_mktsegment, 'I', '1') AS r, lpad(c_custkey::VARCHAR, 9, '0') AS p, c_name LIKE '%9%' AS has9 FROM customer",
    lambda c: c.read("customer").select("c_custkey", F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("l"), F.substring("c_name", 1, 8).alias("s"), F.length("c_name").alias("n"), F.concat("c_name", F.lit("/"), "c_mktsegment").alias("j"), F.replace("c_mktsegment", F.lit("I"), F.lit("1")).alias("r"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("p"), F.col("c_name").like("%9%").alias("has9")),
)
query(
    "fn_conditional",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size, coalesce(NULLIF(o_orderstatus, 'P'), 'open') AS status, greatest(o_orderkey, o_custkey) AS hi FROM orders",
    lambda c: c.read("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_totalprice") > 50000, "middle").otherwise("small").alias("size"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("open")).alias("status"), F.greatest("o_orderkey", "o_custkey").alias("hi")),
)
query("fn_json", "SELECT event_id, (props->>'k')::INT AS k FROM events", lambda c: c.read("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))
query("fn_hash", "SELECT o_orderkey, md5(o_orderpriority || o_orderkey::VARCHAR) AS md5, sha256(o_orderpriority) AS sha FROM orders", lambda c: c.read("orders").select("o_orderkey", F.md5(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("md5"), F.sha2("o_orderpriority", 256).alias("sha")))
query(
    "fn_arrays",
    """SELECT o_orderkey, len(w)::INT AS n, w[1] AS head, list_contains(w, 'HIGH') AS high, list_sum([length(x) FOR x IN w])::INT AS letters, array_to_string(list_reverse_sort(w), '/') AS back
FROM (SELECT *, string_split(o_orderpriority, '-') AS w FROM orders)""",
    lambda c: c.read("orders").withColumn("w", F.split("o_orderpriority", "-")).select("o_orderkey", F.size("w").alias("n"), F.element_at("w", 1).alias("head"), F.array_contains("w", "HIGH").alias("high"), F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).alias("letters"), F.array_join(F.sort_array("w", asc=False), "/").alias("back")),
)
query(
    "fn_maps",
    "SELECT n_regionkey, string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey) AS pairs, count(*)::INT AS n FROM nation GROUP BY ALL",
    lambda c: c.read("nation").groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("m")).select("n_regionkey", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k.cast("string"), F.lit("="), F.element_at("m", k))), ",").alias("pairs"), F.size("m").alias("n")),
)
query("fn_from_json", "SELECT event_id, (props->>'k')::BIGINT * 2 AS twice, json_extract_string(props, '$.none') AS none FROM events", lambda c: c.read("events").withColumn("p", F.from_json("props", "k bigint, none string")).select("event_id", (F.col("p.k") * 2).alias("twice"), F.col("p.none").alias("none")))
query("fn_strings_order", "SELECT p_brand, count(*)::BIGINT AS n FROM part WHERE p_brand > 'Brand#1' AND p_brand <= 'Brand#2' GROUP BY ALL", lambda c: c.read("part").where((F.col("p_brand") > "Brand#1") & (F.col("p_brand") <= "Brand#2")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")))
