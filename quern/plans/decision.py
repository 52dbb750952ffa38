"""Decision-support queries in SQL: the workload the engine is measured with, on the columns at hand.

Each text names its tables in braces; Spark gets DataFrames for them, the check gets the plain names.
Small dimensions are left to adaptive execution, which broadcasts what it has measured to be small.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quern.sources.tables import table

PRICE = "CAST(l_extendedprice AS DECIMAL(10,2))"
NET = f"{PRICE} * (1 - CAST(l_discount AS DECIMAL(3,2)))"


def money(expression: str) -> str:
    return f"CAST(sum({expression}) AS DOUBLE)"


#: The tables have no partsupp; each part and supplier of a line are one of its rows, with a cost and a quantity made from their keys.
PARTSUPP = """partsupp AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
  CAST((l_partkey * 31 + l_suppkey * 17) % 1000 + 1 AS INT) AS ps_supplycost, CAST((l_partkey * 7 + l_suppkey * 13) % 9999 + 1 AS INT) AS ps_availqty FROM {lineitem})"""

TEXTS: dict[str, str] = {
    "q01_pricing_summary": f"""
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, {money(PRICE)} AS sum_base_price, {money(NET)} AS sum_disc_price,
  {money(f"{NET} * (1 + CAST(l_tax AS DECIMAL(3,2)))")} AS sum_charge, CAST(sum(l_quantity) AS DOUBLE) / count(*) AS avg_qty,
  {money(PRICE)} / count(*) AS avg_price, CAST(count(*) AS BIGINT) AS count_order
FROM {{lineitem}} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "q02_cheapest_supplier": f"""
WITH {PARTSUPP}, offers AS (SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, ps_supplycost, min(ps_supplycost) OVER (PARTITION BY p_partkey) AS least
  FROM {{part}} JOIN partsupp ON p_partkey = ps_partkey JOIN {{supplier}} ON s_suppkey = ps_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  WHERE r_name = 'EUROPE' AND p_size = 15 AND p_type IN ('PROMO', 'SMALL'))
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM offers WHERE ps_supplycost = least ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q03_shipping_priority": f"""
SELECT l_orderkey, {money(NET)} AS revenue, CAST(o_orderdate AS DATE) AS order_day
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, CAST(o_orderdate AS DATE) ORDER BY revenue DESC, order_day, l_orderkey LIMIT 10""",
    "q04_order_priority": """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS order_count FROM {orders}
WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
  AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY)
GROUP BY o_orderpriority""",
    "q05_local_supplier": f"""
SELECT n_name, {money(NET)} AS revenue
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name""",
    "q06_forecast_revenue": f"""
SELECT {money(f"{PRICE} * CAST(l_discount AS DECIMAL(3,2))")} AS revenue FROM {{lineitem}}
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "q07_volume_shipping": f"""
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, {money(NET)} AS revenue
FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{customer}} ON c_custkey = o_custkey
  JOIN {{nation}} n1 ON s_nationkey = n1.n_nationkey JOIN {{nation}} n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
  AND l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY n1.n_name, n2.n_name, year(l_shipdate)""",
    "q08_market_share": f"""
SELECT o_year, CAST(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS o_year, {NET} AS volume, n2.n_name AS nation
  FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON l_orderkey = o_orderkey
    JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey JOIN {{region}} ON n1.n_regionkey = r_regionkey
    JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1999-01-01' AND p_type = 'PROMO') all_nations GROUP BY o_year""",
    "q_join_order": f"""
SELECT CAST(max(year(o_orderdate)) AS INT) AS last_year, {money(NET)} AS volume
FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON l_orderkey = o_orderkey
  JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey JOIN {{region}} ON n1.n_regionkey = r_regionkey
  JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey
WHERE r_name = 'ASIA' AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p_type = 'PROMO'""",
    "q09_profit": f"""
SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, {money(NET)} AS sum_profit
FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{nation}} ON s_nationkey = n_nationkey
WHERE p_brand LIKE '%#1%' GROUP BY n_name, year(o_orderdate)""",
    "q10_returned_items": f"""
SELECT c_custkey, c_name, {money(NET)} AS revenue, c_acctbal, n_name
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{nation}} ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11_important_stock": f"""
WITH {PARTSUPP}, held AS (SELECT ps_partkey, CAST(sum(CAST(ps_supplycost AS BIGINT) * ps_availqty) AS BIGINT) AS stock_value FROM partsupp JOIN {{supplier}} ON s_suppkey = ps_suppkey
  JOIN {{nation}} ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' GROUP BY ps_partkey)
SELECT ps_partkey, stock_value FROM held WHERE stock_value > (SELECT CAST(sum(stock_value) AS DOUBLE) * 0.0001 FROM held)""",
    "q12_priority_by_status": """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_linestatus""",
    "q13_customer_distribution": """
SELECT c_count, CAST(count(*) AS BIGINT) AS custdist FROM (
  SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey) c GROUP BY c_count""",
    "q14_promo_share": f"""
SELECT 100.0 * CAST(sum(CASE WHEN p_type = 'PROMO' THEN {NET} ELSE 0 END) AS DOUBLE) / {money(NET)} AS promo_revenue
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "q15_top_supplier": f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, {money(NET)} AS total_revenue FROM {{lineitem}}
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {{supplier}} JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "q16_suppliers_by_part": f"""
WITH {PARTSUPP}
SELECT p_brand, p_type, p_size, CAST(count(DISTINCT ps_suppkey) AS BIGINT) AS supplier_cnt FROM partsupp JOIN {{part}} ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'PROMO%' AND p_size IN (1, 4, 7, 14, 23, 36, 45, 49)
  AND NOT EXISTS (SELECT 1 FROM {{supplier}} WHERE s_suppkey = ps_suppkey AND s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "q17_small_quantity": f"""
SELECT {money(PRICE)} / 7.0 AS avg_yearly FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey
  JOIN (SELECT l_partkey AS k, 0.2 * CAST(sum(l_quantity) AS DOUBLE) / count(*) AS few FROM {{lineitem}} GROUP BY l_partkey) a ON a.k = p_partkey
WHERE p_brand = 'Brand#13' AND l_quantity < few""",
    "q18_large_orders": """
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS order_day, o_totalprice, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 180)
GROUP BY c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE), o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "q19_discounted": f"""
SELECT {money(NET)} AS revenue FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
  OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
  OR (p_brand = 'Brand#24' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
    "q20_excess_stock": f"""
WITH {PARTSUPP}, sold AS (SELECT l_partkey AS pk, l_suppkey AS sk, 0.5 * CAST(sum(l_quantity) AS DOUBLE) AS half FROM {{lineitem}}
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_partkey, l_suppkey)
SELECT s_name, s_suppkey FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
WHERE n_name IN ('NATION_3', 'NATION_8', 'NATION_12') AND EXISTS (
  SELECT 1 FROM partsupp JOIN sold ON pk = ps_partkey AND sk = ps_suppkey JOIN {{part}} ON p_partkey = ps_partkey
  WHERE ps_suppkey = s_suppkey AND ps_availqty > half AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))""",
    "q21_waiting_suppliers": """
SELECT s_name, CAST(count(*) AS BIGINT) AS numwait FROM {supplier} JOIN {lineitem} l1 ON s_suppkey = l1.l_suppkey JOIN {orders} ON o_orderkey = l1.l_orderkey
WHERE o_orderstatus = 'F' AND l1.l_linestatus = 'O'
  AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_linestatus = 'O')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22_sales_opportunity": """
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS totacctbal FROM {customer}
WHERE c_acctbal > (SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM {customer} WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-06-01') GROUP BY c_mktsegment""",
}


def run(spark: SparkSession, folder: str, text: str) -> DataFrame:
    names = set(re.findall(r"{(\w+)}", text))
    return spark.sql(text, **{n: table(spark, folder, n) for n in names})


QUERIES = {name: (lambda spark, folder, text=text: run(spark, folder, text)) for name, text in TEXTS.items()}

# The checks are put another way than the queries: subqueries for joins and joins for subqueries, filters for cases.
_PS = re.sub(r"{(\w+)}", r"\1", PARTSUPP)
_REV = "sum(l_extendedprice::DECIMAL(10,2) * (1 - l_discount::DECIMAL(3,2)))::DOUBLE"
ORACLES = {
    "q02_cheapest_supplier": f"""WITH {_PS}, there AS (SELECT * FROM supplier, nation WHERE n_nationkey = s_nationkey AND n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE'))
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, there, partsupp p WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND (p_type = 'PROMO' OR p_type = 'SMALL')
  AND ps_supplycost <= ALL (SELECT o.ps_supplycost FROM partsupp o WHERE o.ps_partkey = p.ps_partkey AND o.ps_suppkey IN (SELECT s_suppkey FROM there))
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q03_shipping_priority": f"""SELECT o_orderkey AS l_orderkey, (SELECT {_REV} FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > TIMESTAMP '1998-03-15') AS revenue, o_orderdate::DATE AS order_day
FROM orders WHERE o_orderdate < TIMESTAMP '1998-03-15' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-03-15') ORDER BY revenue DESC, order_day, l_orderkey LIMIT 10""",
    "q04_order_priority": """SELECT o_orderpriority, count(DISTINCT o_orderkey)::BIGINT AS order_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND date_diff('second', o_orderdate, l_shipdate) > 30 * 86400
WHERE year(o_orderdate) = 1997 AND quarter(o_orderdate) = 3 GROUP BY ALL""",
    "q06_forecast_revenue": """SELECT (sum(round(l_extendedprice * 100)::HUGEINT * round(l_discount * 100)::HUGEINT) FILTER (year(l_shipdate) = 1996 AND l_quantity <= 23 AND round(l_discount * 100) IN (5, 6, 7)) / 10000)::DOUBLE AS revenue FROM lineitem""",
    "q11_important_stock": f"""WITH {_PS}, v AS (SELECT ps_partkey, ps_supplycost::BIGINT * ps_availqty AS x FROM partsupp WHERE ps_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7')))
SELECT ps_partkey, sum(x)::BIGINT AS stock_value FROM v GROUP BY ALL HAVING sum(x) * 10000 > (SELECT sum(x) FROM v)""",
    "q12_priority_by_status": """SELECT l_linestatus, (count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')))::BIGINT AS high_line_count, (count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')))::BIGINT AS low_line_count
FROM lineitem, orders WHERE l_orderkey = o_orderkey AND year(l_shipdate) = 1996 GROUP BY ALL""",
    "q13_customer_distribution": """SELECT n::BIGINT AS c_count, count(*)::BIGINT AS custdist FROM (SELECT (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) GROUP BY ALL""",
    "q15_top_supplier": f"""SELECT s_suppkey, s_name, total_revenue FROM (
  SELECT l_suppkey, {_REV} AS total_revenue, rank() OVER (ORDER BY {_REV} DESC) AS place FROM lineitem WHERE year(l_shipdate) = 1996 AND quarter(l_shipdate) = 1 GROUP BY l_suppkey), supplier WHERE place = 1 AND s_suppkey = l_suppkey""",
    "q16_suppliers_by_part": f"""WITH {_PS} SELECT p_brand, p_type, p_size, count(*)::BIGINT AS supplier_cnt FROM (
  SELECT DISTINCT p_brand, p_type, p_size, ps_suppkey FROM part, partsupp WHERE p_partkey = ps_partkey AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))
WHERE p_brand != 'Brand#5' AND NOT starts_with(p_type, 'PROMO') AND list_contains([1, 4, 7, 14, 23, 36, 45, 49], p_size) GROUP BY ALL""",
    "q18_large_orders": """SELECT c_name, c_custkey, o_orderkey, o_orderdate::DATE AS order_day, o_totalprice, q::BIGINT AS quantity
FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING q > 180), orders, customer WHERE o_orderkey = l_orderkey AND c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "q20_excess_stock": f"""WITH {_PS} SELECT s_name, s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_3', 'NATION_8', 'NATION_12'))
  AND s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))
    AND 2 * ps_availqty > (SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND year(l_shipdate) = 1996))""",
    "q21_waiting_suppliers": """WITH held AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_suppkey) FILTER (l_linestatus = 'O') AS late FROM lineitem GROUP BY ALL)
SELECT s_name, count(*)::BIGINT AS numwait FROM lineitem JOIN held USING (l_orderkey) JOIN supplier ON s_suppkey = l_suppkey
WHERE l_linestatus = 'O' AND n > 1 AND late = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22_sales_opportunity": """SELECT c_mktsegment, count(*)::BIGINT AS numcust, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS totacctbal
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01') ON o_custkey = c_custkey
WHERE o_custkey IS NULL AND c_acctbal > (SELECT sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*) FROM customer WHERE c_acctbal > 0) GROUP BY ALL""",
    "q01_pricing_summary": f"""WITH l AS (SELECT *, l_extendedprice::DECIMAL(10,2) AS p, l_discount::DECIMAL(3,2) AS d, l_tax::DECIMAL(3,2) AS t FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02 00:00:00.000001')
SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, sum(p)::DOUBLE AS sum_base_price, sum(p - p * d)::DOUBLE AS sum_disc_price, sum((p - p * d) * (1 + t))::DOUBLE AS sum_charge,
  sum(l_quantity)::DOUBLE / count(l_orderkey) AS avg_qty, sum(p)::DOUBLE / count(l_orderkey) AS avg_price, count(l_orderkey)::BIGINT AS count_order FROM l GROUP BY ALL""",
    "q05_local_supplier": f"""SELECT (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) AS n_name, {_REV} AS revenue FROM lineitem, orders, supplier
WHERE o_orderkey = l_orderkey AND s_suppkey = l_suppkey AND year(o_orderdate) = 1996 AND s_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = o_custkey)
  AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')) GROUP BY s_nationkey""",
    "q07_volume_shipping": f"""WITH c AS (SELECT o_orderkey, n_name AS cust_nation FROM orders, customer, nation WHERE c_custkey = o_custkey AND n_nationkey = c_nationkey),
v AS (SELECT s_suppkey, n_name AS supp_nation FROM supplier, nation WHERE n_nationkey = s_nationkey)
SELECT supp_nation, cust_nation, year(l_shipdate)::INT AS l_year, {_REV} AS revenue FROM lineitem, c, v WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey
  AND (supp_nation, cust_nation) IN (('NATION_1', 'NATION_2'), ('NATION_2', 'NATION_1')) AND year(l_shipdate) BETWEEN 1995 AND 1998 GROUP BY ALL""",
    "q08_market_share": f"""WITH o AS (SELECT o_orderkey, year(o_orderdate)::INT AS o_year FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1998 AND o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'AMERICA'))),
l AS (SELECT o_year, l_extendedprice::DECIMAL(10,2) * (1 - l_discount::DECIMAL(3,2)) AS v, l_suppkey IN (SELECT s_suppkey FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_name = 'NATION_3') AS own
  FROM lineitem JOIN o ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') AND l_suppkey IN (SELECT s_suppkey FROM supplier))
SELECT o_year, coalesce(sum(v) FILTER (own), 0)::DOUBLE / sum(v)::DOUBLE AS mkt_share FROM l GROUP BY o_year""",
    "q_join_order": f"""SELECT max(year(o_orderdate))::INT AS last_year, {_REV} AS volume FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
  AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation))
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')))""",
    "q09_profit": f"""SELECT nation, o_year, {_REV} AS sum_profit FROM (
  SELECT (SELECT n_name FROM supplier, nation WHERE s_suppkey = l_suppkey AND n_nationkey = s_nationkey) AS nation, (SELECT year(o_orderdate)::INT FROM orders WHERE o_orderkey = l_orderkey) AS o_year, l_extendedprice, l_discount
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE contains(p_brand, '#1'))) WHERE nation IS NOT NULL AND o_year IS NOT NULL GROUP BY ALL""",
    "q10_returned_items": f"""WITH r AS (SELECT o_custkey, {_REV} AS revenue FROM orders, lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND year(o_orderdate) = 1997 AND quarter(o_orderdate) = 4 GROUP BY o_custkey)
SELECT c_custkey, c_name, revenue, c_acctbal, n_name FROM customer JOIN r ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q14_promo_share": f"""WITH l AS (SELECT l_extendedprice::DECIMAL(10,2) * (1 - l_discount::DECIMAL(3,2)) AS v, (SELECT p_type FROM part WHERE p_partkey = l_partkey) AS kind FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1997-09')
SELECT 100.0 * coalesce(sum(v) FILTER (kind = 'PROMO'), 0)::DOUBLE / sum(v)::DOUBLE AS promo_revenue FROM l WHERE kind IS NOT NULL""",
    "q17_small_quantity": """SELECT sum(p)::DOUBLE / 7.0 AS avg_yearly FROM (
  SELECT l_extendedprice::DECIMAL(10,2) AS p, l_partkey, l_quantity, 0.2 * sum(l_quantity) OVER (PARTITION BY l_partkey)::DOUBLE / count(*) OVER (PARTITION BY l_partkey) AS few FROM lineitem)
WHERE l_quantity < few AND l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13')""",
    "q19_discounted": f"""WITH wanted(brand, low, size) AS (VALUES ('Brand#12', 1, 15), ('Brand#23', 10, 30), ('Brand#24', 20, 45))
SELECT {_REV} AS revenue FROM lineitem, part, wanted WHERE p_partkey = l_partkey AND p_brand = brand AND l_quantity - low BETWEEN 0 AND 10 AND p_size > 0 AND p_size <= size""",
}
