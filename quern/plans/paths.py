"""Access paths, predicates, statistics, changes and snapshots over the fixture tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import Catalog, capabilities
from quern.operators import access, changes, predicates, statistics
from quern.functions.hostlike import aggregate_by, divide, null_if, pad_equal, register, register_table, substring
from quern.session import application_dir, shared_dir
from quern.sources.files import read_files, write_files
from quern.sources.snapshots import SnapshotStore

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(Catalog(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return register


LINE = ("l_orderkey", "l_linenumber")
USER = ("user_id", "ts")
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_L = ", ".join(LINE_COLUMNS)
EVENT_COLUMNS = ["event_id", "user_id", "ts", "event_type", "value"]
_E = ", ".join(EVENT_COLUMNS)


def _lines(c: Catalog) -> DataFrame:
    return c.read("lineitem").select(*LINE_COLUMNS)


def _events(c: Catalog) -> DataFrame:
    return c.read("events").select(*EVENT_COLUMNS)


# Scans and lookups

query("scan_full", "SELECT * FROM orders")(lambda c: access.scan(c.read("orders")))
query("scan_projection", "SELECT o_orderkey, o_totalprice FROM orders")(lambda c: access.scan(c.read("orders"), ["o_orderkey", "o_totalprice"]))
query("scan_key_order", "SELECT o_orderkey, o_custkey FROM orders")(lambda c: access.ordered(access.scan(c.read("orders"), ["o_orderkey", "o_custkey"]), ["o_orderkey"]))
query("lookup_pk", "SELECT * FROM orders WHERE o_orderkey = 77")(lambda c: access.lookup(c.read("orders"), c.define("orders").primary_key, [77]))
query("lookup_secondary", "SELECT * FROM orders WHERE o_custkey = 77")(lambda c: access.lookup(c.read("orders"), c.define("orders").index("by_o_custkey").columns, [77]))
query("lookup_prefix", f"SELECT {_L} FROM lineitem WHERE l_orderkey = 77")(lambda c: access.lookup(_lines(c), LINE, [77]))
query("lookup_composite", f"SELECT {_L} FROM lineitem WHERE l_orderkey = 77 AND l_linenumber = 1")(lambda c: access.lookup(_lines(c), LINE, [77, 1]))
query("lookup_positions", f"SELECT {_L} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 77)")(
    lambda c: access.lookup_many(_lines(c), ["l_orderkey"], access.lookup(c.read("orders"), ["o_custkey"], [77]).select(F.col("o_orderkey").alias("l_orderkey")))
)
query("index_only", "SELECT o_custkey FROM orders WHERE o_custkey BETWEEN 5 AND 40")(lambda c: access.range_scan(c.read("orders"), ["o_custkey"], [5], [40]).select("o_custkey"))
query("range_closed", f"SELECT {_L} FROM lineitem WHERE l_orderkey BETWEEN 100 AND 250")(lambda c: access.range_scan(_lines(c), LINE, [100], [250]))
query("range_open", f"SELECT {_L} FROM lineitem WHERE l_orderkey > 100 AND l_orderkey < 250")(lambda c: access.range_scan(_lines(c), LINE, [100], [250], low_open=True, high_open=True))
query("range_composite", f"SELECT {_L} FROM lineitem WHERE (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 3)) AND (l_orderkey < 250 OR (l_orderkey = 250 AND l_linenumber <= 2))")(
    lambda c: access.range_scan(_lines(c), LINE, [100, 3], [250, 2], low_open=True)
)
query("range_unbounded", f"SELECT {_L} FROM lineitem WHERE l_orderkey >= 900")(lambda c: access.range_scan(_lines(c), LINE, low=[900]))
query("range_empty", f"SELECT {_L} FROM lineitem WHERE l_orderkey > 100 AND l_orderkey < 100")(lambda c: access.range_scan(_lines(c), LINE, [100], [100], low_open=True, high_open=True))
query("order_asc", f"SELECT {_E} FROM events ORDER BY user_id NULLS FIRST, ts NULLS FIRST, event_id LIMIT 100")(lambda c: access.first(_events(c), [*USER, "event_id"], 100))
query("order_desc", f"SELECT {_E} FROM events ORDER BY user_id DESC NULLS LAST, ts DESC NULLS LAST, event_id DESC LIMIT 100")(lambda c: access.last(_events(c), [*USER, "event_id"], 100))
query("order_asc_all", f"SELECT {_E} FROM events ORDER BY user_id NULLS FIRST, ts NULLS FIRST, event_id")(lambda c: access.ordered(_events(c), [*USER, "event_id"]))
query("order_desc_all", f"SELECT {_E} FROM events ORDER BY user_id DESC NULLS LAST, ts DESC NULLS LAST, event_id DESC")(lambda c: access.ordered(_events(c), [*USER, "event_id"], descending=True))
query("read_first", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1")(lambda c: access.first(c.read("orders"), ["o_orderkey"]))
query("read_last", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 1")(lambda c: access.last(c.read("orders"), ["o_orderkey"]))
query("read_key_or_next", "SELECT * FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 1")(lambda c: access.read_at_or_after(c.read("orders"), ["o_orderkey"], [500]))
query("read_after_key", "SELECT * FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 3")(lambda c: access.read_after(c.read("orders"), ["o_orderkey"], [500], 3))
query("read_before_key", "SELECT * FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 3")(lambda c: access.read_before(c.read("orders"), ["o_orderkey"], [500], 3))
query("read_prefix_last", f"SELECT {_E} FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1")(lambda c: access.read_prefix_last(_events(c), [*USER, "event_id"], [7]))
query("read_prefix_last_or_prev", f"SELECT {_E} FROM events WHERE user_id <= 7 ORDER BY user_id DESC, ts DESC, event_id DESC LIMIT 5")(
    lambda c: access.read_prefix_last(_events(c), [*USER, "event_id"], [7], 5, or_previous=True)
)

# Predicates

_ORDERS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
_O = ", ".join(_ORDERS)
for _name, _tree, _sql in (
    ("pred_eq", ("=", "o_custkey", 55), "o_custkey = 55"),
    ("pred_ne", ("<>", "o_orderstatus", "F"), "o_orderstatus <> 'F'"),
    ("pred_gt", (">", "o_totalprice", 250000), "o_totalprice > 250000"),
    ("pred_ge", (">=", "o_custkey", 90), "o_custkey >= 90"),
    ("pred_lt", ("<", "o_totalprice", 50000.5), "o_totalprice < 50000.5"),
    ("pred_le", ("<=", "o_orderdate", "1996-03-01"), "o_orderdate <= TIMESTAMP '1996-03-01'"),
    ("pred_and", ("and", (">", "o_custkey", 20), ("<", "o_custkey", 60), ("=", "o_orderstatus", "O")), "o_custkey > 20 AND o_custkey < 60 AND o_orderstatus = 'O'"),
    ("pred_or", ("or", ("=", "o_custkey", 20), (">", "o_totalprice", 300000)), "o_custkey = 20 OR o_totalprice > 300000"),
    ("pred_not", ("not", ("or", ("=", "o_orderstatus", "O"), ("=", "o_orderstatus", "F"))), "NOT (o_orderstatus = 'O' OR o_orderstatus = 'F')"),
    ("pred_in", ("in", "o_custkey", [1, 5, 9, 30]), "o_custkey IN (1, 5, 9, 30)"),
    ("pred_between", ("between", "o_totalprice", 1000, 60000), "o_totalprice BETWEEN 1000 AND 60000"),
    ("pred_like", ("like", "o_orderpriority", "%URGENT"), "o_orderpriority LIKE '%URGENT'"),
    ("pred_nullsafe", ("<=>", "o_custkey", 12), "o_custkey IS NOT DISTINCT FROM 12"),
):
    query(_name, f"SELECT {_O} FROM orders WHERE {_sql}")(lambda c, tree=_tree: predicates.select_where(c.read("orders"), tree, _ORDERS))
query("pred_null", "SELECT c_custkey, c_nationkey FROM tpch_customer WHERE c_mktsegment IS NULL AND c_nationkey IS NOT NULL")(
    lambda c: predicates.select_where(c.spark.read.parquet(f"{c.folder}/tpch_customer.parquet"), ("and", ("is null", "c_mktsegment"), ("is not null", "c_nationkey")), ["c_custkey", "c_nationkey"])
)
query("pred_null_dirty", "SELECT o_orderkey, loaded_at FROM tpch_orders WHERE o_custkey IS NULL")(
    lambda c: predicates.select_where(c.spark.read.parquet(f"{c.folder}/tpch_orders.parquet"), ("is null", "o_custkey"), ["o_orderkey", "loaded_at"])
)

# Statistics

query("count_exact", "SELECT count(*)::BIGINT AS row_count FROM lineitem")(lambda c: statistics.row_count(c.read("lineitem")))
query("count_range", "SELECT count(*)::BIGINT AS records FROM lineitem WHERE l_orderkey BETWEEN 100 AND 2500")(lambda c: statistics.records_in_range(c.read("lineitem"), LINE, [100], [2500]))
query(
    "density",
    """SELECT 'l_partkey' AS key_part, count(DISTINCT l_partkey)::BIGINT AS distinct_keys, count(*)::DOUBLE / count(DISTINCT l_partkey) AS rows_per_key FROM lineitem
UNION ALL SELECT 'l_partkey,l_suppkey', count(DISTINCT (l_partkey, l_suppkey))::BIGINT, count(*)::DOUBLE / count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem""",
)(lambda c: statistics.rows_per_key(c.read("lineitem"), c.define("lineitem").index("by_part_supplier").columns))
@query("density_approximate", "SELECT count(DISTINCT l_partkey)::BIGINT AS distinct_keys, true AS sketch_is_near FROM lineitem")
def density_approximate(c: Catalog) -> DataFrame:
    """The exact number of keys, and whether the sketch of fixed size comes within three standard errors of it."""
    lines, error = c.read("lineitem"), 0.02
    exact = statistics.rows_per_key(lines, ["l_partkey"]).select("distinct_keys")
    rough = statistics.approximate_rows_per_key(lines, "l_partkey", error).select("distinct_keys").scalar()
    return exact.select("distinct_keys", (F.abs(rough - F.col("distinct_keys")) <= 3 * error * F.col("distinct_keys")).alias("sketch_is_near"))


query(
    "column_report",
    " UNION ALL ".join(
        f"SELECT '{x}' AS column_name, (count(*) - count({x}))::BIGINT AS nulls, count(DISTINCT {x})::BIGINT AS \"distinct\", min({x})::VARCHAR AS min, max({x})::VARCHAR AS max FROM orders"
        for x in ("o_orderkey", "o_custkey", "o_orderstatus")
    ),
)(lambda c: statistics.column_report(c.read("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], exact=True))

# Changes

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _batch(c: Catalog) -> DataFrame:
    """All customers again: those of two segments as they are, the others under new keys, and one segment twice."""
    customers = c.read("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    same = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    moved = customers.withColumn("c_custkey", F.col("c_custkey") + F.when(same, F.lit(0)).otherwise(F.lit(10_000_000)))
    again = moved.where("c_mktsegment = 'MACHINERY' OR c_mktsegment = 'FURNITURE'").withColumn("c_name", F.concat("c_name", F.lit("/2")))
    return moved.unionByName(again).drop("c_mktsegment")


_BATCH = """m AS (SELECT c_custkey + CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 10000000 END AS c_custkey, c_name, c_nationkey, c_mktsegment FROM customer),
batch AS (SELECT c_custkey, c_name, c_nationkey FROM m UNION ALL SELECT c_custkey, c_name || '/2', c_nationkey FROM m WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE'))"""
_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey FROM customer"


def _customers(c: Catalog) -> DataFrame:
    return c.read("customer").select("c_custkey", "c_name", "c_nationkey")


query(
    "dml_insert_unique",
    f"""WITH {_BATCH} {_CUSTOMERS} UNION ALL SELECT c_custkey, c_name, c_nationkey FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c_name) AS rn FROM batch WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)) WHERE rn = 1""",
)(lambda c: changes.insert_unique(_customers(c), _batch(c), ["c_custkey"], ["c_name"], ignore=True))
query(
    "dml_rejected",
    f"""WITH {_BATCH} SELECT c_custkey, c_name, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c_name) AS rn FROM batch)
WHERE rn > 1 OR c_custkey IN (SELECT c_custkey FROM customer)""",
)(lambda c: changes.rejected(_customers(c), _batch(c), ["c_custkey"], ["c_name"]))
query(
    "dml_auto_increment",
    """SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS c_custkey, o_orderkey, o_orderdate FROM orders""",
)(
    lambda c: changes.with_auto_increment(
        c.read("customer").select("c_custkey"), c.read("orders").select(F.lit(None).cast("bigint").alias("c_custkey"), "o_orderkey", "o_orderdate"), "c_custkey", ["o_orderdate", "o_orderkey"]
    )
)
query(
    "dml_update",
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 'HELD' ELSE o_orderpriority END AS o_orderpriority FROM orders",
)(lambda c: changes.update_where(c.read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderstatus") == "O", {"o_orderpriority": F.lit("HELD")}))
query(
    "dml_changed_columns",
    "SELECT o_orderkey, 'P' AS o_orderstatus, o_orderpriority, 'o_orderstatus' AS changed FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'P'",
)(
    lambda c: changes.changed(
        c.read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"),
        c.read("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, F.lit("P")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority"),
        ["o_orderkey"],
    ).withColumn("changed", F.array_join("changed_columns", ",")).drop("changed_columns")
)
query(
    "dml_upsert",
    f"""WITH {_BATCH}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c_name DESC) AS rn FROM batch) WHERE rn = 1)
{_CUSTOMERS} WHERE c_custkey NOT IN (SELECT c_custkey FROM last) UNION ALL SELECT c_custkey, c_name, c_nationkey FROM last""",
)(lambda c: changes.upsert(_customers(c), _batch(c), ["c_custkey"], ["c_name"]))
query("dml_delete", "SELECT * FROM orders WHERE NOT (o_totalprice > 100000)")(lambda c: changes.delete_where(c.read("orders"), F.col("o_totalprice") > 100000))
query("dml_delete_keys", f"{_CUSTOMERS} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01')")(
    lambda c: changes.delete_keys(_customers(c), c.read("orders").where("o_orderdate >= DATE '2001-01-01'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
)
query("dml_truncate", "SELECT * FROM nation WHERE false")(lambda c: changes.truncate(c.read("nation")))


# Snapshots


def _store(c: Catalog) -> SnapshotStore:
    return SnapshotStore(c.spark, f"{shared_dir(c.spark)}/quern-store-{uuid.uuid4().hex}")


@query("snapshot_isolation", f"SELECT 'before' AS seen, n_nationkey, n_name FROM ({_NATION}) UNION ALL SELECT 'after', n_nationkey, n_name FROM ({_NATION} WHERE n_regionkey <> 1)")
def snapshot_isolation(c: Catalog) -> DataFrame:
    """A reader keeps its version while a writer publishes the next."""
    store = _store(c)
    store.create("nation", c.read("nation"))
    before = store.read("nation")
    with store.begin("nation") as change:
        change.stage(changes.delete_where(change.read(), F.col("n_regionkey") == 1))
    after = store.read("nation")
    tag = lambda df, seen: df.select(F.lit(seen).alias("seen"), "n_nationkey", "n_name")
    return tag(before, "before").unionByName(tag(after, "after"))


@query("snapshot_rollback", _NATION)
def snapshot_rollback(c: Catalog) -> DataFrame:
    store = _store(c)
    store.create("nation", c.read("nation"))
    change = store.begin("nation")
    change.stage(changes.truncate(change.read()))
    change.rollback()
    return store.read("nation").select("n_nationkey", "n_name", "n_regionkey")


@query(
    "snapshot_by_key",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 WHEN o_orderpriority = '2-HIGH' THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders
WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey + 50000000, o_totalprice FROM orders WHERE o_orderstatus = 'F'""",
)
def snapshot_by_key(c: Catalog) -> DataFrame:
    """Deletes by key, an upsert, an update and an insert, each rewriting only the files it touches, then compaction."""
    store, orders = _store(c), c.read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    store.create("orders", orders, ["o_orderkey"])
    with store.begin("orders", exclusive=True) as change:
        change.delete_keys(orders.where("o_orderpriority = '5-LOW'").select("o_orderkey"))
        change.upsert(orders.where("o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])
        change.update_where((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") != "P"), {"o_totalprice": F.lit(-1.0)})
    with store.begin("orders") as change:
        change.insert(orders.where("o_orderstatus = 'F'").withColumn("o_orderkey", F.col("o_orderkey") + 50_000_000))
    store.compact("orders")
    return store.read("orders").select("o_orderkey", "o_totalprice")


@query("statistics_kept", "SELECT count(*)::BIGINT AS rows_then, true AS same_before_due, (count(*) + (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'))::BIGINT AS rows_after, true AS near FROM orders")
def statistics_kept(c: Catalog) -> DataFrame:
    """Statistics kept with a table: asked again before they are due they are those of then, afterwards new ones."""
    store, orders = _store(c), c.read("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    store.create("orders", orders, ["o_orderkey"])
    then = c.statistics(store, "orders", now=0.0)
    with store.begin("orders") as change:
        change.insert(orders.where("o_orderstatus = 'F'").withColumn("o_orderkey", F.col("o_orderkey") + 50_000_000))
    held = c.statistics(store, "orders", now=30.0)
    after = c.statistics(store, "orders", now=100.0)
    found = [(then["rows"], held == then, after["rows"])]
    exact = F.lit(after["rows"]) / store.read("orders").agg(F.count_distinct("o_custkey")).scalar()
    near = F.abs(F.lit(after["rows_per_key"]["by_o_custkey.1"]) - exact) <= 0.06 * exact
    return c.spark.createDataFrame(found, "rows_then long, same_before_due boolean, rows_after long").withColumn("near", near)


@query("tables_renamed", "SELECT 'kept' AS table_name, count(*)::BIGINT AS row_count FROM region UNION ALL SELECT 'other', count(*)::BIGINT FROM nation")
def tables_renamed(c: Catalog) -> DataFrame:
    """Tables made, renamed and dropped; what is there at the end, with its rows."""
    store = _store(c)
    for name in ("region", "nation", "gone"):
        store.create(name, c.read("region" if name == "region" else "nation"))
    store.rename("region", "kept")
    store.rename("nation", "other")
    store.drop("gone")
    return c.spark.createDataFrame([(name, sum(f["rows"] for f in store.manifest(name)["files"])) for name in store.tables()], "table_name string, row_count long")


@query("layout_by_key", f"SELECT {_L} FROM lineitem WHERE l_partkey BETWEEN 200 AND 700")
def layout_by_key(c: Catalog) -> DataFrame:
    """A bulk load in key order, then a range of it: files and row groups outside the range are skipped."""
    path = f"{application_dir(c.spark)}/layout-{uuid.uuid4().hex}"
    access.cluster_by_key(_lines(c), ["l_partkey", "l_suppkey"], path, partitions=8)
    return access.range_scan(c.spark.read.schema(_lines(c).schema).parquet(path), ["l_partkey", "l_suppkey"], [200], [700])


@query(
    "index_capabilities",
    """SELECT * FROM (VALUES ('orders', 'primary', 'o_orderkey', true, true, false, true), ('orders', 'by_o_custkey', 'o_custkey', false, true, false, true), ('orders', 'by_o_orderdate', 'o_orderdate', false, true, false, true),
('lineitem', 'by_order_line', 'l_orderkey,l_linenumber', false, true, true, true), ('lineitem', 'by_part_supplier', 'l_partkey,l_suppkey', false, true, true, true), ('lineitem', 'by_l_shipdate', 'l_shipdate', false, true, false, true))
v(table_name, index_name, columns, is_unique, ordered, prefix, covering)""",
)
def index_capabilities(c: Catalog) -> DataFrame:
    rows = [(name, *way) for name in ("orders", "lineitem") for way in capabilities(c.define(name))]
    return c.spark.createDataFrame(rows, "table_name string, index_name string, columns string, is_unique boolean, ordered boolean, prefix boolean, covering boolean")


@query("source_memory", "SELECT * FROM (VALUES (1, 'a', 0.5), (2, NULL, -1.0), (3, '', NULL)) v(k, v, x)")
def source_memory(c: Catalog) -> DataFrame:
    """Rows of the driver as a table."""
    return c.spark.createDataFrame([(1, "a", 0.5), (2, None, -1.0), (3, "", None)], "k int, v string, x double")


# Sources and functions of one's own


def _round_trip(c: Catalog, kind: str) -> DataFrame:
    df = c.read("orders")
    path = f"{shared_dir(c.spark)}/quern-files-{uuid.uuid4().hex}"
    write_files(df, path, kind)
    return read_files(c.spark, path, kind, df.schema)


for _kind in ("csv", "json", "orc", "parquet"):
    query(f"source_{_kind}", "SELECT * FROM orders")(lambda c, kind=_kind: _round_trip(c, kind))
query("scan_read_ahead", "SELECT * FROM nation")(lambda c: c.read_ahead("nation"))


@query("udf_aggregate", "SELECT o_orderpriority, round(exp(avg(ln(o_totalprice))), 2) AS middle, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def udf_aggregate(c: Catalog) -> DataFrame:
    """An aggregate of one's own: partial states per batch in Python, put together in the JVM."""

    def partial(pdf: pd.DataFrame) -> dict[str, float]:
        return {"logs": float(np.log(pdf["o_totalprice"].to_numpy()).sum()), "n": float(len(pdf))}

    states = aggregate_by(c.read("orders"), ["o_orderpriority"], ["o_totalprice"], partial, {"logs": "sum", "n": "sum"})
    return states.select("o_orderpriority", F.round(F.exp(F.col("logs") / F.col("n")), 2).alias("middle"), F.col("n").cast("long").alias("n"))


@query("udf_table", "SELECT p_partkey, unnest(string_split(p_name, '_')) AS piece FROM part")
def udf_table(c: Catalog) -> DataFrame:
    """A table function of one's own, joined to each row."""

    class Pieces:
        def eval(self, text: str):
            for piece in text.split("_") if text is not None else ():
                yield (piece,)

    register_table(c.spark, "quern_pieces", Pieces, "piece string")
    return c.spark.sql("SELECT p_partkey, piece FROM {part}, LATERAL quern_pieces(p_name)", part=c.read("part").select("p_partkey", "p_name"))


@query("udf_vectorized", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def udf_vectorized(c: Catalog) -> DataFrame:
    def double(x: pd.Series) -> pd.Series:
        return x * 2

    twice = register(c.spark, "quern_twice", double, "double")
    return c.read("orders").select("o_orderkey", twice("o_totalprice").alias("twice"))


query(
    "fn_hostlike",
    """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey::DOUBLE / (o_custkey % 5) END AS share, NULLIF(o_orderstatus, 'F') AS open_status,
  substring(o_orderpriority, 3) AS label, o_orderstatus = 'O' AS is_open FROM orders""",
)(
    lambda c: c.read("orders").select(
        "o_orderkey",
        divide(F.col("o_orderkey").cast("double"), (F.col("o_custkey") % 5).cast("double")).alias("share"),
        null_if(F.col("o_orderstatus"), F.lit("F")).alias("open_status"),
        substring(F.col("o_orderpriority"), 3).alias("label"),
        pad_equal(F.col("o_orderstatus"), F.lit("O  ")).alias("is_open"),
    )
)
