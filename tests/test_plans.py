"""What the sources and plans must not hold."""

from pathlib import Path

import pytest

import quern
from quern.catalog import KEY_TYPES, TABLES, Catalog, trim_padding
from quern.plans import registry
from quern.session import shared_dir
from quern.settings import COUNTERPARTS, apply, current

ROOT = Path(quern.__file__).parent
DATA = "/root/testdata/sf0.001"


def test_sources_keep_off_unsafe_calls():
    for path in ROOT.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint(" not in text
        if path.name != "features.py":
            assert "crossJoin(" not in text


@pytest.mark.parametrize("name", ["p4_found", "p6_found", "q05_local_supplier", "q21_waiting_suppliers", "join_asof", "join_range"])
def test_no_products_in_plans(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned(spark):
    plan = registry.QUERIES["q06_forecast_revenue"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" not in plan and "PushedFilters" in plan and "l_shipdate" in plan


def test_catalog_is_case_sensitive(spark):
    catalog = Catalog(spark, DATA)
    with pytest.raises(KeyError):
        catalog.read("Orders")
    assert catalog.define("lineitem").index("by_order_line").columns == ("l_orderkey", "l_linenumber")
    with pytest.raises(KeyError):
        catalog.define("orders").index("none")
    assert set(TABLES) >= {"orders", "lineitem", "events"} and "uint64" in KEY_TYPES


def test_padding_is_trimmed(spark):
    rows = trim_padding(spark.createDataFrame([(1, "ab  "), (2, None)], "k int, v string")).collect()
    assert [r.v for r in rows] == ["ab", None]


def test_settings_answer(spark):
    assert set(current(spark)) == set(COUNTERPARTS) and len(COUNTERPARTS) == 18
    with pytest.raises(KeyError):
        apply(spark, "no_such", 1)
    assert not apply(spark, "journal_size", 1) and not apply(spark, "max_mem_use", "1g")
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    try:
        assert apply(spark, "efficient_text", True) and spark.conf.get("spark.sql.parquet.compression.codec") == "zstd"
        assert apply(spark, "block_read_ahead", 1)
        catalog = Catalog(spark, DATA)
        kept = catalog.read("nation")
        assert kept.storageLevel.useMemory and catalog.read("nation") is kept
        catalog.release()
        assert not kept.storageLevel.useMemory
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", codec)
        apply(spark, "block_read_ahead", 0)
    assert not Catalog(spark, DATA).read("nation").storageLevel.useMemory


def test_shared_folder_is_the_sessions(spark):
    class Named:
        sparkContext = spark.sparkContext
        conf = {"spark.checkpoint.dir": "file:///somewhere/shared/"}

    assert shared_dir(Named) == "file:///somewhere/shared"
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("file://")
