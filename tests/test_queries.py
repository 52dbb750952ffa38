"""Every registered query of the core against its SQL."""

import pytest
from compare import DATA, assert_same, database

from quern.plans import registry


@pytest.fixture(scope="module")
def sql():
    return database()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        assert_same(found, sql.sql(registry.ORACLES[name]).df())
    else:
        assert len(found)


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name,step", [("order_asc_all", 1), ("order_desc_all", -1)])
def test_ordered_scans_return_the_whole_table_in_order(spark, name, step):
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in (r.user_id, r.ts, r.event_id))
    found = [key(r) for r in registry.QUERIES[name](spark, DATA).collect()]
    assert len(found) == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert found == sorted(found)[::step]
