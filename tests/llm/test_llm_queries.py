"""Every registered query of the subpackage; against its SQL where there is one."""

import pytest
from compare import DATA, assert_same, database

from quern.llm import registry


@pytest.fixture(scope="module")
def sql():
    return database()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        assert_same(found, sql.sql(registry.ORACLES[name]).df())


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import quern

    root = Path(quern.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "quern.llm" in p.read_text()]
