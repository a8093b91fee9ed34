import pytest

from strandframe.plans import registry
from tests.checks import FOLDER, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLES:
        assert spark_rows(df) == sql_rows(registry.ORACLES[name])
    else:
        assert df.collect()


def test_entry_imports():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
