import pytest

from tarifa.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_gives_the_rows_of_its_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE[name])


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_product_labels_without_sql(spark):
    from tests.conftest import SMALL

    rows = registry.QUERIES["product_labels"](spark, SMALL)
    assert rows.count() == spark.read.parquet(f"{SMALL}/part.parquet").count()
