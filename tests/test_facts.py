"""Plans over readings that are stored by pair."""

import pytest

from tarifa.operators import rollups
from tarifa.sources import facts, tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def stored(spark):
    snaps = tables.snapshots(spark, SMALL).cache()
    facts.write(snaps, "readings_by_pair", 8)
    yield snaps, facts.read(spark, "readings_by_pair")
    spark.conf.unset(facts._ORDER)
    spark.sql("DROP TABLE readings_by_pair")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, sorts", [("latest", 0), ("coverage", 0), ("day_closes", 2), ("changes", 2), ("sales_daily", 3)])
def test_nothing_is_shuffled_that_goes_by_pair(stored, name, sorts):
    """Days within a pair are sorted; the readings of a pair are not."""
    snaps, table = stored
    made = getattr(rollups, name)
    text = plan(made(table))
    assert "Exchange" not in text
    assert text.count("Sort [") + text.count("Sort(") <= sorts, text
    same = made(snaps)
    assert made(table).exceptAll(same).count() == 0 and same.exceptAll(made(table)).count() == 0


def test_buckets_follow_the_rows(stored):
    assert [facts.buckets_for(n) for n in (0, 16_000_000, 16_000_001, 10**13)] == [8, 8, 16, facts.MOST]
    assert facts.long_pairs(stored[0], 10**6).count() == 0 and facts.long_pairs(stored[0], 0).count() == stored[0].select("sku", "store_id").distinct().count()
