import pytest

from strophe.plans import registry
from tests.compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    ours, theirs = both(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["label", "src", "dst", "distance", "reported", "applied"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
