import pytest

from tests.compare import same
from tidewrack.plans import registry

QUERIES, SQL = registry()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_survives_without_optional_parts():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
