"""Every registered query of the reference's operators against its SQL, and the others for running at all."""

import pytest

from sparkfolio.plans import more, parts, registry  # noqa: F401  more and parts register further queries


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir, same_rows):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same_rows(got, want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
