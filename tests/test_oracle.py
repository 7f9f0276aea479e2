"""Every query of the review engine that has SQL agrees with DuckDB."""

import oracle_check as oracle
import pytest

from siftlight.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert oracle.difference(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) == ([], [])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.rating >= 2 for r in rows)
