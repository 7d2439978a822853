"""Every query that has SQL against it, on the smallest tables."""

import pytest

from quillgrid.plans import registry
from tests.compare import check

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf_dir, name):
    check(spark, duck, registry.queries()[name], registry.oracle_sql()[name], sf_dir)


def test_every_query_with_sql_is_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
