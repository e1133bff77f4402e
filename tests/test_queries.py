"""Every query of the core against its SQL, on the smallest test data."""

import pytest
from conftest import DATA, same

from mnestra.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    same(core.queries()[name](spark, DATA), duck, core.oracle_sql()[name])


def test_every_core_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())


def test_registry_without_training_subpackage(spark):
    import __spark_entry__ as entry

    assert set(core.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, duck):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
