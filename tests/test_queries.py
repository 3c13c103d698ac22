"""Every query of the message operators has the rows that its SQL finds in the facts behind the messages."""

import pytest

from rxweave.plans.queries import ORACLES, QUERIES


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(compare, name):
    compare(QUERIES, ORACLES, name)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
