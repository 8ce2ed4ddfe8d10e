import pytest
from oracle import DATA, assert_same

import __spark_entry__ as entry
from quern.plans.reference import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, str(DATA)), ORACLES[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["doc_id", "words", "read_min"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_every_query_has_sql_and_rows(spark):
    assert set(QUERIES) == set(ORACLES)
    assert all(not QUERIES[name](spark, str(DATA)).isEmpty() for name in QUERIES)
