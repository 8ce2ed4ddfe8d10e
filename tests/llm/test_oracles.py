import pytest
from oracle import DATA, assert_same

from quern.llm.oracles import ORACLES
from quern.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, str(DATA)), ORACLES[name])
