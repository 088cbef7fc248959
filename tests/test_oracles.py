import pytest

from compare import DATA, assert_same
from deskloom.oracles import ORACLES
from deskloom.queries import QUERIES


@pytest.mark.skipif(not DATA.exists(), reason="no data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.skipif(not DATA.exists(), reason="no data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
