import pytest

from compare import DATA, assert_same
from deskloom.llm.queries import ORACLES, QUERIES


@pytest.mark.skipif(not DATA.exists(), reason="no data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.skipif(not DATA.exists(), reason="no data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0


FOUND = {
    "p1_found": "episode_a string, episode_b string, field_name string", "p2_found": "episode_id string, turn_no bigint, tweet_id bigint, speaker string", "p3_found": "first_id string, episode_id string",
    "p4_found": "episode_id string, field_name string, pii_kind string", "p5_found": "episode_id string", "p6_found": "episode_id string, intent string", "p7_found": "episode_a string, episode_b string", "p10_found": "doc_id bigint",
}


@pytest.mark.skipif(not DATA.exists(), reason="no data")
@pytest.mark.parametrize("name", FOUND)
def test_found_columns(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == FOUND[name]
    rows = df.collect()
    assert len(rows) == len(set(rows))
