"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from lodestone import registry
from tools.check import compare, oracle

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


#: Queries that plain SQL cannot tell, and what tests them instead.
WITHOUT_SQL = {
    "emb_02_model_embedder": "a stand-in model; test_search",
    "kg_05_similar_names": "an ordered fold; test_faults against plain Python",
    "ver_04_contradictions": "test_knowledge",
    "evl_11_actor_accuracy": "test_knowledge",
}


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) - set(registry.sql()) <= set(WITHOUT_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note, *_ = compare(spark, con, SF, registry.queries()[name], registry.sql().get(name))
    assert ok is not False, note
    assert ok or name in WITHOUT_SQL
