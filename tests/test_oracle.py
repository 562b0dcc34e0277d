import pytest

from shotledger.plans import ORACLE, QUERIES
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    same(spark, connection, QUERIES[name], ORACLE[name], SF)


def test_entry_has_columns(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["task_id", "n_prompts", "k_samples"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
