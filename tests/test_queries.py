import pytest

from compare import same
from engramma import registry


#: Queries that SQL does not express; test_plain_python.py and test_maxsim.py hold them against plain Python.
WITHOUT_SQL = {"adaptive_search", "late_interaction_probed", "long_parts", "query_plans"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - WITHOUT_SQL))
def test_query_equals_its_sql(name, spark, sf, duck):
    same(registry.queries()[name](spark, sf), duck.sql(registry.oracle_sql()[name]))


def test_every_other_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT_SQL


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
