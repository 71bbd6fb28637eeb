import pytest

from duck_compare import compare
from strataleaf.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, name, registry.queries()[name], registry.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 11)]
