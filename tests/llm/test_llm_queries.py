import pytest
from oracle import check

from marlstone.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLE.get(name))
