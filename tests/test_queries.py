import pytest
from oracle import check

from marlstone.operators import queries as general
from marlstone.plans import queries as plans

QUERIES = general.QUERIES | plans.QUERIES
ORACLE = general.ORACLE | plans.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLE.get(name))


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_filters_and_columns_reach_the_scan(spark, capsys):
    from oracle import DATA

    QUERIES["dense_knn_filtered"](spark, str(DATA)).explain("formatted")
    QUERIES["answers_top3"](spark, str(DATA)).explain("formatted")
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
