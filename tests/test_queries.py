import pytest

from tests.oracle import differences
from tidemark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], SF) == []


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLE_SQL} - {"ablation", "perm_importance", "paired_bootstrap_10000"}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
