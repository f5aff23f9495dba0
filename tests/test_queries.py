import pytest

from factloom.plans import catalogue
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    mine, theirs = both(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    assert mine == theirs and (mine or name in ("overridden_rules",))
