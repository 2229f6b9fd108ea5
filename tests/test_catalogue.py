import pytest
from conftest import DATA, same_rows

import __spark_entry__ as contract
from assayframe.plans import catalogue, extended, extended_sql, oracle


ORACLES = oracle.ORACLES | extended_sql.ORACLES
#: held against brute force in test_ordered
WITHOUT = {"stratified_shuffle"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - WITHOUT))
def test_query_equals_its_sql(spark, db, name):
    same_rows(catalogue.QUERIES[name](spark, DATA), db.sql(ORACLES[name]))


def test_contract(spark):
    assert contract.entry(spark).count() == 1
    assert extended.query is catalogue.query and set(ORACLES) == set(catalogue.QUERIES) - WITHOUT
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_plans_push_down(spark):
    plan = catalogue.QUERIES["vote_long"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
