import pytest

import __spark_entry__ as E
from silvaframe.plans import catalogue

Q, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_contract():
    assert set(SQL) <= set(Q)
    assert set(Q) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, same, name):
    same(spark, Q[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL) - {"rf_topk", "rff_topk", "cv_scores", "duplicate_outlines", "greedy_match"}))
def test_runs(spark, name):
    assert Q[name](spark, "/root/testdata/sf0.001").columns
