"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from tests.conftest import SF

ORACLES = entry.oracle_sql()
# no row at the smallest scale: 200 documents hold no hit
EMPTY = {"sec_locations"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    problem, rows, _ = compare(spark, con, SF, entry.queries()[name], ORACLES[name])
    assert problem is None
    assert rows > 0 or name in EMPTY


def test_every_query_is_known():
    assert set(ORACLES) <= set(entry.queries())


def test_each_rule_is_hit(spark):
    from corpusreview import constants as K

    rules = {r["rule"] for r in entry.queries()["all_smells"](spark, SF).select("rule").distinct().collect()}
    assert rules == set(K.SMELL_TEXT)
    types = {r["type"] for r in entry.queries()["security_scan"](spark, SF).select("type").distinct().collect()}
    assert types == {name for name, _ in K.SECURITY_RULES}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
