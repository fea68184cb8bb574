"""Every registered query against its SQL counterpart."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from geotrail.plans.checked import QUERIES


@pytest.fixture(scope="module")
def db(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, folder, name):
    _, extra, missing = compare(
        spark, db, contract.queries()[name], contract.oracle_sql()[name], folder
    )
    assert (extra, missing) == (0, 0)


def test_entry_has_the_known_number_of_events(spark):
    counts = contract.entry(spark).groupBy("event_type").count().collect()
    assert {r["event_type"]: r["count"] for r in counts} == {"enter": 850, "exit": 832}
