"""Text queries with a SQL counterpart against it."""

import pytest
from compare import compare, connect

from geotrail.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op11_url_filters", "op12_vector_codes", "op13_periodic_runs"])
def test_query(spark, folder, name):
    rows, extra, missing = compare(spark, connect(folder), QUERIES[name], ORACLE[name], folder)
    assert rows and (extra, missing) == (0, 0)
