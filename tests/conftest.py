import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from geotrail.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
START = datetime(2024, 3, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tests",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def points(spark):
    """Builds points from (device, x, y) in order of arrival, a second apart."""

    def build(*rows):
        return spark.createDataFrame(
            [
                (d, i, START + timedelta(seconds=i), float(x), float(y))
                for i, (d, x, y) in enumerate(rows)
            ],
            "device long, seq long, ts timestamp, x double, y double",
        )

    return build


@pytest.fixture
def fences(spark):
    """Builds fences from (id, wkt[, valid])."""
    from geotrail.sources.dimensions import fences_from_rows

    def build(*rows):
        full = [(r[0], r[1], START, r[2] if len(r) > 2 else True, 1) for r in rows]
        return fences_from_rows(spark, full)

    return build


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
