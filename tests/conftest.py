from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sensorgrid import get_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


def at(seconds: float) -> datetime:
    """Timestamp `seconds` after the epoch, as the UTC session collects it."""
    return datetime(1970, 1, 1) + __import__("datetime").timedelta(seconds=seconds)


@pytest.fixture(scope="session")
def obs(spark):
    """Builder of (station_id, ts, value) rows from (id, seconds, value)."""

    def build(rows, value="value"):
        schema = f"station_id string, ts timestamp, {value} double"
        return spark.createDataFrame([(i, at(t), v) for i, t, v in rows], schema)

    return build
