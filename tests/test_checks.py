"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from checks.registry import ORACLES  # noqa: E402
from checks.verify import compare  # noqa: E402

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"station_id", "rmse", "mae", "n"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, SF)[0] == "ok"
