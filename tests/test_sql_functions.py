"""The SQL functions against their column forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensorgrid.functions import (
    aqi_pm25, haversine, inverse_distance_weight, register_sql_functions, rescale,
)


@pytest.fixture(scope="module")
def rows(spark):
    assert register_sql_functions(spark) == register_sql_functions(spark)
    values = [None, -1.0, 0.0, 6.0, 11.9999, 12.0, 35.5, 103.0, 200.5, 500.49, 500.5]
    return spark.createDataFrame([(v, float(i), 3.0 * i) for i, v in enumerate(values)],
                                 "v double, lon double, lat double")


@pytest.mark.parametrize("text, column", [
    ("aqi_pm25(v)", lambda: aqi_pm25(F.col("v"))),
    ("rescale(v, 1, 5, 10, -30)", lambda: rescale(F.col("v"), 1, 5, 10, -30)),
    ("inverse_distance_weight(v, 2)", lambda: inverse_distance_weight(F.col("v"), 2)),
    ("inverse_distance_weight(v, 1)", lambda: inverse_distance_weight(F.col("v"))),
    ("distance_m(lon, lat, v, 5)", lambda: haversine(
        F.col("lon"), F.col("lat"), F.col("v"), F.lit(5.0))),
    ("zero_to_null(v)", lambda: F.nullif("v", F.lit(0.0))),
])
def test_equals_the_column_form(rows, text, column):
    found = rows.select(F.expr(text).alias("sql"), column().alias("column")).collect()
    for row in found:
        assert (row["sql"] is None) == (row["column"] is None)
        assert row["sql"] is None or row["sql"] == pytest.approx(row["column"], rel=1e-12)


def test_rings_are_a_table_function(spark, rows):
    found = spark.sql("SELECT * FROM rings(250, 1000)").collect()
    assert [r.buffer_size for r in found] == [250, 500, 750, 1000]


def test_body_takes_the_place_of_the_call(rows):
    plan = rows.select(F.expr("aqi_pm25(v)"))._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan and "Python" not in plan
