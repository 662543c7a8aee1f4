"""The row functions under SQL names, for queries that are plain text.

They are SQL functions, not Python ones: Spark puts their body in place of the call, so a query
has the plan of the column form, filters on them included.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sensorgrid.functions.aqi import PM25_BANDS
from sensorgrid.functions.geo import EARTH_RADIUS_M

_RESCALE = "to_low + (value - low) / (high - low) * (to_high - to_low)"


def _bands() -> str:
    """CASE branches of the index bands."""
    return " ".join(
        f"WHEN concentration >= {low!r}D AND concentration < {high!r}D THEN "
        f"{to_low!r}D + (concentration - {low!r}D) / {high - low!r}D * {to_high - to_low!r}D"
        for low, high, to_low, to_high in PM25_BANDS
    )


def definitions() -> dict[str, str]:
    """Signature and body of each function, by name."""
    half = "power(sin(radians({b} - {a}) / 2), 2)"
    across = half.format(a="lon_a", b="lon_b")
    up = half.format(a="lat_a", b="lat_b")
    return {
        "rescale": "(value DOUBLE, low DOUBLE, high DOUBLE, to_low DOUBLE, to_high DOUBLE) "
        f"RETURNS DOUBLE RETURN {_RESCALE}",
        "aqi_pm25": f"(concentration DOUBLE) RETURNS DOUBLE RETURN CASE {_bands()} END",
        "inverse_distance_weight": "(distance DOUBLE, power DOUBLE) RETURNS DOUBLE "
        "RETURN CASE WHEN distance <> 0 THEN 1 / power(distance, power) END",
        "distance_m": "(lon_a DOUBLE, lat_a DOUBLE, lon_b DOUBLE, lat_b DOUBLE) RETURNS DOUBLE "
        f"RETURN {2 * EARTH_RADIUS_M!r}D * asin(sqrt({up} + cos(radians(lat_a)) * "
        f"cos(radians(lat_b)) * {across}))",
        "zero_to_null": "(value DOUBLE) RETURNS DOUBLE RETURN nullif(value, 0)",
        "rings": "(step INT, max_radius INT) RETURNS TABLE (buffer_size INT) "
        "RETURN SELECT explode(sequence(step, max_radius, step)) AS buffer_size",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Define all functions for the session, and return their names; again is no error."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
