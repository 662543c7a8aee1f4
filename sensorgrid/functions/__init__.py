"""Column expressions. All of them are built-in Spark functions, no Python UDF."""

from sensorgrid.functions.aqi import PM25_BANDS, aqi_pm25, rescale
from sensorgrid.functions.geo import (
    EARTH_RADIUS_M,
    haversine,
    inverse_distance_weight,
    wkt_lat,
    wkt_lon,
    wkt_paths,
    wkt_point,
    wkt_rings,
)
from sensorgrid.functions.sql import register_sql_functions
from sensorgrid.functions.text import (
    empty_to_null,
    feature_key,
    feature_table,
    layer_of_table,
    parse_loose_timestamp,
    time_of_file,
    unquote,
    zero_to_null,
)
from sensorgrid.functions.time import hour_of, local_to_utc, unix_seconds, utc_to_local

__all__ = [
    "EARTH_RADIUS_M", "PM25_BANDS", "aqi_pm25", "empty_to_null", "feature_key",
    "feature_table", "haversine", "hour_of", "inverse_distance_weight",
    "layer_of_table", "local_to_utc", "parse_loose_timestamp",
    "register_sql_functions", "rescale",
    "time_of_file", "unix_seconds", "unquote", "utc_to_local", "wkt_lat", "wkt_lon",
    "wkt_paths", "wkt_point", "wkt_rings", "zero_to_null",
]
