"""Readers: tables, payloads, feature layers."""

from sensorgrid.sources.layers import (
    feature_table_name,
    layer_catalog,
    layer_name,
    layer_tables,
    open_layers,
    request_grid,
)
from sensorgrid.sources.payloads import (
    explode_directory,
    explode_feed,
    flatten_weather,
    parse_station_csv,
    parse_wkt_point,
)
from sensorgrid.sources.tables import (
    at_time,
    latest,
    latest_time,
    read_jdbc,
    read_query,
    read_table,
    time_range,
)

__all__ = [
    "at_time", "explode_directory", "explode_feed", "feature_table_name", "flatten_weather",
    "latest", "latest_time", "layer_catalog", "layer_name", "layer_tables", "open_layers",
    "parse_station_csv", "parse_wkt_point", "read_jdbc", "read_query", "read_table",
    "request_grid", "time_range",
]
