"""Sensors that report through two channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MERGES = {"max": F.max, "min": F.min, "avg": F.avg}


def merge_channels(
    readings: DataFrame,
    how: str = "avg",
    id_col: str = "id",
    ts_col: str = "ts",
    value_col: str = "value",
) -> DataFrame:
    """(id, ts, value): the max, min or avg over the channels of a sensor."""
    return readings.groupBy(id_col, ts_col).agg(_MERGES[how](value_col).alias(value_col))


def select_channel(
    readings: DataFrame, only: str | None = None, exclude: str | None = None
) -> DataFrame:
    """Readings of channel `only`, or of every channel but `exclude`."""
    if (only is None) == (exclude is None):
        raise ValueError("give exactly one of only and exclude")
    channel = F.col("channel")
    return readings.where(channel == only if only is not None else channel != exclude)


def channel_readings(
    readings: DataFrame,
    how: str,
    id_col: str = "id",
    ts_col: str = "ts",
    value_col: str = "value",
) -> DataFrame:
    """(id, ts, value) by name: 'max' / 'min' / 'avg' merge, 'a' / 'b' select."""
    if how in _MERGES:
        return merge_channels(readings, how, id_col, ts_col, value_col)
    return select_channel(readings, only=how).select(id_col, ts_col, value_col)


def with_directory(readings: DataFrame, directory: DataFrame) -> DataFrame:
    """Add `id` and `channel` of each reading's `sensor_id`."""
    return readings.join(directory.select("sensor_id", "id", "channel"), "sensor_id")


def near_sensors(distances: DataFrame, max_dist: float = 50, dist_col: str = "distance") -> DataFrame:
    """Rows of the near list within `max_dist`, both ends of the range included."""
    return distances.where(F.col(dist_col) <= max_dist)


def near_only(
    readings: DataFrame,
    near: DataFrame,
    max_dist: float = 50,
    id_col: str = "id",
    dist_col: str = "distance",
) -> DataFrame:
    """Readings joined to the ids of the near list; a repeated id repeats its readings."""
    return readings.join(near_sensors(near, max_dist, dist_col).select(id_col), id_col)


def split_channels(directory: DataFrame, parent_col: str = "parent_id") -> DataFrame:
    """Add `channel`: 'a' where a parent id is present (not null, not 0), else 'b'."""
    parent = F.col(parent_col)
    present = parent.isNotNull() & (parent.cast("string") != "0") & (parent.cast("string") != "")
    return directory.withColumn("channel", F.when(present, "a").otherwise("b"))


def has_point(df: DataFrame, lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """Rows with both coordinates present and non-zero."""
    return df.where(
        F.col(lon_col).isNotNull() & F.col(lat_col).isNotNull()
        & (F.col(lon_col) != 0) & (F.col(lat_col) != 0)
    )
