"""Incremental ingest: late rows, repeated pulls, new stations, row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.operators.numbering import number_rows


def latest_by(stored: DataFrame, key: str = "id", ts_col: str = "ts") -> DataFrame:
    """(key, max_ts)."""
    return stored.groupBy(key).agg(F.max(ts_col).alias("max_ts"))


def drop_late(
    batch: DataFrame, stored: DataFrame, key: str = "id", ts_col: str = "ts"
) -> DataFrame:
    """Rows of `batch` newer than the newest stored row of their key.

    A key that is not stored yet keeps all its rows, and equal rows inside the batch stay.
    """
    return newer_than(batch, latest_by(stored, key, ts_col), key, ts_col)


def newer_than(
    batch: DataFrame, latest: DataFrame, key: str = "id", ts_col: str = "ts"
) -> DataFrame:
    """`drop_late` against a (key, max_ts) table, one row per key."""
    return (
        batch.join(latest, key, "left")
        .where(F.col("max_ts").isNull() | (F.col(ts_col) > F.col("max_ts")))
        .drop("max_ts")
    )


def skip_seen(batch: DataFrame, stored: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Rows of `batch` whose time is not the newest stored time (a repeated pull)."""
    last = stored.agg(F.max(ts_col).alias(ts_col))
    return batch.join(last, ts_col, "left_anti")


def with_uid(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    stored: DataFrame | None = None,
    uid_col: str = "uid",
) -> DataFrame:
    """Add consecutive ids that continue after the largest stored id."""
    start: int | Column = 1
    if stored is not None:
        start = F.coalesce(stored.agg(F.max(uid_col)).scalar(), F.lit(0)) + 1
    return number_rows(df, order, bucket, start=start, out=uid_col)


def new_stations(batch: DataFrame, known: DataFrame, id_col: str = "station_id") -> DataFrame:
    """(id, lon, lat) of the coordinate pairs of `batch` that `known` lacks.

    Ids continue after the largest known one, in (lon, lat) order. A pair that lacks a
    coordinate is no station. Pairs are numbered in strips of about a hundred metres.
    """
    located = batch.select("lon", "lat").where("lon is not null and lat is not null").distinct()
    unseen = located.join(known, ["lon", "lat"], "left_anti")
    return with_uid(unseen, ["lon", "lat"], F.floor(F.col("lon") * 1000), known, id_col).select(
        id_col, "lon", "lat"
    )


def upsert_stations(
    batch: DataFrame, known: DataFrame, id_col: str = "station_id"
) -> tuple[DataFrame, DataFrame]:
    """(batch with station id, all stations); unseen coordinate pairs get new ids.

    Rows that lack a coordinate stay, without a station.
    """
    stations = known.select(id_col, "lon", "lat").unionByName(new_stations(batch, known, id_col))
    return batch.join(stations, ["lon", "lat"], "left"), stations
