"""Station panels: complete timestamps, dense series, support gates, hold-out splits."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def station_count(obs: DataFrame, id_col: str = "station_id") -> DataFrame:
    """One row `n_stations`."""
    return obs.select(id_col).distinct().agg(F.count(id_col).alias("n_stations"))


def times_per_station(obs: DataFrame, id_col: str = "station_id", ts_col: str = "ts") -> DataFrame:
    """(id, times): the ascending distinct timestamps of every station."""
    return (
        obs.select(id_col, ts_col)
        .distinct()
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(ts_col)).alias("times"))
    )


def complete_times(obs: DataFrame, id_col: str = "station_id", ts_col: str = "ts") -> DataFrame:
    """(ts): timestamps whose row count equals the number of distinct stations.

    Rows without a station do not count.
    """
    obs = obs.where(F.col(id_col).isNotNull())
    n = station_count(obs, id_col)
    rows = obs.groupBy(ts_col).agg(F.count(F.lit(1)).alias("_rows"))
    return rows.where(F.col("_rows") == n.scalar()).select(ts_col)


def one_row_per_slot(
    obs: DataFrame, id_col: str = "station_id", ts_col: str = "ts", label_col: str = "label"
) -> DataFrame:
    """(id, ts, label): duplicates of a slot averaged, a missing label as 0.0.

    Rows without a station are left out.
    """
    return obs.where(F.col(id_col).isNotNull()).groupBy(id_col, ts_col).agg(
        F.coalesce(F.avg(label_col), F.lit(0.0)).alias(label_col)
    )


def series(
    obs: DataFrame, id_col: str = "station_id", ts_col: str = "ts", label_col: str = "label"
) -> DataFrame:
    """(id, series): labels of every station over the complete timestamps, ascending.

    Slots without a label hold 0.0. Without any complete timestamp there are no rows.
    """
    slots = one_row_per_slot(obs, id_col, ts_col, label_col)
    kept = slots.join(complete_times(slots, id_col, ts_col), ts_col, "left_semi")
    return _collect_series(kept, id_col, ts_col, label_col)


def series_tolerant(
    obs: DataFrame,
    base: DataFrame | None = None,
    tolerance: int = 31,
    id_col: str = "station_id",
    ts_col: str = "ts",
    label_col: str = "label",
) -> DataFrame:
    """Like `series`, for networks with gaps.

    Stations with at least (distinct times of `base` - `tolerance`) readings stay;
    the slots are the times of `base` that all staying stations have. `base`
    defaults to `obs` itself.
    """
    slots = one_row_per_slot(obs, id_col, ts_col, label_col)
    base_times = (obs if base is None else base).select(ts_col).distinct()
    stations = tolerant_stations(obs, base, tolerance, id_col, ts_col)
    kept = slots.join(stations, id_col, "left_semi")
    n_kept = stations.agg(F.count(id_col))
    shared = (
        kept.groupBy(ts_col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == n_kept.scalar())
        .join(base_times, ts_col, "left_semi")
        .select(ts_col)
    )
    return _collect_series(kept.join(shared, ts_col, "left_semi"), id_col, ts_col, label_col)


def tolerant_stations(
    obs: DataFrame, base: DataFrame | None = None, tolerance: int = 31,
    id_col: str = "station_id", ts_col: str = "ts",
) -> DataFrame:
    """(id) of the stations that stay in `series_tolerant`, whether they share a time or not."""
    n_base = (obs if base is None else base).select(ts_col).distinct().agg(F.count(ts_col))
    slots = obs.where(F.col(id_col).isNotNull()).select(id_col, ts_col).distinct()
    return (
        slots.groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= n_base.scalar() - tolerance)
        .select(id_col)
    )


def as_vector(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Turn an array<double> column into an ML vector column."""
    return df.withColumn(out or col, array_to_vector(F.col(col)))


def eligible_times(
    obs: DataFrame,
    ts_col: str = "ts",
    min_rows: int | None = None,
    frac: float | None = None,
    id_col: str = "station_id",
    stations: DataFrame | None = None,
) -> DataFrame:
    """(ts, n_rows) of the timestamps with enough rows.

    Enough is `min_rows`, or `frac` of the distinct stations cut to a whole number.
    """
    if (min_rows is None) == (frac is None):
        raise ValueError("give exactly one of min_rows and frac")
    counts = obs.groupBy(ts_col).agg(F.count(F.lit(1)).alias("n_rows"))
    if min_rows is not None:
        return counts.where(F.col("n_rows") >= min_rows)
    n = station_count(obs if stations is None else stations, id_col)
    return counts.where(F.col("n_rows") >= station_threshold(n.scalar(), frac))


def station_threshold(n_stations: Column, frac: float) -> Column:
    """Whole number of stations that make up the share `frac`."""
    return F.floor(n_stations * F.lit(float(frac)))


def support_gate(
    obs: DataFrame,
    ts_col: str = "ts",
    min_rows: int | None = None,
    frac: float | None = None,
    id_col: str = "station_id",
    stations: DataFrame | None = None,
) -> DataFrame:
    """Rows of the timestamps with enough rows.

    Counting then semi-joining keeps a crowded timestamp spread over many tasks,
    which a count window per timestamp would not.
    """
    times = eligible_times(obs, ts_col, min_rows, frac, id_col, stations)
    return obs.join(times, ts_col, "left_semi")


def leave_one_out(
    raw: DataFrame, cleaned: DataFrame, station: str, id_col: str = "station_id"
) -> tuple[DataFrame, DataFrame]:
    """(train, test) for one held-out station: cleaned rows of the others, its own raw rows."""
    return cleaned.where(F.col(id_col) != station), raw.where(F.col(id_col) == station)


def leave_one_out_sizes(obs: DataFrame, id_col: str = "station_id") -> DataFrame:
    """(id, n_train, n_test) of every hold-out split, without building the splits."""
    total = obs.where(F.col(id_col).isNotNull()).agg(F.count(F.lit(1)))
    return (
        obs.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("n_test"))
        .withColumn("n_train", total.scalar() - F.col("n_test"))
    )


def _collect_series(slots: DataFrame, id_col: str, ts_col: str, label_col: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(ts_col, label_col)))
    return slots.groupBy(id_col).agg(
        F.transform(ordered, lambda slot: slot.getField(label_col)).alias("series")
    )
