"""Band joins of samples to anchor times, medians, and the hourly rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.functions import aqi_pm25, hour_of
from sensorgrid.operators.joins import join_null_safe

_SECOND = 1_000_000
_TINY = 1e-290


def hourly_anchor(ts: Column) -> Column:
    """The full hour nearest to `ts`."""
    return hour_of(ts + F.expr("interval 30 minutes"))


def near_full_hour(samples: DataFrame, ts_col: str = "ts", half_minutes: float = 10) -> DataFrame:
    """Samples strictly within `half_minutes` of a full hour, with that hour as `anchor`.

    A half width of up to 30 minutes gives each sample one candidate hour, so this is a
    projection and a filter.
    """
    if half_minutes > 30:
        raise ValueError("hourly bands wider than 30 minutes overlap; use band_join")
    tagged = samples.withColumn("anchor", hourly_anchor(F.col(ts_col)))
    gap = F.abs(_micros(F.col(ts_col)) - _micros(F.col("anchor")))
    return tagged.where(gap < int(half_minutes * 60 * _SECOND))


def band_join(
    samples: DataFrame,
    anchors: DataFrame,
    half_minutes: float = 10,
    ts_col: str = "ts",
    anchor_col: str = "anchor",
) -> DataFrame:
    """Samples paired with every anchor less than `half_minutes` away.

    Time is cut into buckets as wide as the band: an anchor is listed in the two
    buckets or so that its band touches, a sample in one, and the join is an
    equality on the bucket with the exact test on top.
    """
    half = int(half_minutes * 60 * _SECOND)
    width = 2 * half
    centre = _micros(F.col(anchor_col))
    listed = anchors.select(anchor_col).distinct().withColumn(
        "_bucket", F.explode(F.sequence(_bucket(centre - half, width), _bucket(centre + half, width)))
    )
    placed = samples.withColumn("_bucket", _bucket(_micros(F.col(ts_col)), width))
    gap = F.abs(_micros(F.col(ts_col)) - _micros(F.col(anchor_col)))
    return placed.join(listed, "_bucket").where(gap < half).drop("_bucket")


def anchor_times(times: DataFrame, ts_col: str = "ts", after: Column | None = None) -> DataFrame:
    """Distinct times later than `after`, ascending, as `anchor`."""
    kept = times if after is None else times.where(F.col(ts_col) > after)
    return kept.select(F.col(ts_col).alias("anchor")).distinct().orderBy("anchor")


def pending_anchors(
    anchors: DataFrame, rolled: DataFrame, ts_col: str = "ts", anchor_col: str = "anchor"
) -> DataFrame:
    """Anchors newer than everything rolled up so far; all of them when nothing is."""
    last = rolled.agg(F.max(ts_col)).scalar()
    return anchors.where(last.isNull() | (F.col(anchor_col) > last))


def median_by(
    df: DataFrame, keys: Sequence[str], value_col: str = "value", out: str = "median"
) -> DataFrame:
    """(*keys, median): exact median, nulls skipped, null for a group of nulls.

    Copies of a value are counted map-side, so a group takes memory for its distinct
    values only. For groups with very many distinct values use `median_by_split`.
    """
    return df.groupBy(*keys).agg(F.percentile(value_col, 0.5).alias(out))


def median_by_split(
    df: DataFrame,
    keys: Sequence[str],
    value_col: str = "value",
    out: str = "median",
    levels: Sequence[int] = (12, 32),
) -> DataFrame:
    """`median_by` for groups too large for one task.

    Values are counted, then narrowed down to the middle ranks: values cut to the leading
    binary digits of each level are few, and their counts tell which cut values hold the
    middle; the next level only looks inside those. After the last level at most 2**21
    values of a group can be left, however many it had.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, F.col(value_col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    left = counted.where(F.col("_v").isNotNull())
    for depth, bits in enumerate(levels):
        left = _middle_cells(left.withColumn("_cut", _cut(F.col("_v"), bits)), keys, depth == 0)
    inside = Window.partitionBy(*keys, "_cut").orderBy("_v")
    middle = (
        left.withColumn("_to", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_c"))
        .where((F.col("_from") < F.col("_hi")) & (F.col("_to") >= F.col("_lo")))
    )
    picked = middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(out))
    return join_null_safe(counted.select(*keys).distinct(), picked, keys, "left")


def _middle_cells(values: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """Values in the cells (`_cut`) that hold the middle ranks of their group.

    Adds `_start`, the number of smaller values, and the middle ranks `_lo` and `_hi`.
    """
    held = [] if first else ["_start", "_lo", "_hi"]
    cells = values.groupBy(*keys, *held, "_cut").agg(F.sum("_c").alias("_m"))
    if first:
        group = Window.partitionBy(*keys)
        n = F.sum("_m").over(group)
        cells = (
            cells.withColumn("_start", F.lit(0).cast("long"))
            .withColumn("_lo", F.floor((n + 1) / 2))
            .withColumn("_hi", F.floor((n + 2) / 2))
        )
    parent = Window.partitionBy(*keys, "_start").orderBy("_cut")
    picked = (
        cells.withColumn("_end", F.col("_start") + F.sum("_m").over(parent))
        .withColumn("_begin", F.col("_end") - F.col("_m"))
        .where((F.col("_begin") < F.col("_hi")) & (F.col("_end") >= F.col("_lo")))
        .select(*keys, "_cut", F.col("_begin").alias("_start"), "_lo", "_hi")
    )
    return join_null_safe(values.drop(*held), picked, [*keys, "_cut"])


def with_aqi(
    df: DataFrame, concentration: str = "median", out: str = "aqi", drop_zero: bool = True
) -> DataFrame:
    """Add the PM2.5 index; rows without one are dropped, and with `drop_zero` index 0 too."""
    scored = df.withColumn(out, aqi_pm25(F.col(concentration))).where(F.col(out).isNotNull())
    return scored.where(F.col(out) != 0) if drop_zero else scored


def hourly_rollup(
    samples: DataFrame,
    locations: DataFrame,
    anchors: DataFrame | None = None,
    half_minutes: float = 10,
    drop_zero: bool = True,
    id_col: str = "sensor_id",
    ts_col: str = "ts",
    value_col: str = "pm2_5",
) -> DataFrame:
    """(ts, id, aqi, aqi_concentration, lon, lat) per sensor and full hour.

    The concentration is the median of the samples around the hour. With `anchors`
    only the listed hours are built. Sensors without a location are left out.
    """
    near = near_full_hour(samples, ts_col, half_minutes)
    if anchors is not None:
        near = near.join(anchors.select("anchor").distinct(), "anchor", "left_semi")
    medians = median_by(near, ["anchor", id_col], value_col, "aqi_concentration")
    placed = medians.join(locations.select(id_col, "lon", "lat"), id_col)
    return with_aqi(placed, "aqi_concentration", "aqi", drop_zero).select(
        F.col("anchor").alias("ts"), F.col(id_col).alias("id"), "aqi", "aqi_concentration",
        "lon", "lat",
    )


def _cut(value: Column, bits: int) -> Column:
    """`value` rounded down to `bits` leading binary digits.

    Powers of two are exact, so the cut never decreases as `value` grows.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    exponent = (
        F.when(F.pow(F.lit(2.0), guess) > size, guess - 1)
        .when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1)
        .otherwise(guess)
    )
    scale = F.pow(F.lit(2.0), exponent - (bits - 1))
    # below _TINY the scale could be no power of two that a double holds
    plain = (size < _TINY) | F.isnan(value) | (size == float("inf"))
    return F.when(plain, value).otherwise(F.floor(value / scale) * scale)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _bucket(micros: Column, width: int) -> Column:
    return F.floor(micros / F.lit(width)).cast("long")
