"""Concentration to air-quality-index conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# PM2.5 bands as (low, high, index low, index high), high end open.
PM25_BANDS = (
    (0.0, 12.0, 0.0, 50.0),
    (12.0, 35.5, 50.0, 100.0),
    (35.5, 55.5, 100.0, 150.0),
    (55.5, 150.5, 150.0, 200.0),
    (150.5, 250.5, 200.0, 300.0),
    (250.5, 350.5, 300.0, 400.0),
    (350.5, 500.5, 400.0, 500.0),
)


def rescale(value: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Map [low, high] linearly onto [to_low, to_high]."""
    share = (value - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.lit(float(to_low)) + share * F.lit(float(to_high) - float(to_low))


def aqi_pm25(concentration: Column) -> Column:
    """Index of a PM2.5 concentration; null outside every band."""
    out = None
    for low, high, to_low, to_high in PM25_BANDS:
        inside = (concentration >= low) & (concentration < high)
        scaled = rescale(concentration, low, high, to_low, to_high)
        out = F.when(inside, scaled) if out is None else out.when(inside, scaled)
    return out
