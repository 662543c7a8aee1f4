"""Structured Streaming forms of the incremental steps.

State, offsets and outputs live under a folder all executors reach; pass one from
`sensorgrid.shared_dir`, or your own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorgrid.operators.rollup import near_full_hour
from sensorgrid.streaming.sensor_state import newer_than_state


def stream_drop_late(
    readings: DataFrame,
    path: str,
    checkpoint: str,
    stored: DataFrame | None = None,
    key: str = "id",
    ts_col: str = "ts",
    trigger: dict | None = None,
    idle_hours: float | None = None,
) -> StreamingQuery:
    """Append each micro-batch's rows newer than the newest known row of their sensor.

    Accepted rows go to `path`/rows, each once. The newest times are state per sensor (see
    `newer_than_state`), seeded by `stored`: a batch touches those of its own sensors.
    With `idle_hours` the query needs a trigger that keeps running, as its timers follow the
    clock; without `trigger` it then looks every minute.
    """
    if idle_hours is not None:
        trigger = trigger or {"processingTime": "1 minute"}
        if "processingTime" not in trigger:
            raise ValueError("idle_hours needs a processingTime trigger")
    passed = newer_than_state(readings, stored, key, ts_col, idle_hours)
    return write_stream(passed, f"{path}/rows", checkpoint, trigger)


def hourly_median_stream(
    samples: DataFrame,
    id_col: str = "sensor_id",
    ts_col: str = "ts",
    value_col: str = "pm2_5",
    half_minutes: float = 10,
    late: str = "10 minutes",
) -> DataFrame:
    """(anchor, id, median) per sensor and full hour, for append mode.

    An hour is emitted once the watermark is past it, so each is emitted once.
    """
    marked = samples.withWatermark(ts_col, late)
    near = near_full_hour(marked, ts_col, half_minutes)
    window = F.window(F.col(ts_col), "1 hour", "1 hour", "30 minutes")
    return (
        near.groupBy(window.alias("_hour"), id_col)
        .agg(F.percentile(value_col, 0.5).alias("median"))
        .select((F.col("_hour.start") + F.expr("interval 30 minutes")).alias("anchor"),
                id_col, "median")
    )


def dedupe_stream(
    pulls: DataFrame, keys: list[str], ts_col: str = "ts", late: str = "2 hours"
) -> DataFrame:
    """First row of every key; keys are forgotten once the watermark is past them."""
    return pulls.withWatermark(ts_col, late).dropDuplicatesWithinWatermark(keys)


def write_stream(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream to parquet files."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
