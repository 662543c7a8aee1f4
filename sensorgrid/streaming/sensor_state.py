"""Per-sensor state of a stream: the newest time seen of every sensor.

The state of a micro-batch is read and written for the sensors in that batch only. It lives
in the state store beside the offsets, so a batch repeated after a failure starts from the
state before it. Rows pass in Arrow batches; a sensor with many rows in one micro-batch is
read piece by piece and never held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    DataType,
    IntegralType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from sensorgrid.session import SETTINGS

_KEY, _MICROS, _NO_SENSOR = "_sensor_key", "_micros", "-"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class NewerThanState(StatefulProcessor):
    """Passes the rows of a sensor that are newer than its newest row of earlier batches.

    A sensor without state passes all its rows, as do rows without a sensor. With `idle_ms`
    a timer, set anew by every batch of the sensor, forgets it after so long a silence.
    """

    def __init__(self, columns: list[str], idle_ms: int | None):
        self.columns, self.idle_ms = columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "micros long")
        self.timer = handle.getValueState("timer", "due long")

    def _keep(self, micros: int | None, timers) -> None:
        if micros is not None:
            self.newest.update((micros,))
        if self.idle_ms is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            due = timers.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(int(initialState.iloc[0, 1]), timerValues)

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        known = self.newest.get()[0] if self.newest.exists() else None
        last = known
        for piece in rows:
            if piece.empty:  # a sensor of the initial state without rows
                continue
            # beside an initial state the pieces come without names
            piece = piece.set_axis([_KEY, _MICROS, *self.columns], axis=1)
            micros = pd.to_numeric(piece[_MICROS]).astype("Int64")
            seen = micros.max()
            if not pd.isna(seen):
                last = int(seen) if last is None else max(last, int(seen))
            if known is not None:
                piece = piece[(micros > known).fillna(False).to_numpy(bool)]
            yield piece[self.columns]
        if key[0] != _NO_SENSOR:
            self._keep(last, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.timer.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def newer_than_state(
    readings: DataFrame,
    stored: DataFrame | None = None,
    key: str = "id",
    ts_col: str = "ts",
    idle_hours: float | None = None,
) -> DataFrame:
    """Stream of the readings newer than the newest reading of their sensor in earlier batches.

    Equal times inside a batch all stay. A row without a time passes only while its sensor
    has no known time. `stored` (key, ts) gives the newest times before the first batch and
    is not read again on a restart. After `idle_hours` without rows a sensor is forgotten.
    Keyed state needs the RocksDB store, so the session is set to it.
    """
    readings.sparkSession.conf.set(_PROVIDER, SETTINGS[_PROVIDER])
    fields = readings.schema.fields
    packed = readings.select(
        sensor_key(key).alias(_KEY),
        F.unix_micros(F.col(ts_col).cast("timestamp")).cast("string").alias(_MICROS),
        *[_there(f.name, f.dataType).alias(f.name) for f in fields],
    )
    seed = None
    if stored is not None:
        seed = (
            stored.where(F.col(key).isNotNull() & F.col(ts_col).isNotNull())
            .groupBy(sensor_key(key).alias(_KEY))
            .agg(F.unix_micros(F.max(F.col(ts_col).cast("timestamp"))).alias(_MICROS))
            .groupBy(_KEY)
        )
    trip = StructType([
        StructField(f.name, StringType() if _as_text(f.dataType) else f.dataType) for f in fields
    ])
    idle = None if idle_hours is None else int(idle_hours * 3_600_000)
    passed = packed.groupBy(_KEY).transformWithStateInPandas(
        statefulProcessor=NewerThanState([f.name for f in fields], idle),
        outputStructType=trip,
        outputMode="Append",
        timeMode="None" if idle is None else "ProcessingTime",
        initialState=seed,
    )
    return passed.select(*[_back(f.name, f.dataType).alias(f.name) for f in fields])


def sensor_key(key: str) -> Column:
    """A text for every sensor and one for rows without."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(_NO_SENSOR))


def _as_text(kind: DataType) -> bool:
    """Whether pandas would round a column of this type where it holds nulls, or bound its range."""
    return isinstance(kind, (IntegralType, TimestampType))


def _there(name: str, kind: DataType) -> Column:
    if isinstance(kind, TimestampType):
        return F.unix_micros(F.col(name)).cast("string")
    return F.col(name).cast("string") if _as_text(kind) else F.col(name)


def _back(name: str, kind: DataType) -> Column:
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(F.col(name).cast("long"))
    return F.col(name).cast(kind)
