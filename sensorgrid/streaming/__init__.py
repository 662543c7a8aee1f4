"""Streaming forms of the incremental steps."""

from sensorgrid.streaming.sensor_state import newer_than_state
from sensorgrid.streaming.streams import (
    dedupe_stream,
    hourly_median_stream,
    stream_drop_late,
    write_stream,
)

__all__ = [
    "dedupe_stream", "hourly_median_stream", "newer_than_state", "stream_drop_late", "write_stream",
]
