from __future__ import annotations

import time
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sensorgrid.operators.rollup import median_by, near_full_hour
from sensorgrid.streaming import (
    dedupe_stream,
    hourly_median_stream,
    stream_drop_late,
    write_stream,
)

SCHEMA = "id string, ts timestamp, value double"


def clock(h, m, s=0):
    return datetime(2024, 1, 1, h, m, s)


def drop_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_across_batches(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    stored = spark.createDataFrame([("s1", clock(10, 0), 0.0)], SCHEMA)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        stream_drop_late(stream, out, mark, stored).awaitTermination()
        return sorted((r.id, r.ts, r.value) for r in
                      spark.read.schema(SCHEMA).parquet(out + "/rows").collect())

    drop_file(spark, folder, [
        ("s1", clock(10, 0), 1.0), ("s1", clock(10, 1), 2.0), ("s1", clock(10, 1), 3.0),
        ("s2", clock(1, 0), 4.0),
    ])
    first = [("s1", clock(10, 1), 2.0), ("s1", clock(10, 1), 3.0), ("s2", clock(1, 0), 4.0)]
    assert run() == first
    drop_file(spark, folder, [
        ("s1", clock(10, 1), 5.0), ("s1", clock(10, 2), 6.0), ("s2", clock(0, 59), 7.0),
    ])
    assert run() == sorted([*first, ("s1", clock(10, 2), 6.0)])


def test_state_follows_the_sensors_of_the_batch(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    counts = []
    for minute, sensors in ((0, 40), (1, 3)):
        drop_file(spark, folder, [(f"s{i}", clock(10, minute), 1.0) for i in range(sensors)])
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        query = stream_drop_late(stream, out, mark)
        query.awaitTermination()
        counts.append(query.lastProgress["stateOperators"][0]["numRowsUpdated"])
    assert counts[1] < 10 < counts[0]
    assert spark.read.parquet(out + "/rows").count() == 43


def test_rows_without_sensor_or_time_and_exact_numbers(spark, tmp_path):
    """Null ids pass; null times pass while nothing is known; longs with nulls stay exact."""
    schema = "id long, ts timestamp, n long, far timestamp"
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    big, far = 2**62 + 1, datetime(3000, 1, 1)
    batches = [
        [(None, clock(9, 0), big, far), (1, None, None, None), (1, clock(10, 0), big, far)],
        [(None, clock(8, 0), None, None), (1, None, 5, None), (1, clock(9, 0), 6, None),
         (1, clock(11, 0), big, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        stream_drop_late(stream, out, mark).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out + "/rows").collect()]
    want = [*batches[0], batches[1][0], batches[1][3]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_an_idle_sensor_is_forgotten(spark, tmp_path):
    """The second row is late, but comes when the sensor has been silent too long."""
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    drop_file(spark, folder, [("s1", clock(10, 5), 1.0)])
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    with pytest.raises(ValueError):
        stream_drop_late(stream, out, mark, idle_hours=1, trigger={"availableNow": True})
    query = stream_drop_late(stream, out, mark, idle_hours=1 / 3600,
                             trigger={"processingTime": "200 milliseconds"})

    def rows_within(seconds, wanted):
        found, end = 0, time.time() + seconds
        while found != wanted and time.time() < end:
            time.sleep(0.5)
            try:
                found = spark.read.schema(SCHEMA).parquet(out + "/rows").count()
            except AnalysisException:  # nothing written yet
                pass
        return found

    try:
        assert rows_within(30, 1) == 1
        time.sleep(6)
        drop_file(spark, folder, [("s1", clock(10, 4), 2.0)])
        assert rows_within(30, 2) == 2
    finally:
        query.stop()


def test_hourly_medians_equal_the_batch_result(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = [("s1", clock(h, m), float(h * m)) for h in range(8) for m in (1, 5, 9, 30, 52, 58)]
    drop_file(spark, folder, rows)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    medians = hourly_median_stream(stream, "id", value_col="value")
    write_stream(medians, out, mark).awaitTermination()
    got = {(r.anchor, r["median"]) for r in spark.read.parquet(out).collect()}
    batch = median_by(near_full_hour(spark.createDataFrame(rows, SCHEMA)), ["anchor", "id"])
    closed = batch.where(F.col("anchor") <= F.lit(clock(7, 0)))
    assert got == {(r.anchor, r["median"]) for r in closed.collect()}


def test_repeated_pulls_pass_once(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for _ in range(2):
        drop_file(spark, folder, [("s1", clock(10, 0), 1.0), ("s2", clock(10, 0), 1.0)])
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        write_stream(dedupe_stream(stream, ["id", "ts"]), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2
