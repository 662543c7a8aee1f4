from __future__ import annotations

import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorgrid.functions import aqi_pm25, rescale
from sensorgrid.operators import channels, ingest, numbering, rollup
from sensorgrid.plans import networks

TEN = datetime(2024, 1, 1, 10)


def clock(h, m, s):
    return datetime(2024, 1, 1, h, m, s)


@pytest.fixture(scope="module")
def minutes(spark):
    rows = [(1, clock(9, 50, 0), 1.0), (1, clock(9, 50, 1), 6.0), (1, clock(10, 9, 59), 12.0),
            (1, clock(10, 10, 0), 100.0)]
    return spark.createDataFrame(rows, "sensor_id long, ts timestamp, pm2_5 double")


def test_band_is_open_on_both_sides(spark, minutes):
    near = rollup.near_full_hour(minutes).collect()
    assert sorted(r.pm2_5 for r in near) == [6.0, 12.0]
    anchors = spark.createDataFrame([(TEN,)], "anchor timestamp")
    general = rollup.band_join(minutes, anchors).collect()
    assert sorted(r.pm2_5 for r in general) == [6.0, 12.0]
    with pytest.raises(ValueError):
        rollup.near_full_hour(minutes, half_minutes=31)


def test_general_anchors_may_overlap(spark, minutes):
    anchors = spark.createDataFrame(
        [(clock(9, 55, 0),), (clock(10, 0, 0),), (clock(10, 5, 0),)], "anchor timestamp"
    )
    got = rollup.band_join(minutes, anchors, 10).groupBy("anchor").count().collect()
    assert {r.anchor.minute: r["count"] for r in got} == {55: 2, 0: 2, 5: 2}


def test_hourly_rollup(spark, minutes):
    places = spark.createDataFrame([(1, 2.0, 3.0)], "sensor_id long, lon double, lat double")
    row = rollup.hourly_rollup(minutes, places).first()
    assert (row.ts, row.id, row.aqi_concentration, row.aqi) == (TEN, 1, 9.0, 37.5)
    assert (row.lon, row.lat) == (2.0, 3.0)


def test_pending_anchors(spark):
    anchors = spark.createDataFrame([(clock(h, 0, 0),) for h in (1, 2, 3)], "anchor timestamp")
    rolled = spark.createDataFrame([(5, clock(2, 0, 0))], "uid long, ts timestamp")
    assert [r.anchor.hour for r in rollup.pending_anchors(anchors, rolled).collect()] == [3]
    assert rollup.pending_anchors(anchors, rolled.limit(0)).count() == 3


def test_roll_up_pending_numbers_on(spark, minutes):
    places = spark.createDataFrame([(1, 2.0, 3.0)], "sensor_id long, lon double, lat double")
    times = spark.createDataFrame([(TEN,)], "ts timestamp")
    rolled = spark.createDataFrame([(41, clock(9, 0, 0))], "uid long, ts timestamp")
    out = networks.roll_up_pending(minutes, places, times, rolled).collect()
    assert [r.uid for r in out] == [42]


@pytest.mark.parametrize("con,index", [
    (0.0, 0.0), (6.0, 25.0), (12.0, 50.0), (23.75, 75.0), (45.5, 125.0), (103.0, 175.0),
    (200.5, 250.0), (300.5, 350.0), (425.5, 450.0), (500.5, None), (-1.0, None), (None, None),
])
def test_aqi(spark, con, index):
    df = spark.createDataFrame([(con,)], "c double").select(aqi_pm25(F.col("c")).alias("i"))
    got = df.first().i
    assert got == (None if index is None else pytest.approx(index))


def test_with_aqi_drops_zero_and_null(spark):
    df = spark.createDataFrame([(0.0,), (6.0,), (None,), (600.0,)], "median double")
    assert rollup.with_aqi(df).count() == 1
    assert rollup.with_aqi(df, drop_zero=False).count() == 2


def test_rescale(spark):
    df = spark.range(1).select(rescale(F.lit(5.0), 0, 10, 100, 200).alias("v"))
    assert df.first().v == 150.0


@pytest.mark.parametrize("median", [rollup.median_by, rollup.median_by_split])
def test_medians(spark, median):
    groups = {"a": [1, 3], "b": [1, 3, 10], "c": [None, 5], "d": [None], "e": [7, 7, 7, 9]}
    rows = [(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r.k: r["median"] for r in median(df, ["k"]).collect()}
    assert got == {"a": 2.0, "b": 3.0, "c": 5.0, "d": None, "e": 7.0}


@pytest.mark.parametrize("seed", range(4))
def test_split_median_equals_sorting(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.gauss(0, 1), lambda: rng.expovariate(1e-3), lambda: 1000 + rng.random(),
            lambda: float(rng.randrange(-3, 4))][seed]
    values = [draw() for _ in range(1001 - seed % 2)]
    df = spark.createDataFrame([("g", v) for v in values], "k string, value double")
    got = rollup.median_by_split(df, ["k"]).first()["median"]
    assert got == pytest.approx(statistics.median(values), rel=1e-15)


def test_split_median_of_values_that_differ_in_the_last_digits(spark):
    values = [1.0 + i * 2.0 ** -52 for i in range(501)] + [1.0 + i * 2.0 ** -30 for i in range(500)]
    df = spark.createDataFrame([("g", v) for v in values], "k string, value double")
    assert rollup.median_by_split(df, ["k"]).first()["median"] == sorted(values)[500]


def test_split_median_near_powers_of_two(spark):
    values = [2.0 ** -3, 2.0 ** -3 - 2.0 ** -56, 8.0, 7.999999999999999, 1024.0, 0.0, -8.0]
    df = spark.createDataFrame([("g", v) for v in values], "k string, value double")
    assert rollup.median_by_split(df, ["k"]).first()["median"] == sorted(values)[3]


def test_drop_late(spark):
    schema = "id string, ts timestamp"
    stored = spark.createDataFrame([("s1", TEN), ("s1", clock(9, 0, 0))], schema)
    batch = spark.createDataFrame(
        [("s1", TEN), ("s1", clock(10, 1, 0)), ("s1", clock(10, 1, 0)), ("s2", clock(1, 0, 0))],
        schema,
    )
    got = sorted((r.id, r.ts) for r in ingest.drop_late(batch, stored).collect())
    assert got == [("s1", clock(10, 1, 0)), ("s1", clock(10, 1, 0)), ("s2", clock(1, 0, 0))]


def test_upsert_stations(spark):
    known = spark.createDataFrame([(7, 1.0, 2.0)], "station_id long, lon double, lat double")
    batch = spark.createDataFrame(
        [("p", 1.0, 2.0), ("q", 3.0, 4.0), ("r", 3.0, 4.0)], "k string, lon double, lat double"
    )
    rows, stations = ingest.upsert_stations(batch, known)
    assert {r.k: r.station_id for r in rows.collect()} == {"p": 7, "q": 8, "r": 8}
    assert stations.count() == 2


def test_upsert_into_empty_directory(spark):
    known = spark.createDataFrame([], "station_id long, lon double, lat double")
    batch = spark.createDataFrame([(3.5, 4.0), (-3.5, 4.0)], "lon double, lat double")
    rows, _ = ingest.upsert_stations(batch, known)
    assert {r.lon: r.station_id for r in rows.collect()} == {-3.5: 1, 3.5: 2}


def test_numbers_follow_order_over_buckets(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v"))
    numbered = numbering.number_rows(df, ["v"], F.floor(F.col("v") / 10), start=5)
    got = [r.row_index for r in numbered.orderBy("v").collect()]
    assert got == list(range(5, 105))


def test_skip_seen(spark):
    batch = spark.createDataFrame([(TEN,), (clock(11, 0, 0),)], "ts timestamp")
    stored = spark.createDataFrame([(TEN,), (clock(9, 0, 0),)], "ts timestamp")
    assert [r.ts.hour for r in ingest.skip_seen(batch, stored).collect()] == [11]
    assert ingest.skip_seen(batch, stored.limit(0)).count() == 2


def test_channels(spark):
    df = spark.createDataFrame(
        [(1, TEN, 4.0, "a"), (1, TEN, 6.0, "b")], "id long, ts timestamp, value double, channel string"
    )
    values = {h: channels.channel_readings(df, h).first().value for h in ("max", "min", "avg", "a", "b")}
    assert values == {"max": 6.0, "min": 4.0, "avg": 5.0, "a": 4.0, "b": 6.0}
    assert channels.select_channel(df, exclude="a").first().channel == "b"
    with pytest.raises(ValueError):
        channels.select_channel(df)


def test_split_channels(spark):
    df = spark.createDataFrame([(5,), (0,), (None,)], "parent_id long")
    got = [(r.parent_id, r.channel) for r in channels.split_channels(df).collect()]
    assert got == [(5, "a"), (0, "b"), (None, "b")]
