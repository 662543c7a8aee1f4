"""Networks of which no time is shared by all stations."""

from __future__ import annotations

from datetime import datetime, timedelta

from sensorgrid.plans import grid


def test_grid_of_a_network_without_a_shared_time(spark):
    day = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(4)]
    # sensor 1 misses the first two days, sensor 2 the last two, sensor 3 none
    readings = spark.createDataFrame(
        [(1, day[2], 1.0), (1, day[3], 2.0), (2, day[0], 3.0), (2, day[1], 4.0)]
        + [(3, d, 10.0) for d in day], "sensor_id long, ts timestamp, value double")
    directory = spark.createDataFrame(
        [(i, i, "a") for i in (1, 2, 3)], "sensor_id long, id long, channel string")
    schema = "id string, geo_feature string, feature_type string, buffer_size int, value double"
    features = spark.createDataFrame([(str(i), "road", "x", 100, float(i)) for i in (1, 2, 3)], schema)
    points = spark.createDataFrame([(7, 0.0, 1.0), (8, 0.5, 1.0)], "gid long, lon double, lat double")
    on_grid = spark.createDataFrame([("7", "road", "x", 100, 2.0)], schema)
    found = grid.predict_grid_network(
        readings, directory, features, on_grid, points, when=(day[0], day[3]), min_support=2,
        settings=grid.Settings(k=2, importance_trees=2, n_trees=400, rule="mean_factor"),
    ).collect()
    assert {(r.gid, r.ts) for r in found} == {(g, d) for g in ("7", "8") for d in day}
    mean = dict(zip(day, (6.5, 7.0, 5.5, 6.0)))
    assert all(abs(r.prediction - mean[r.ts]) < 0.8 for r in found)
