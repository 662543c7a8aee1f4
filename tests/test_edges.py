"""Missing values, uneven rings, whole polylines, map shapes as text, shared folders."""

import pytest
from pyspark.sql import functions as F

from sensorgrid.functions import wkt_paths, wkt_rings
from sensorgrid.operators import ingest, panel, rollup, spatial


def test_median_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, value double")
    found = {r.k: r["median"] for r in rollup.median_by_split(rows, ["k"]).collect()}
    assert found == {None: 2.0, "a": 5.0}


def test_median_of_tiny_values(spark):
    rows = spark.createDataFrame([("a", 1e-320), ("a", 3e-320), ("a", -1.0)], "k string, value double")
    assert rollup.median_by_split(rows, ["k"]).first()["median"] == 1e-320


def test_rows_without_coordinates_are_no_station(spark):
    batch = spark.createDataFrame(
        [(1, 10.0, 50.0), (2, None, 50.0), (3, 11.0, 50.0)], "n int, lon double, lat double")
    known = spark.createDataFrame([(7, 10.0, 50.0)], "station_id long, lon double, lat double")
    rows, stations = ingest.upsert_stations(batch, known)
    assert {r.n: r.station_id for r in rows.collect()} == {1: 7, 2: None, 3: 8}
    assert stations.count() == 2


def test_series_ignores_rows_without_a_station(obs):
    rows = [("a", 0, 1.0), ("b", 0, 2.0), (None, 0, 9.0), ("a", 60, 3.0), ("b", 60, 4.0), (None, 60, 9.0)]
    found = {r.station_id: r.series for r in panel.series(obs(rows, "label")).collect()}
    assert found == {"a": [1.0, 3.0], "b": [2.0, 4.0]}


def test_last_ring_reaches_beyond_an_uneven_radius(spark):
    centre = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lon double, lat double")
    points = spark.createDataFrame([("x", 0.002, 0.0)], "fclass string, lon double, lat double")
    found = spatial.count_in_rings(centre, points, step=100, max_radius=250).collect()
    assert [(r.buffer_size, r.value) for r in found] == [(300, 1.0)]  # 222 m away


def test_kept_polylines_stay_whole(spark):
    text = "MULTILINESTRING ((0 0, 0.001 0, 0.01 0), (5 5, 6 6))"
    lines = spark.createDataFrame([("road", text)], "fclass string, shape string").select(
        "fclass", F.explode(wkt_paths(F.col("shape"))).alias("path"))
    box = [(-0.0005, -0.0005), (0.0005, 0.0005)]
    centre = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lon double, lat double")
    built = spatial.geo_features(centre, {"roads": ("paths", lines)}, box, 500, 1000).collect()
    lengths = {r.buffer_size: r.value for r in built}
    assert lengths[1000] == pytest.approx(1000.0)  # far beyond the box
    assert {r.geo_feature for r in built} == {"roads"}


def test_wkt_shapes(spark):
    rows = spark.createDataFrame([
        (1, "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0), (1 0, 1.5 0, 1.5 1, 1 0)), ((5 5, 6 5, 6 6)))"),
        (2, "LINESTRING(0 0,1 2)"), (3, "POINT(1 1)"), (4, None),
    ], "n int, shape string")
    found = {
        r.n: r for r in rows.select(
            "n", wkt_rings(F.col("shape")).alias("rings"), wkt_paths(F.col("shape")).alias("paths")
        ).collect()
    }
    assert [r.hole for r in found[1].rings] == [False, True, False]
    assert [len(r.points) for r in found[1].rings] == [3, 3, 3]
    assert [(p.x, p.y) for p in found[2].paths[0]] == [(0.0, 0.0), (1.0, 2.0)]
    assert found[3].rings is None and found[3].paths is None and found[4].rings is None
