from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorgrid.functions import EARTH_RADIUS_M, haversine
from sensorgrid.operators import spatial
from sensorgrid.operators.cells import CellGrid

DEG = math.radians(1) * EARTH_RADIUS_M


def location(spark, lon=0.0, lat=0.0):
    return spark.createDataFrame([("L", lon, lat)], "id string, lon double, lat double")


def east_north(x, y, lon=0.0, lat=0.0):
    """Degrees of a point x metres east and y metres north."""
    return lon + x / DEG / math.cos(math.radians(lat)), lat + y / DEG


def polygon(spark, *rings, lat=0.0, fclass="park"):
    value = [
        (hole, [dict(zip("xy", east_north(x, y, 0.0, lat))) for x, y in corners])
        for hole, corners in rings
    ]
    schema = "fclass string, rings array<struct<hole: boolean, points: array<struct<x: double, y: double>>>>"
    return spark.createDataFrame([(fclass, value)], schema)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def by_ring(df):
    return {r.buffer_size: r.value for r in df.collect()}


def overlap(cx, cy, r, x0, y0, x1, y1, n=400):
    """Circle and box overlap by strips."""
    xs = np.linspace(max(x0, cx - r), min(x1, cx + r), n * 50 + 1) if x1 > cx - r and x0 < cx + r else []
    if len(xs) == 0:
        return 0.0
    half = np.sqrt(np.maximum(r * r - (xs - cx) ** 2, 0))
    heights = np.maximum(np.minimum(y1, cy + half) - np.maximum(y0, cy - half), 0)
    return float(np.trapezoid(heights, xs))


@pytest.mark.parametrize("shape", [
    (-2000, -2000, 2000, 2000), (0, 0, 3000, 3000), (150, 150, 250, 450),
    (-50, -700, 60, 900), (2500, 0, 2700, 200),
])
@pytest.mark.parametrize("flip", [False, True])
def test_area_of_box(spark, shape, flip):
    corners = box(*shape)[::-1] if flip else box(*shape)
    got = by_ring(spatial.area_in_rings(location(spark), polygon(spark, (False, corners))))
    for r in range(100, 3100, 100):
        expected = overlap(0, 0, r, *shape)
        assert got.get(r, 0.0) == pytest.approx(expected, rel=1e-4, abs=2.0)


def test_area_subtracts_holes_whatever_their_direction(spark):
    outer, hole = (False, box(-1000, -1000, 1000, 1000)), box(-500, -500, 500, 500)
    for inner in (hole, hole[::-1]):
        got = by_ring(spatial.area_in_rings(location(spark), polygon(spark, outer, (True, inner))))
        assert got[2000] == pytest.approx(3_000_000, rel=1e-6)
        assert 400 not in got
        assert got[600] == pytest.approx(
            math.pi * 600**2 - overlap(0, 0, 600, -500, -500, 500, 500), rel=1e-3
        )


def test_area_in_square_degrees(spark):
    square = polygon(spark, (False, box(-100, -100, 100, 100)), lat=60.0)
    at = location(spark, 0.0, 60.0)
    got = by_ring(spatial.area_in_rings(at, square, unit="deg2"))
    assert got[3000] == pytest.approx(40_000 / DEG**2 / math.cos(math.radians(60)), rel=1e-6)
    with pytest.raises(ValueError):
        spatial.area_in_rings(at, square, unit="acre")


def test_areas_add_up_per_class(spark):
    a = polygon(spark, (False, box(0, 0, 100, 100)), fclass="x")
    b = polygon(spark, (False, box(200, 0, 300, 100)), fclass="x")
    none = polygon(spark, (False, box(0, 0, 100, 100)), fclass=None)
    got = spatial.area_in_rings(location(spark), a.union(b).union(none))
    assert by_ring(got)[500] == pytest.approx(20_000, rel=1e-6)
    assert {r.measurement for r in got.collect()} == {"area"}


def lines(spark, *pieces):
    rows = [("road", *east_north(*p[:2]), *east_north(*p[2:])) for p in pieces]
    return spark.createDataFrame(rows, "fclass string, x0 double, y0 double, x1 double, y1 double")


def test_length_in_rings(spark):
    through = lines(spark, (-2000, 0, 2000, 0))
    got = by_ring(spatial.length_in_rings(location(spark), through))
    assert got[1000] == pytest.approx(2000, rel=1e-6)
    assert got[3000] == pytest.approx(4000, rel=1e-6)
    start = by_ring(spatial.length_in_rings(location(spark), lines(spark, (0, 0, 2000, 0))))
    assert start[1000] == pytest.approx(1000, rel=1e-6)
    beside = by_ring(spatial.length_in_rings(location(spark), lines(spark, (-2000, 2000, 2000, 2000))))
    assert 1000 not in beside and beside[3000] == pytest.approx(2 * math.sqrt(5e6), abs=1300)
    far = spatial.length_in_rings(location(spark), lines(spark, (5000, 0, 9000, 0)))
    assert far.count() == 0


def test_length_ignores_pieces_without_extent(spark):
    got = by_ring(spatial.length_in_rings(
        location(spark), lines(spark, (10, 10, 10, 10), (0, 0, 50, 0))))
    assert got[100] == pytest.approx(50, rel=1e-6)


def test_segments(spark):
    path = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]
    df = spark.createDataFrame(
        [("r", path), ("s", path[:1])], "fclass string, path array<struct<x: double, y: double>>"
    )
    got = sorted(tuple(r) for r in spatial.segments(df).collect())
    assert got == [("r", 0.0, 0.0, 1.0, 0.0), ("r", 1.0, 0.0, 1.0, 2.0)]


def points(spark, rows, fclass="shop"):
    return spark.createDataFrame(
        [(fclass, lon, lat) for lon, lat in rows], "fclass string, lon double, lat double"
    )


def test_point_is_counted_in_every_wider_ring(spark):
    got = spatial.count_in_rings(location(spark), points(spark, [east_north(250, 0)]), 100, 500)
    assert by_ring(got) == {300: 1.0, 400: 1.0, 500: 1.0}


def test_copies_are_counted(spark):
    got = spatial.count_in_rings(location(spark), points(spark, [east_north(0, 0)] * 5), 100, 200)
    assert by_ring(got) == {100: 5.0, 200: 5.0}


@pytest.mark.parametrize("lon,lat", [
    (0.0, 0.0), (-118.3, 34.0), (179.999, 10.0), (-179.999, -45.0), (20.0, 78.0), (5.0, -89.0),
])
@pytest.mark.parametrize("per_reach", [1, 3])
def test_cells_find_every_near_point(spark, lon, lat, per_reach):
    rng = random.Random(5)
    spread = 4000 / DEG
    rows = []
    for _ in range(300):
        y = max(-90.0, min(90.0, lat + rng.uniform(-spread, spread)))
        x = lon + rng.uniform(-spread, spread) / max(math.cos(math.radians(lat)), 0.01)
        rows.append(((x + 180) % 360 - 180, y))
    layer = points(spark, rows)
    grid = CellGrid(3000, per_reach)
    at = location(spark, lon, lat)
    met = grid.list_reach(at).select("_band", "_cell", "lon", "lat").join(
        grid.list_points(layer.withColumnsRenamed({"lon": "px", "lat": "py"}), "px", "py"),
        ["_band", "_cell"],
    ).where(haversine(F.col("lon"), F.col("lat"), F.col("px"), F.col("py")) <= 3000).count()
    direct = layer.where(
        haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) <= 3000
    ).count()
    assert met == direct > 0


@pytest.mark.parametrize("lon", [0.0, 179.99, -179.99])
def test_every_box_meets_a_location_once(spark, lon):
    rng = random.Random(9)
    boxes = []
    for i in range(200):
        x = max(-180.0, min(179.9, lon + rng.uniform(-0.05, 0.05)))
        y = rng.uniform(-0.05, 0.05)
        boxes.append((i, x, min(x + rng.uniform(0, 0.2), 180.0), y, y + rng.uniform(0, 0.2)))
    shapes = spark.createDataFrame(
        boxes, "k int, min_x double, max_x double, min_y double, max_y double"
    )
    got = [r.k for r in CellGrid(3000).near_boxes(location(spark, lon), shapes).collect()]
    assert len(got) == len(set(got))
    reach = math.degrees(3000 / EARTH_RADIUS_M)
    for k, x0, x1, y0, y1 in boxes:
        if x0 <= lon + reach and x1 >= lon - reach and y0 <= reach and y1 >= -reach:
            assert k in got


def test_hull_and_inside(spark):
    corners = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([*corners, (1.0, 1.0), (1.0, 0.0)], "lon double, lat double")
    hull = spatial.region_hull(df)
    assert [(p.x, p.y) for p in hull.first().hull] == corners
    asked = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (2.0, 1.0)], "lon double, lat double")
    assert [tuple(r) for r in spatial.inside_hull(asked, hull).collect()] == [(1.0, 1.0)]


def test_hull_holds_all_points(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "lon double, lat double").repartition(7)
    hull = spatial.region_hull(df).first().hull
    for (a, b) in zip(hull, hull[1:] + hull[:1]):
        for x, y in rows:
            assert (b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x) > -1e-12


def test_box_filter_keeps_touching_shapes(spark):
    roads = spark.createDataFrame(
        [("in", 0.1, 0.1, 0.2, 0.2), ("touch", 1.0, 0.5, 2.0, 0.5), ("out", 2.0, 2.0, 3.0, 3.0)],
        "fclass string, x0 double, y0 double, x1 double, y1 double",
    )
    got = {r.fclass for r in spatial.in_box(roads, [(0, 1), (1, 0)], "lines").collect()}
    assert got == {"in", "touch"}


def test_geo_features_unions_layers(spark):
    at = location(spark)
    layers = {
        "shops": ("points", points(spark, [east_north(50, 0)])),
        "roads": ("lines", lines(spark, (0, 0, 50, 0))),
        "parks": ("polygons", polygon(spark, (False, box(0, 0, 50, 50)))),
    }
    got = spatial.geo_features(at, layers, [(-1, 1), (1, -1)], max_radius=100)
    assert {(r.geo_feature, r.measurement, round(r.value)) for r in got.collect()} == {
        ("shops", "count", 1), ("roads", "length", 50), ("parks", "area", 2500)
    }


def test_kinds_come_from_the_shapes(spark):
    def layer(*texts):
        return spark.createDataFrame([("c", t) for t in texts], "fclass string, geometry string")

    layers = {
        "mixed": layer("POINT(0.0001 0)", " point (0.0002 0)", "LINESTRING(0 0, 0.0005 0)"),
        "odd": layer(None, "", "CIRCLE(1 2)", "MULTIPOLYGON(((0 0, 0.0001 0, 0.0001 0.0001, 0 0)))"),
        "none": layer(),
    }
    kinds = {(r.layer, r.kind): r.n for r in spatial.layer_kinds(layers).collect()}
    assert kinds == {("mixed", "points"): 2, ("mixed", "paths"): 1, ("odd", None): 3,
                     ("odd", "polygons"): 1}
    found = spatial.geo_features_of(location(spark), layers, max_radius=100).collect()
    assert {(r.geo_feature, r.measurement) for r in found} == {
        ("mixed", "count"), ("mixed", "length"), ("odd", "area")
    }
    assert spatial.geo_features_of(location(spark), {"none": layers["none"]}).count() == 0
    with pytest.raises(ValueError):
        spatial.layer_kinds({})
