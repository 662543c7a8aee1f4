"""Crowded cells: every pair once, and no join key with much more than a leaf."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sensorgrid.operators import spatial
from sensorgrid.operators.cells import CellGrid

RADIUS = 1000


def _haversine(a, b):
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + (
        math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2)
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def _layer(lon, lat, seed=4):
    """Half of the points in a block of some metres, some of them at one place."""
    draw = random.Random(seed)
    points = [(lon + draw.uniform(-0.03, 0.03), lat + draw.uniform(-0.03, 0.03)) for _ in range(500)]
    points += [(lon + draw.uniform(0, 0.002), lat + draw.uniform(0, 0.002)) for _ in range(400)]
    points += [(lon + 0.001, lat + 0.001)] * 100
    return [(i, "c", (x + 180) % 360 - 180, y) for i, (x, y) in enumerate(points)]


@pytest.mark.parametrize("lon, lat", [(-118.2, 34.0), (179.999, -16.0), (20.0, 78.0)])
@pytest.mark.parametrize("leaf_rows", [15, 10**9])
def test_every_near_point_once(spark, lon, lat, leaf_rows):
    layer = _layer(lon, lat)
    draw = random.Random(9)
    places = [(f"s{i}", (lon + draw.uniform(-0.03, 0.03) + 180) % 360 - 180,
               lat + draw.uniform(-0.03, 0.03)) for i in range(25)]
    pairs = CellGrid(RADIUS).near_points(
        spark.createDataFrame(places, "id string, loc_lon double, loc_lat double"),
        spark.createDataFrame(layer, "no int, fclass string, lon double, lat double"),
        "loc_lon", "loc_lat", leaf_rows,
    ).select("id", "no").collect()
    found = Counter((r.id, r.no) for r in pairs)
    assert set(found.values()) <= {1}
    want = {
        (i, no) for i, *here in places for no, _, *there in layer
        if _haversine(here, there) <= RADIUS
    }
    assert want <= set(found) and len(want) > 200


def test_no_leaf_holds_more_than_it_may(spark):
    layer = spark.createDataFrame(_layer(-118.2, 34.0), "no int, fclass string, lon double, lat double")
    grid = CellGrid(RADIUS)
    fine = grid._fine(grid.list_points(layer))
    leaves = grid._leaves(fine, 15)
    sizes = fine.join(leaves, ["_band", "_cell", "_u", "_v"]).groupBy(
        "_band", "_cell", "_level", "_a", "_b", F.pmod(F.xxhash64("no"), "_parts")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 15
    per_square = leaves.groupBy("_band", "_cell", "_u", "_v").count()
    assert per_square.where("count > 1").count() == 0
    assert leaves.agg(F.max("_level"), F.max("_parts")).first()[0] > 1


@pytest.mark.parametrize("leaf_rows", [10, 10**9])
def test_every_near_box_once(spark, leaf_rows):
    boxes = [(i, x - 0.004, x + 0.002, y - 0.001, y + 0.003) for i, _, x, y in _layer(-118.2, 34.0)]
    places = [("a", -118.2, 34.0), ("b", -118.19, 34.02), ("c", -118.2, 34.001)]
    pairs = CellGrid(RADIUS).near_boxes(
        spark.createDataFrame(places, "id string, lon double, lat double"),
        spark.createDataFrame(boxes, "no int, min_x double, max_x double, min_y double, max_y double"),
        leaf_rows,
    ).select("id", "no").collect()
    found = Counter((r.id, r.no) for r in pairs)
    assert set(found.values()) == {1}
    reach = 0.008  # degrees of latitude that RADIUS covers at least
    want = {
        (i, no) for i, x, y in places for no, x0, x1, y0, y1 in boxes
        if x0 <= x <= x1 and y0 - reach <= y <= y1 + reach
    }
    assert want <= set(found) and want


def test_ring_counts_of_a_crowded_layer_do_not_change(spark, monkeypatch):
    layer = spark.createDataFrame(_layer(-118.2, 34.0), "no int, fclass string, lon double, lat double")
    places = spark.createDataFrame(
        [("a", -118.2, 34.0), ("b", -118.19, 34.02)], "id string, lon double, lat double")
    counts = []
    for leaf_rows in (12, 10**9):
        monkeypatch.setattr("sensorgrid.operators.cells.LEAF_ROWS", leaf_rows)
        counts.append(sorted(map(tuple, spatial.count_in_rings(places, layer, 100, RADIUS).collect())))
    assert counts[0] == counts[1] and counts[0]
