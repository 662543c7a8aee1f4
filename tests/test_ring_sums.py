"""Rings around many locations: one group per cell, whole sums, nothing shuffled in pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from sensorgrid.operators import spatial

PLACES = "id long, lon double, lat double"


def places(n=40, seed=3):
    draw = random.Random(seed)
    rows = [(i, -118.2 + draw.uniform(0, 0.09), 34.0 + draw.uniform(0, 0.07)) for i in range(n)]
    # a repeated id at two places, one place twice, and a location without a place
    return rows + [(0, -118.15, 34.03), (900, *rows[5][1:]), (901, None, 34.0), (None, -118.15, 34.03)]


def layers(spark, n=300, seed=4):
    draw = random.Random(seed)
    at = [(draw.choice("ab"), -118.2 + draw.uniform(0, 0.09), 34.0 + draw.uniform(0, 0.07)) for _ in range(n)]
    points = spark.createDataFrame(at, "fclass string, lon double, lat double")
    lines = spark.createDataFrame(
        [(c, x, y, x + draw.uniform(-0.01, 0.01), y + draw.uniform(-0.01, 0.01)) for c, x, y in at]
        + [("a", None, 34.0, -118.1, 34.0)],
        "fclass string, x0 double, y0 double, x1 double, y1 double")
    boxes = lines.dropna().select(
        "fclass", spatial.box_rings(*[lines[c] for c in ("x0", "y0", "x1", "y1")]).alias("rings"))
    return {"points": points, "lines": lines, "polygons": boxes}


def by_key(frame):
    return {(r.id, r.feature_type, r.buffer_size): r.value for r in frame.collect()}


@pytest.mark.parametrize("kind", ["points", "lines", "polygons"])
def test_lots_and_parts_do_not_change_the_sums(spark, monkeypatch, kind):
    where, layer = spark.createDataFrame(places(), PLACES), layers(spark)[kind]
    of = spatial._IN_RINGS[kind]
    want = by_key(of(where, layer, 100, 1500))
    monkeypatch.setattr(spatial, "LAYER_ROWS", 20)
    monkeypatch.setattr(spatial, "LOT_ROWS", 3)
    got = by_key(of(where, layer, 100, 1500))
    assert got.keys() == want.keys() and len(want) > 500
    assert all(abs(got[k] - want[k]) <= 1e-6 * max(1.0, abs(want[k])) for k in want)
    assert {k[0] for k in want} >= {0, 5, 900, None} and 901 not in {k[0] for k in want}
    assert all(want[(5, *k[1:])] == want[k] for k in want if k[0] == 900)


def test_a_repeated_id_adds_up(spark):
    layer = layers(spark)["points"]
    rows = places()
    apart = [(f"{i}", x, y) for i, (_, x, y) in enumerate(rows)]
    single = by_key(spatial.count_in_rings(
        spark.createDataFrame(apart, "id string, lon double, lat double"), layer, 100, 1500))
    want = defaultdict(float)
    for (i, c, r), v in single.items():
        want[(rows[int(i)][0], c, r)] += v
    assert by_key(spatial.count_in_rings(spark.createDataFrame(rows, PLACES), layer, 100, 1500)) == want


@pytest.mark.parametrize("kind", ["points", "lines", "polygons"])
def test_sums_of_a_location_leave_its_task_once(spark, kind):
    """Single ids and plain cells: between the group of a cell and the rows there is no shuffle."""
    single = [r for r in places() if r[0] not in (0, None)]
    found = spatial._IN_RINGS[kind](spark.createDataFrame(single, PLACES), layers(spark)[kind], 100, 1500)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "CoGroups" in plan and "HashAggregate(keys=[id" not in plan.split("CoGroups")[0]
