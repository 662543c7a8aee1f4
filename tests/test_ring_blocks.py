"""Packed layers of the rings: no layer is broadcast, a copy of a shape is its bytes, kernels."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sensorgrid.operators import ring_blocks, ring_sums, spatial
from tests.test_ring_sums import PLACES, by_key, layers, places


@pytest.mark.parametrize("kind", ["points", "polygons"])
def test_neither_layer_nor_locations_are_broadcast(spark, kind):
    """An inner join may broadcast its smaller side, and an exploded layer looks small."""
    found = spatial._IN_RINGS[kind](spark.createDataFrame(places(), PLACES), layers(spark)[kind], 100, 1500)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert all("LeftOuter, BuildRight" in line for line in joins)


def test_halved_cells_do_not_change_the_sums(spark, monkeypatch):
    where, layer = spark.createDataFrame(places(), PLACES), layers(spark)["lines"]
    want = by_key(spatial.length_in_rings(where, layer, 100, 700))
    monkeypatch.setattr(spatial, "GROUP_PAIRS", 40)
    got = by_key(spatial.length_in_rings(where, layer, 100, 700))
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_a_line_is_packed_in_33_bytes():
    n = 5000
    draw = np.random.default_rng(1)
    batch = pa.RecordBatch.from_pydict({
        "_band": pa.array(draw.integers(0, 2, n)), "_cell": pa.array(draw.integers(0, 3, n)),
        "_squares": pa.array(np.zeros(n, np.int32)), "fclass": pa.array(draw.choice(["a", "b"], n)),
        **{c: pa.array(draw.uniform(0, 1, n)) for c in ("x0", "y0", "x1", "y1")},
    })
    rows = [r for b in ring_blocks.pack("lines")([batch]) for r in b.to_pylist()]
    assert sum(r["_n"] for r in rows) == n and sum(len(r["_data"]) for r in rows) == 33 * n
    assert len(rows) <= 12 * (n // 12 // ring_blocks._PACKED + 2)
    sent = sorted(zip(*[batch.column(c).to_pylist() for c in ("_band", "_cell", "fclass", "x0", "y1")]))
    got = sorted(
        (r["_band"], r["_cell"], r["fclass"], float(s["x0"]), float(s["y1"]))
        for r in rows for s in ring_blocks.unpack("lines", r["_n"], r["_data"])[0]
    )
    assert got == sent


def test_a_dealt_cell_gives_each_group_its_shapes():
    shapes = np.zeros(40, ring_blocks.record("lines"))
    shapes["x0"] = np.arange(40)
    # first and last square across and up: shapes 0 to 9 reach only the first square
    shapes["squares"] = np.where(np.arange(40) < 10, 0, 0 + 3 * 4 + 0 * 16 + 3 * 64)
    groups = [{"square": 0, "lots": 2, "parts": 1}, {"square": 5, "lots": 1, "parts": 3}]
    batch = pa.RecordBatch.from_pylist([
        {"_band": 1, "_cell": 2, "fclass": "a", "_n": 40, "_data": shapes.tobytes(), "_level": 2, "_groups": g}
        for g in (groups, None)
    ])
    met = {}
    for out in ring_blocks.deal("lines")([batch]):
        for r in out.to_pylist():
            found = ring_blocks.unpack("lines", r["_n"], r["_data"])[0]["x0"]
            met.setdefault((r["_square"], r["_lot"]), []).extend(found.tolist())
    assert {k: sorted(v) for k, v in met.items()} == {
        (0, 0): list(range(40)), (0, 1): list(range(40)), (5, 0): list(range(10, 40)),
    }


def test_a_group_is_summed_in_bounded_steps():
    """The rings that cut an edge are taken row by row, not one row per pair, edge and ring."""
    draw = random.Random(2)
    first = np.array([draw.randint(1, 9) for _ in range(200)])
    last = first + np.array([draw.randint(-2, 6) for _ in range(200)])
    met = [(i, r) for ring, row in ring_sums._cut_rings(first, last, np.arange(200))
           for i, r in zip(row.tolist(), ring.tolist())]
    assert sorted(met) == [(i, r) for i in range(200) for r in range(first[i], last[i])]


def test_lines_near_the_antimeridian(spark):
    where = spark.createDataFrame([(1, 179.999, 10.0), (2, -179.999, 10.0)], PLACES)
    lines = spark.createDataFrame(
        [("a", 179.995, 10.001, -179.995, 10.001)], "fclass string, x0 double, y0 double, x1 double, y1 double")
    got = by_key(spatial.length_in_rings(where, lines, 500, 1500))
    unit = math.radians(1) * 6371008.8
    off, near, far = 0.001 * unit, 0.004, 0.006
    for i in (1, 2):
        root = math.sqrt(500**2 - off**2)
        scale = math.cos(math.radians(10.0)) * unit
        want = min(near * scale, root) + min(far * scale, root)
        assert got[(i, "a", 500)] == pytest.approx(want, rel=1e-9)
        assert got[(i, "a", 1500)] == pytest.approx(0.01 * scale, rel=1e-9)
