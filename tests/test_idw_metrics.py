from __future__ import annotations

import math
import random
from functools import partial

import pytest

from sensorgrid.operators import idw, idw_tiles, metrics
from sensorgrid.plans import networks
from tests.conftest import at


@pytest.fixture(scope="module")
def three_sources(spark, obs):
    source = obs([("x", 1, 10.0), ("y", 1, 20.0), ("z", 1, None), ("w", 1, 99.0)])
    distance = spark.createDataFrame(
        [("t", "x", 1.0), ("t", "y", 2.0), ("t", "z", 4.0), ("t", "w", 0.0)],
        "id_a string, id_b string, distance double",
    )
    return obs([("t", 1, 7.0)]), source, distance


def test_null_reading_keeps_its_weight(three_sources):
    target, source, distance = three_sources
    row = idw.idw(target, source, distance, min_sources=1).first()
    assert row.truth == 7.0
    assert row.prediction == pytest.approx(20 / 1.75)


def test_null_reading_without_weight(three_sources):
    target, source, distance = three_sources
    row = idw.idw(
        target, source, distance, min_sources=1, null_weight_in_denominator=False
    ).first()
    assert row.prediction == pytest.approx(20 / 1.5)


def test_repeated_readings_count_like_rows(spark, obs, three_sources):
    target, source, distance = three_sources
    twice = source.union(obs([("x", 1, 40.0)]))
    row = idw.idw(target, twice, distance, min_sources=1).first()
    assert row.prediction == pytest.approx((10 + 40 + 10) / (1 + 1 + 0.5 + 0.25))


def test_gate_counts_sources_per_held_out_station(spark, obs):
    ids = [f"s{i}" for i in range(10)]
    rows = obs([(i, 1, float(n)) for n, i in enumerate(ids)])
    pairs = [(a, b, 1.0) for a in ids for b in ids if a != b]
    distance = spark.createDataFrame(pairs, "id_a string, id_b string, distance double")
    assert idw.idw_loo(rows, distance, min_sources=10).count() == 0
    got = {r.station_id: r.prediction for r in idw.idw_loo(rows, distance, min_sources=9).collect()}
    assert got["s0"] == pytest.approx(sum(range(1, 10)) / 9)
    assert len(got) == 10


def test_station_errors_of_a_perfect_network(spark, obs):
    ids = ["a", "b", "c"]
    rows = obs([(i, t, 5.0) for i in ids for t in (1, 2)])
    distance = spark.createDataFrame(
        [(a, b, 3.0) for a in ids for b in ids], "id_a string, id_b string, distance double"
    )
    out = networks.idw_station_errors(rows, distance, min_sources=2).collect()
    assert {(r.station_id, r.rmse, r.mae, r.n) for r in out} == {(i, 0.0, 0.0, 2) for i in ids}


def test_errors_count_rows_with_null_error(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 2.0), (None, 5.0)], "truth double, prediction double"
    )
    row = metrics.errors(df).first()
    assert row.rmse == pytest.approx(math.sqrt(1 / 3))
    assert row.mae == pytest.approx(1 / 3)
    assert row.n == 3


def test_errors_of_nothing(spark):
    df = spark.createDataFrame([], "truth double, prediction double")
    row = metrics.errors(df).first()
    assert (row.rmse, row.mae, row.n) == (None, None, 0)


def _random_network(seed, stations=40, times=30):
    draw = random.Random(seed)
    ids = [f"s{i}" for i in range(stations)]
    rows = [
        (draw.choice([*ids, None]), draw.randint(1, times),
         draw.choice([None, float("nan"), 0.0, draw.uniform(-5, 50), draw.uniform(-5, 50)]))
        for _ in range(stations * times // 3)
    ]
    far = [1.0, 2.5, 7.0, 11.0] + ([0.0, None, float("inf")] if seed % 2 else [])
    pairs = [(a, b, draw.choice(far)) for a in [*ids, "x"] for b in ids if draw.random() < 0.5]
    return rows, pairs + draw.sample(pairs, 50)


def _by_hand(rows, pairs, min_sources):
    """(id, time, truth, prediction) with all terms of a station and time listed."""
    near, at = {}, {}
    for a, b, d in pairs:
        if a != b:
            near.setdefault(a, []).append((b, 1 / d if d else None))
    for i, t, v in rows:
        at.setdefault(t, []).append((i, v))
    for i, t, v in rows:
        others = [r for r in at[t] if r[0] != i or i is None]
        terms = [(x, w) for b, w in near.get(i, []) for s, x in at[t] if s == b]
        if len(others) < min_sources or not terms:
            continue
        known = [x * w for x, w in terms if x is not None and w is not None]
        divisor = sum(w for _, w in terms if w is not None)
        yield i, t, v, sum(known) / divisor if known and divisor else None


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("targets", [7, None])
def test_tiles_of_held_out_stations(spark, obs, monkeypatch, seed, targets):
    rows, pairs = _random_network(seed)
    monkeypatch.setattr(idw, "held_out_means", partial(idw_tiles.held_out_means, targets=targets))
    distance = spark.createDataFrame(pairs, "id_a string, id_b string, distance double")
    got = [
        (r.station_id, int((r.ts - at(0)).total_seconds()), r.truth, r.prediction)
        for r in idw.idw_loo(obs(rows), distance, min_sources=6).collect()
    ]
    plain = [
        sorted(repr([x if not isinstance(x, float) else f"{x:.6g}" for x in r]) for r in found)
        for found in (got, _by_hand(rows, pairs, 6))
    ]
    assert plain[0] and plain[0] == plain[1]


def test_held_out_terms_are_not_shuffled(spark, obs):
    """The readings of a station meet each other station once per tile, not once per time."""
    ids = [f"s{i}" for i in range(60)]
    rows = obs([(i, t, 1.0) for i in ids for t in range(40)])
    pairs = [(a, b, 1.0) for a in ids for b in ids]
    distance = spark.createDataFrame(pairs, "id_a string, id_b string, distance double")
    readings = idw._summed(rows, "station_id", "ts", "value")
    w = idw.weights(distance).where("id_a <> id_b")
    packed = []
    run = idw_tiles.spread

    def counted(tiles, *cols):
        packed.append(tiles.count())
        return run(tiles, *cols)

    idw_tiles.spread = counted
    try:
        assert idw_tiles.held_out_means(readings, w, 10, "_rows").count() == 60 * 40
    finally:
        idw_tiles.spread = run
    assert packed[0] < 60 * 60
