from __future__ import annotations

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorgrid.operators import frames, panel, windows
from tests.conftest import at

H = 3600


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


GAPS = [
    ("a", 0, 1.0), ("a", H, None), ("a", 2 * H, 3.0), ("a", 3 * H, 10.0), ("a", 4 * H, None),
    ("b", 0, None),
]


def test_fill_gaps_median_fixture(obs):
    got = {
        (r.station_id, r.unix_time): (r.mean, r.median, r.label)
        for r in windows.fill_gaps(obs(GAPS)).collect()
    }
    assert got[("a", 0)] == (1, 1, 1)
    assert got[("a", H)] == (1, 1, 1)
    assert got[("a", 2 * H)] == (2, 2, 3)
    assert got[("a", 3 * H)][0] == pytest.approx(14 / 3)
    assert got[("a", 3 * H)][1:] == (3, 10)
    assert got[("a", 4 * H)] == (6.5, 6.5, 6.5)
    assert got[("b", 0)] == (None, None, None)


def test_fill_gaps_rejects_unknown_method(obs):
    with pytest.raises(ValueError):
        windows.fill_gaps(obs(GAPS), method="mode")


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("centered", [False, True])
def test_rolling_equals_brute_force_across_chunks(obs, centered, copies):
    rng = random.Random(3)
    rows = [("a", rng.randrange(0, 40 * H), rng.choice([None, rng.random()])) for _ in range(400)]
    rows += [("a", rows[0][1], 0.5)] * 3
    got = windows.rolling(obs(rows), hours=2, centered=centered, sum_copies=copies)
    assert got.count() == len(rows)
    for r in got.collect():
        ahead = 2 * H if centered else 0
        near = [v for _, t, v in rows if r.unix_time - 2 * H <= t <= r.unix_time + ahead
                and v is not None]
        if near:
            assert r["mean"] == pytest.approx(statistics.fmean(near))
            assert r["median"] == pytest.approx(statistics.median(near))
        else:
            assert r["mean"] is None and r["median"] is None


@pytest.mark.parametrize("copies", [False, True])
def test_rolling_keeps_rows_without_time(spark, obs, copies):
    rows = obs([("a", 0, 1.0)]).union(spark.sql("select 'a', cast(null as timestamp), 5.0D"))
    assert windows.rolling(rows, sum_copies=copies).count() == 2


@pytest.mark.parametrize("k,reach", [(3, 1), (4, 1), (5, 2), (1, 0)])
def test_row_window_across_blocks(obs, k, reach):
    values = [float((i * 7) % 11) for i in range(60)]
    rows = [("a", i * H, v) for i, v in enumerate(values)]
    got = windows.row_window(obs(rows), k=k, rows_per_block=8).orderBy("ts").collect()
    assert len(got) == 60
    for i, r in enumerate(got):
        near = values[max(0, i - reach): i + reach + 1]
        assert r["mean"] == pytest.approx(statistics.fmean(near))


def test_series_takes_complete_times_only(obs):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("b", 1, 4.0), ("b", 3, 6.0)]
    got = {r.station_id: r.series for r in panel.series(obs(rows, "label")).collect()}
    assert got == {"a": [1.0, 0.0], "b": [4.0, 6.0]}


def test_series_survives_repeated_readings(obs):
    rows = [("a", 1, 1.0), ("a", 1, 3.0), ("b", 1, 4.0)]
    got = {r.station_id: r.series for r in panel.series(obs(rows, "label")).collect()}
    assert got == {"a": [2.0], "b": [4.0]}


def test_tolerant_series_keeps_stations_by_count(obs):
    full = [("a", t, float(t)) for t in range(40)]
    nine = [("b", t, 1.0) for t in range(9)]
    eight = [("c", t, 1.0) for t in range(8)]
    got = panel.series_tolerant(obs(full + nine + eight, "label"))
    assert {r.station_id: len(r.series) for r in got.collect()} == {"a": 9, "b": 9}


def test_support_gate(obs):
    rows = [(f"s{i}", 1, 1.0) for i in range(10)] + [(f"s{i}", 2, 1.0) for i in range(9)]
    assert {r.ts for r in panel.support_gate(obs(rows), min_rows=10).collect()} == {at(1)}
    # int(0.95 * 10) = 9
    assert panel.support_gate(obs(rows), frac=0.95).count() == 19
    with pytest.raises(ValueError):
        panel.support_gate(obs(rows))


def test_leave_one_out_uses_cleaned_training_and_raw_test(obs):
    raw = obs([("a", 0, 1.0), ("b", 0, None), ("b", 1, 2.0)])
    cleaned = windows.fill_gaps(raw)
    train, test = panel.leave_one_out(raw, cleaned, "b")
    assert rows_of(train, "station_id", "label") == [("a", 1.0)]
    assert rows_of(test, "value") == [(2.0,), (None,)]
    assert "label" not in test.columns
    sizes = panel.leave_one_out_sizes(raw)
    assert rows_of(sizes, "station_id", "n_train", "n_test") == [("a", 2, 1), ("b", 1, 2)]


def test_as_vector(obs):
    vectors = panel.as_vector(panel.series(obs([("a", 1, 2.0)], "label")), "series", "v")
    assert list(vectors.select(F.col("v")).first()[0].toArray()) == [2.0]


def _plain_frames(times, values, asked, back, ahead):
    out = []
    for t in asked:
        own = sorted(v for s, v in zip(times, values) if t - back <= s <= t + ahead)
        out.append((sum(own) / len(own), statistics.median(own)) if own else (None, None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sliding_frames_equal_plain_ones(seed):
    draw = random.Random(seed)
    times = sorted(draw.randrange(400) for _ in range(300))
    values = [draw.choice([draw.randrange(9), -draw.random(), 1e300]) for _ in times]
    asked = [draw.randrange(-50, 500) for _ in range(200)]
    back, ahead = draw.choice([(0, 0), (7, 0), (30, 30), (1000, 0)])
    mean, median = frames.frame_statistics(
        np.array(times), np.array(values), np.ones(len(times), int), np.array(asked), back, ahead)
    for got, want in zip(zip(mean, median), _plain_frames(times, values, asked, back, ahead)):
        assert got == pytest.approx(want)


def test_frames_leave_no_rounding_and_no_nan_behind():
    times = np.arange(6)
    values = np.array([1e300, 0.1, 0.2, float("nan"), 0.3, 0.5])
    mean, median = frames.frame_statistics(times, values, np.ones(6, int), times, 1, 0)
    assert mean[2] == pytest.approx(0.15) and mean[5] == pytest.approx(0.4)
    assert np.isnan(mean[3]) and np.isnan(mean[4]) and median[5] == pytest.approx(0.4)


def test_ten_times_the_readings_take_about_ten_times_as_long():
    draw = np.random.default_rng(2)

    def seconds(n):
        times, values = np.sort(draw.integers(0, 86_400, n)), draw.random(n)
        started = time.process_time()
        frames.frame_statistics(times, values, np.ones(n, int), times, 43_200, 0)
        return time.process_time() - started

    few = min(seconds(8_000) for _ in range(3))
    assert min(seconds(80_000) for _ in range(2)) < 25 * few  # a hundred times, frame by frame


def test_a_crowded_chunk_is_cut_by_time(spark, obs, monkeypatch):
    draw = random.Random(6)
    rows = [("hot", draw.randrange(90_000), draw.choice([None, draw.random()])) for _ in range(900)]
    rows += [("cold", t * 1000, float(t)) for t in range(40)] + [("hot", None, 3.0)] * 2
    timed = obs([(i, t or 0, v) for i, t, v in rows]).withColumn(
        "ts", F.when(F.col("value").eqNullSafe(3.0) & (F.col("station_id") == "hot"), None)
        .otherwise(F.col("ts")))
    want = {}
    for limit in (10**9, 40):
        monkeypatch.setattr(windows, "_ROWS_PER_CHUNK", limit)
        got = rows_of(windows.rolling(timed, hours=2, centered=True),
                      "station_id", "unix_time", "value", "mean", "median")
        want.setdefault("rows", got)
        assert len(got) == len(rows)
        for a, b in zip(got, want["rows"], strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    known = [(t, v) for i, t, v in rows if i == "hot" and v is not None and t is not None]
    times, values = zip(*known)
    plain = dict(zip(times, _plain_frames(times, values, times, 7200, 7200)))
    for station, t, value, mean, median in want["rows"]:
        if station == "hot" and t is not None and value is not None:
            assert (mean, median) == pytest.approx(plain[t])
