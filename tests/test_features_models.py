from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sensorgrid.operators import features, forest, models
from sensorgrid.plans import grid
from tests.conftest import at

NAMES = "feature string, index int"


@pytest.fixture(scope="module")
def xyz(spark):
    return spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], NAMES)


def test_vectors_fill_gaps_with_zero(spark, xyz):
    eav = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "z", 2.0), ("c", "y", 3.0), ("c", "y", 5.0), ("c", "q", 9.0)],
        "id string, feature string, value double",
    )
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r.id: r.features for r in features.to_vector(eav, ids, xyz).collect()}
    assert got == {"a": [1, 0, 2], "b": [0, 0, 0], "c": [0, 4, 0]}


def test_vectors_over_no_names_are_empty(spark):
    eav = spark.createDataFrame([("a", "x", 1.0)], "id string, feature string, value double")
    ids = spark.createDataFrame([("a",)], "id string")
    names = spark.createDataFrame([], NAMES)
    assert features.to_vector(eav, ids, names).first().features == []


def importances(spark, values):
    rows = [(i, f"f{i:03d}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "index int, feature string, importance double")


def test_feature_rules(spark):
    imp = importances(spark, [0, 0.1, 0.2, 0.7])
    assert features.select_features(imp).count() == 3
    kept = features.select_features(imp, "mean_factor").collect()
    assert [r.importance for r in kept] == [0.7]
    with pytest.raises(ValueError):
        features.select_features(imp, "best")


@pytest.mark.parametrize("n,kept", [(250, 2), (99, 0)])
def test_top_share(spark, n, kept):
    imp = importances(spark, range(1, n + 1))
    assert features.select_features(imp, "top_frac").count() == kept
    assert features.select_features(imp, "top_frac", min_keep=3).count() == 3


def test_sorted_features_break_ties_by_name(spark):
    got = features.sorted_features(importances(spark, [1, 0, 2, 1])).collect()
    assert [r.feature for r in got] == ["f002", "f000", "f003"]


def test_scaled_slots_have_mean_0_and_std_1(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(5, 3), 7.0]) for i in range(50)]
    df = features.as_scaled_vector(spark.createDataFrame(rows, "i int, x array<double>"), "x")
    cells = np.array([r.v for r in df.select(vector_to_array("scaled").alias("v")).collect()])
    assert cells[:, 0].mean() == pytest.approx(0, abs=1e-9)
    assert cells[:, 0].std(ddof=1) == pytest.approx(1)
    assert (cells[:, 1] == 0).all()


def test_pca_keeps_the_variance_of_a_line(spark):
    rows = [(i, [float(i), 2.0 * i]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    scaled = features.as_scaled_vector(df, "x")
    _, model = features.pca(scaled, "scaled", 2, "p")
    assert model.explainedVariance[0] == pytest.approx(1)


def test_assemble_fills_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    got = {tuple(r.features.toArray()) for r in features.assemble(df, ["a", "b"]).collect()}
    assert got == {(1.0, 0.0), (0.0, 2.0)}


def test_scalar_layers_and_union(spark):
    place = spark.createDataFrame([(1, 2.0, 3.0)], "id int, lon double, lat double")
    plain = features.scalar_layers(place, {"longitude": "lon", "latitude": "lat"})
    land = spark.createDataFrame(
        [("1", "roads", "path", 100, 5.0)],
        "id string, geo_feature string, feature_type string, buffer_size long, value double",
    )
    got = features.keyed(features.union_layers([plain, land])).collect()
    assert {(r.feature, r.value) for r in got} == {
        ("location_longitude_0", 2.0), ("location_latitude_0", 3.0), ("roads_path_100", 5.0)
    }


# ---------------------------------------------------------------- small trees


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 30), st.integers(0, 6))
def test_forest_stays_within_the_labels(seed, n, width):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, width)), rng.normal(size=n)
    fitted = forest.fit_forest(x, y, np.ones(n), 5, 4, seed)
    out = forest.predict(fitted, rng.normal(size=(7, width)))
    assert (out >= y.min() - 1e-9).all() and (out <= y.max() + 1e-9).all()
    again = forest.predict(forest.fit_forest(x, y, np.ones(n), 5, 4, seed), x)
    assert np.array_equal(again, forest.predict(fitted, x))


def test_tree_finds_the_only_split():
    x = np.array([[0.0, 1.0], [0.0, 2.0], [0.0, 3.0], [0.0, 4.0]])
    fitted = forest.fit_boosted(x, np.array([1.0, 1.0, 9.0, 9.0]), np.ones(4), 1, 1, 0)
    assert forest.predict(fitted, np.array([[5.0, 2.4], [5.0, 2.6]])).tolist() == [1.0, 9.0]


def test_weights_act_like_copies():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(8, 3)), rng.normal(size=8)
    w = np.array([1, 3, 1, 2, 1, 1, 4, 1.0])
    rep = np.repeat(np.arange(8), w.astype(int))
    one = forest.fit_boosted(x, y, w, 6, 3, 0)
    two = forest.fit_boosted(x[rep], y[rep], np.ones(len(rep)), 6, 3, 0)
    assert np.allclose(forest.predict(one, x), forest.predict(two, x))


def test_boosting_gets_closer():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = np.sin(x[:, 0]) + x[:, 1]
    errors = [
        np.abs(y - forest.predict(forest.fit_boosted(x, y, np.ones(60), n, 2, 0), x)).mean()
        for n in (1, 10, 40)
    ]
    assert errors[0] > errors[1] > errors[2]


# ---------------------------------------------------------------- models on Spark


@pytest.fixture(scope="module")
def world(spark):
    """Twelve stations, two by two alike; the first feature drives the readings."""
    rng = random.Random(11)
    readings, eav = [], []
    for s in range(12):
        drive = float(s // 6) * 10 + s % 6
        for t in range(8):
            readings.append((f"s{s}", at(3600 * t), drive + rng.random() * 0.1))
        eav.append((f"s{s}", "land", "wood", 100, drive))
        eav.append((f"s{s}", "land", "noise", 100, rng.random()))
    grid_eav = [(str(g), "land", "wood", 100, float(g)) for g in range(16)]
    schema = "id string, geo_feature string, feature_type string, buffer_size int, value double"
    return {
        "obs": spark.createDataFrame(readings, "station_id string, ts timestamp, value double"),
        "eav": spark.createDataFrame(eav, schema),
        "grid_eav": spark.createDataFrame(grid_eav, schema),
        "grid": spark.createDataFrame(
            [(g, float(g), 0.0) for g in range(20)], "gid int, lon double, lat double"
        ),
    }


SMALL = grid.Settings(k=2, importance_trees=20, n_trees=30)


def test_predict_grid(world):
    df = grid.predict_grid(
        world["obs"], world["eav"], world["grid_eav"], world["grid"], (at(0), at(3600 * 9)),
        settings=SMALL,
    )
    rows = df.collect()
    assert len(rows) == 8 * 20
    first = {r.gid: r.prediction for r in rows if r.ts == at(0)}
    assert first["0"] < 5 < 10 < first["15"]
    assert all(0 <= v <= 15.2 for v in first.values())
    assert first["19"] == first["0"] or first["19"] <= first["1"] + 1


def test_latest_mode_takes_one_time(world):
    df = grid.predict_grid(
        world["obs"], world["eav"], world["grid_eav"], world["grid"], settings=SMALL
    )
    assert {r.ts for r in df.collect()} == {at(3600 * 7)}


def test_predictions_do_not_depend_on_the_block_size(world, spark):
    names = features.feature_names(features.keyed(world["eav"]))
    ids = world["obs"].select(F.col("station_id").alias("id")).distinct()
    context = features.to_vector(features.keyed(world["eav"]), ids, names)
    targets = features.to_vector(
        features.keyed(world["grid_eav"]), world["grid"].select(F.col("gid").alias("id")), names
    )
    train = world["obs"].withColumnRenamed("value", "label")
    got = [
        {(r.id, r.ts): r.prediction for r in models.predict(
            train, context, targets, model, n_trees=5, targets_per_block=size, chunk_hours=hours
        ).collect()}
        for model in ("rf", "gbt") for size, hours in ((2000, 24), (3, 2))
    ]
    assert got[0] == got[1] and len(got[0]) == 8 * 20
    assert got[2] == got[3]


def test_single_fit_agrees_with_the_bulk_form(world):
    names = features.feature_names(features.keyed(world["eav"]))
    ids = world["obs"].select(F.col("station_id").alias("id")).distinct()
    context = features.to_vector(features.keyed(world["eav"]), ids, names)
    train = world["obs"].withColumnRenamed("value", "label").where(F.col("ts") == F.lit(at(0)))
    one = {r.id: r.prediction for r in models.predict_once(train, context, context, n_trees=100).collect()}
    many = {r.id: r.prediction for r in models.predict(train, context, context, n_trees=100).collect()}
    assert one.keys() == many.keys()
    assert max(abs(one[k] - many[k]) for k in one) < 4
    gbt = models.predict_once(train, context, context, "gbt", n_trees=3)
    assert gbt.count() == 12
    with pytest.raises(ValueError):
        models.predict_once(train, context, context, "svm")


def test_importance_sums_to_one_and_finds_the_driver(world):
    names = features.feature_names(features.keyed(world["eav"]))
    ids = world["obs"].select(F.col("station_id").alias("id")).distinct()
    vectors = features.to_vector(features.keyed(world["eav"]), ids, names)
    from sensorgrid.operators.panel import series

    clusters, cost = models.cluster(series(world["obs"].withColumnRenamed("value", "label")), 2)
    assert cost > 0 and {r.cluster for r in clusters.collect()} == {0, 1}
    rows = {r.feature: r.importance for r in
            models.importance(vectors, clusters, names, n_trees=20).collect()}
    assert sum(rows.values()) == pytest.approx(1)
    assert rows["land_wood_100"] > rows["land_noise_100"]


def test_k_sweep_cost_falls(world):
    from sensorgrid.operators.panel import series

    swept = models.k_sweep(
        series(world["obs"].withColumnRenamed("value", "label")), [2, 4], [None, "s0"]
    )
    cost = {(r.fold, r.k): r.cost for r in swept.collect()}
    assert len(cost) == 4
    assert cost[(None, 2)] >= cost[(None, 4)]


def test_cross_validation_never_trains_on_its_own_station(world, monkeypatch):
    result, by_station = grid.cross_validate(world["obs"], world["eav"], settings=SMALL)
    assert result.count() == 12 * 8
    errors = {r.station_id: r.rmse for r in by_station.collect()}
    # the extreme station cannot reach its own level when it is held out
    top = result.where("station_id = 's11'").agg(F.max("prediction")).first()[0]
    assert top < 15 and errors["s11"] > 0.5
    monkeypatch.setattr(grid, "_FOLDS_PER_TASK", 5)
    blocks, _ = grid.cross_validate(world["obs"], world["eav"], settings=SMALL)
    key = ["station_id", "ts"]
    assert {tuple(r) for r in blocks.select(*key, "prediction").collect()} == {
        tuple(r) for r in result.select(*key, "prediction").collect()
    }
    gated, _ = grid.cross_validate(world["obs"], world["eav"], min_support=12, settings=SMALL)
    assert gated.count() == 0


def test_validation_against_a_second_network(world):
    truth = world["obs"].where("station_id < 's2'").withColumnRenamed("station_id", "id")
    result, per_time = grid.validate_against(
        world["obs"], world["eav"], truth, world["eav"], settings=SMALL
    )
    assert result.count() == truth.count()
    rows = per_time.collect()
    assert len(rows) == 8 and all(r.rmse >= r.mae > 0 for r in rows)


def test_network_prediction_with_reference_stations(world, spark):
    readings = world["obs"].select(
        F.regexp_replace("station_id", "s", "").cast("long").alias("sensor_id"), "ts", "value"
    )
    directory = spark.createDataFrame(
        [(i, str(i // 2), "ab"[i % 2]) for i in range(12)],
        "sensor_id long, id string, channel string",
    )
    eav = world["eav"].withColumn("id", F.regexp_replace("id", "s", ""))
    df = grid.predict_grid_network(
        readings, directory, eav.union(world["eav"]), world["grid_eav"], world["grid"],
        extra_obs=world["obs"], min_support=10,
        settings=grid.Settings(k=2, importance_trees=10, n_trees=10, rule="mean_factor"),
    )
    assert df.count() == 20


def test_station_cluster_table(spark):
    rows = models.station_clusters(spark)
    counts = {r.parameter: r["count"] for r in rows.groupBy("parameter").count().collect()}
    assert counts == {"PM2.5": 14, "PM10": 8, "O3": 17}


def test_targets_are_copied_per_many_times_and_carry_their_columns(spark, monkeypatch):
    rows = [(s, at(86400 * d), float(d)) for d in range(30) for s in ("a", "b")]
    train = spark.createDataFrame(rows, "station_id string, ts timestamp, label double")
    context = spark.createDataFrame(
        [("a", [1.0]), ("b", [2.0])], "id string, features array<double>"
    )
    places = [("g1", [1.0], 5.0, None), ("g1", [1.0], 6.0, "x"), ("g2", [2.0], 7.0, "y")]
    targets = spark.createDataFrame(
        places, "id string, features array<double>, lon double, name string"
    )
    dealt = []
    run = models.spread

    def counted(df, *cols):
        dealt.append((set(df.columns), df))
        return run(df, *cols)

    monkeypatch.setattr(models, "spread", counted)
    found = models.predict(train, context, targets, n_trees=2, max_depth=0, keep=("lon", "name"))
    got = sorted((r.id, r.ts, r.prediction, r.lon, r.name or "") for r in found.collect())
    assert got == sorted(
        (i, at(86400 * d), float(d), lon, name or "") for d in range(30) for i, _, lon, name in places
    )
    (copied,) = [df for columns, df in dealt if {"lon", "_chunk"} <= columns]
    assert copied.count() == len(places)
