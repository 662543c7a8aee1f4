"""Models of many folds in one plan against plain numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorgrid.operators import fold_clusters, fold_importance, fold_tiles

MODELS = "fold string, k int"


def scaled(x):
    deviation = x.std(axis=0, ddof=1)
    flat = x.min(axis=0) == x.max(axis=0)
    return np.where(flat, 0.0, (x - x.mean(axis=0)) / np.where(flat, 1.0, deviation))


@pytest.fixture(scope="module")
def stations():
    rng = random.Random(3)
    rows = [(f"s{i}", [rng.gauss(4 * (i % 3), 1), 1e6 + rng.random(), 7.0]) for i in range(20)]
    return rows + [("s0", rows[5][1]), (None, [50.0, 1e6, 7.0])]


def fitted(spark, rows, models, **options):
    series = spark.createDataFrame(rows, "station_id string, series array<double>")
    return fold_clusters.cluster_folds(
        series, spark.createDataFrame(models, MODELS), **options
    ).collect()


def test_every_model_is_a_fixed_point_on_its_own_rows(spark, stations):
    models = [(fold, k) for fold in (None, "s0", "s4") for k in (1, 3)] + [("s9", 2)]
    found = fitted(spark, stations, models)
    for fold, k in models:
        rows = [r for r in found if (r.fold, r.k) == (fold, k)]
        kept = [(i, x) for i, x in stations if i is None or i != fold]
        assert sorted(str(r.id) for r in rows) == sorted(str(i) for i, _ in kept)
        z = scaled(np.array([x for _, x in kept]))
        # repeated ids carry different readings, so rows are told apart by their gap as well
        cluster_of = {}
        for r in rows:
            cluster_of.setdefault(r.id, []).append(r)
        labels = np.array([cluster_of[i][0].cluster for i, _ in kept if i != "s0"])
        cost = sum(r.gap for r in rows)
        if k == 1:
            assert cost == pytest.approx((z**2).sum())
        if fold == "s0":
            centres = np.array([z[labels == c].mean(axis=0) for c in range(k)])
            gaps = ((z[:, None] - centres) ** 2).sum(axis=2)
            assert (gaps.argmin(axis=1) == labels).all()
            assert cost == pytest.approx(gaps.min(axis=1).sum())


def test_models_do_not_depend_on_blocks_and_parts(spark, stations, monkeypatch):
    models = [(fold, k) for fold in (None, "s1", "s2") for k in (2, 4)]
    whole = {(r.fold, r.k, r.id, round(r.gap, 6)) for r in fitted(spark, stations, models)}
    monkeypatch.setattr(fold_tiles, "TILE_CELLS", 20)
    monkeypatch.setattr(fold_clusters, "FOLDS_PER_PART", 1)
    assert {(r.fold, r.k, r.id, round(r.gap, 6)) for r in fitted(spark, stations, models)} == whole


def test_fewer_distinct_rows_than_clusters(spark):
    rows = [(f"s{i}", [float(i % 2), 1.0]) for i in range(6)]
    found = fitted(spark, rows, [(None, 4)])
    assert {r.cluster for r in found} == {0, 1} and all(r.gap == 0 for r in found)


def test_sweep_of_nothing_costs_nothing(spark):
    empty = spark.createDataFrame([], "station_id string, series array<double>")
    got = fold_clusters.k_sweep(empty, [1, 2], [None, "s1"]).collect()
    assert sorted((str(r.fold), r.k, r.cost) for r in got) == [
        ("None", 1, 0.0), ("None", 2, 0.0), ("s1", 1, 0.0), ("s1", 2, 0.0)
    ]


def gini_drop(x, y, t):
    def mass(part):
        return sum((part == c).sum() ** 2 for c in set(part)) / len(part) if len(part) else 0.0

    return mass(y[x <= t]) + mass(y[x > t]) - mass(y)


def labelled(spark, n=30, width=5, folds=("a", "b"), noise=1):
    rng = random.Random(8)
    x = [[float(rng.randint(0, 6)) for _ in range(width)] for _ in range(n)]
    rows = [(str(i), v) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "id string, features array<double>")
    y = {f: [int(x[i][j] > 3) + rng.randint(0, noise) for i in range(n)] for j, f in enumerate(folds)}
    rows = [(f, str(i), y[f][i]) for f in folds for i in range(n) if i % 7]
    return np.array(x), y, vectors, spark.createDataFrame(rows, "fold string, id string, cluster int")


def test_trees_split_where_the_impurity_falls_most(spark):
    x, y, vectors, clusters = labelled(spark)
    splits = fold_importance.forest_splits(
        vectors, clusters, n_trees=1, max_depth=2, bagging=False, every_feature=True
    ).collect()
    inside = np.arange(len(x)) % 7 > 0
    for fold, labels in y.items():
        nodes = {r.node: r for r in splits if r.fold == fold}
        reached = {1: inside}
        for node in (1, 2, 3):
            rows, found = reached[node], nodes.get(node)
            best = max(
                gini_drop(x[rows, j], np.array(labels)[rows], t)
                for j in range(x.shape[1]) for t in range(7)
            )
            assert (found.gain if found else 0.0) == pytest.approx(best, abs=1e-6)
            if found and node == 1:
                low = x[:, found.feature] <= found.threshold
                reached = {1: rows, 2: rows & low, 3: rows & ~low}


def test_forests_do_not_depend_on_blocks(spark, monkeypatch):
    _, _, vectors, clusters = labelled(spark)

    def splits():
        found = fold_importance.forest_splits(vectors, clusters, n_trees=6, max_depth=3)
        return {tuple(r) for r in found.collect()}

    whole = splits()
    monkeypatch.setattr(fold_tiles, "TILE_CELLS", 40)
    monkeypatch.setattr(fold_importance, "FOLDS_PER_PART", 1)
    assert splits() == whole and whole


def test_importance_finds_the_driver_of_each_fold(spark):
    _, _, vectors, clusters = labelled(spark, noise=0)
    names = spark.createDataFrame([(f"f{j}", j) for j in range(5)], "feature string, index int")
    rows = fold_importance.importance_folds(vectors, clusters, names, n_trees=20).collect()
    for fold, driver in (("a", "f0"), ("b", "f1")):
        mine = {r.feature: r.importance for r in rows if r.fold == fold}
        assert sum(mine.values()) == pytest.approx(1)
        assert max(mine, key=mine.get) == driver


def test_one_class_or_no_rows_give_no_splits(spark):
    _, _, vectors, clusters = labelled(spark)
    same = clusters.withColumn("cluster", F.lit(1))
    assert fold_importance.forest_splits(vectors, same, n_trees=2).count() == 0
    assert fold_importance.forest_splits(vectors, clusters.limit(0), n_trees=2).count() == 0
    assert fold_importance.forest_splits(vectors.limit(0), clusters, n_trees=2).count() == 0


@pytest.mark.parametrize("rule,kept", [
    ("nonzero", {("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")}),
    ("top_frac", {("a", "y"), ("b", "x")}), ("mean_factor", {("a", "y")}),
])
def test_features_are_chosen_within_a_fold(spark, rule, kept):
    rows = [("a", "x", 0.01), ("a", "y", 0.99), ("a", "z", 0.0), ("b", "x", 0.5), ("b", "z", 0.5)]
    table = spark.createDataFrame(rows, "fold string, feature string, importance double")
    got = fold_importance.select_by_fold(table, rule, frac=0.5)
    assert {(r.fold, r.feature) for r in got.collect()} == kept
