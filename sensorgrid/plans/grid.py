"""Grid prediction, hold-out validation and validation against a second network."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.operators import forest
from sensorgrid.operators.channels import (
    channel_readings,
    near_only,
    select_channel,
    with_directory,
)
from sensorgrid.operators.features import feature_names, keyed, select_features, to_vector
from sensorgrid.operators.fold_clusters import cluster_folds
from sensorgrid.operators.fold_importance import importance_folds, select_by_fold
from sensorgrid.operators.fold_tiles import cut
from sensorgrid.operators.metrics import errors, join_truth, time_errors
from sensorgrid.operators.models import (
    FIT_PARTITIONS,
    cluster,
    importance,
    predict,
    training_rows,
)
from sensorgrid.operators.panel import (
    series,
    series_tolerant,
    support_gate,
    tolerant_stations,
)
from sensorgrid.operators.spread import spread
from sensorgrid.operators.windows import fill_gaps

_FOLDS_PER_TASK = 16


@dataclass(frozen=True)
class Settings:
    """Parameters of the prediction pipelines."""

    hours: float = 3
    method: str = "median"
    k: int = 10
    importance_trees: int = 100
    importance_depth: int = 5
    model: str = "rf"
    n_trees: int = 100
    max_depth: int = 5
    rule: str = "nonzero"
    frac: float = 0.01
    min_keep: int = 0
    factor: float = 1.8
    seed: int = 1
    fit_partitions: int = FIT_PARTITIONS


def choose_features(
    series_df: DataFrame, vectors: DataFrame, names: DataFrame, settings: Settings,
    k: int | None = None,
) -> DataFrame:
    """(feature, index) of the features that tell the clusters of the series apart. Fits."""
    clusters, _ = cluster(
        series_df, k or settings.k, settings.seed, partitions=settings.fit_partitions
    )
    rows = importance(
        vectors, clusters, names, settings.importance_trees, settings.importance_depth,
        settings.seed, partitions=settings.fit_partitions,
    )
    chosen = select_features(
        rows, settings.rule, settings.frac, settings.min_keep, settings.factor
    )
    return feature_names(chosen)


def fold_features(
    panel: DataFrame, vectors: DataFrame, names: DataFrame, folds: DataFrame, settings: Settings
) -> DataFrame:
    """(fold, index, feature) that `choose_features` would name with each station left out.

    `folds` is (fold, k). The clusters of all folds are one k-means, the forests of all
    folds grow together; the number of jobs does not follow the folds. Fits.
    """
    clusters = cluster_folds(panel, folds, settings.seed)
    rows = importance_folds(
        vectors, clusters, names, n_trees=settings.importance_trees,
        max_depth=settings.importance_depth, seed=settings.seed,
    )
    chosen = select_by_fold(
        rows, settings.rule, settings.frac, settings.min_keep, settings.factor
    )
    return chosen.select("fold", "index", "feature")


def predict_grid(
    obs: DataFrame,
    features: DataFrame,
    grid_features: DataFrame,
    grid: DataFrame,
    when: str | tuple = "latest",
    min_support: int | None = None,
    support_frac: float = 0.75,
    settings: Settings = Settings(),
) -> DataFrame:
    """(gid, ts, prediction, lon, lat) for every grid point.

    `obs` is (station_id, ts, value), the feature tables are long rows, `grid` is
    (gid, lon, lat). `when` is 'latest' or a closed (start, end) range. Times with too
    few reporting stations are left out. Model choice runs eagerly, the rest is lazy.
    """
    cleaned = fill_gaps(obs.distinct(), hours=settings.hours, method=settings.method)
    stations = cleaned.select(F.col("station_id").alias("id")).distinct()
    chosen = _chosen(series(cleaned), features, stations, settings)
    context = to_vector(keyed(features), stations, chosen)
    targets = to_vector(keyed(grid_features), grid.select(F.col("gid").alias("id")), chosen)
    return _on_grid(cleaned, context, targets, grid, when, min_support, support_frac, settings)


def predict_grid_network(
    readings: DataFrame,
    directory: DataFrame,
    features: DataFrame,
    grid_features: DataFrame,
    grid: DataFrame,
    extra_obs: DataFrame | None = None,
    merge: str = "avg",
    tolerance: int = 31,
    when: str | tuple = "latest",
    min_support: int = 80,
    settings: Settings = Settings(rule="mean_factor"),
) -> DataFrame:
    """`predict_grid` trained on a two-channel sensor network, optionally with `extra_obs`.

    `readings` is (sensor_id, ts, value), `directory` maps sensor_id to id and channel.
    `extra_obs` (station_id, ts, value) joins the training in both modes of `when`.
    """
    merged = channel_readings(with_directory(readings, directory), merge)
    network = fill_gaps(
        merged.select(F.col("id").cast("string").alias("station_id"), "ts", "value"),
        hours=settings.hours, method=settings.method,
    )
    cleaned = network
    if extra_obs is not None:
        extra = fill_gaps(
            extra_obs.select("station_id", "ts", "value"),
            hours=settings.hours, method=settings.method,
        )
        cleaned = network.unionByName(extra)
    stations_series = series_tolerant(cleaned, network, tolerance)
    # they train the models even where no time is shared by all of them
    stations = tolerant_stations(cleaned, network, tolerance).select(
        F.col("station_id").alias("id")
    )
    chosen = _chosen(stations_series, features, stations, settings)
    context = to_vector(keyed(features), stations, chosen)
    targets = to_vector(keyed(grid_features), grid.select(F.col("gid").alias("id")), chosen)
    return _on_grid(cleaned, context, targets, grid, when, min_support, None, settings)


def validate_against(
    obs: DataFrame,
    features: DataFrame,
    truth: DataFrame,
    truth_features: DataFrame,
    when: str | tuple | None = None,
    min_support: int = 10,
    settings: Settings = Settings(),
) -> tuple[DataFrame, DataFrame]:
    """(predictions with truth, per-time errors) of one network against another.

    Trains on `obs` (station_id, ts, value) and predicts at the sensors and times of
    `truth` (id, ts, value). `when` None takes all times of `truth`.
    """
    cleaned = fill_gaps(obs, hours=settings.hours, method=settings.method)
    stations = cleaned.select(F.col("station_id").alias("id")).distinct()
    chosen = _chosen(series(cleaned), features, stations, settings)
    context = to_vector(keyed(features), stations, chosen)
    targets = to_vector(keyed(truth_features), truth.select("id"), chosen)
    times = _at(truth.select("ts").distinct(), when)
    train = support_gate(cleaned.join(times, "ts", "left_semi"), min_rows=min_support)
    predicted = _predict(train, context, targets, settings)
    keyed_truth = truth.withColumn("id", F.col("id").cast("string"))
    result = join_truth(predicted, keyed_truth, ["id", "ts"])
    return result, time_errors(result)


def sensor_truth(
    readings: DataFrame,
    directory: DataFrame,
    merge: str = "avg",
    exclude: str | None = None,
    near: DataFrame | None = None,
    max_dist: float = 50,
) -> DataFrame:
    """(id, ts, value) of a two-channel sensor network to validate against.

    `readings` is (sensor_id, ts, value). With `exclude` one channel is left out and the
    other is taken as it is; otherwise `merge` ('max', 'min', 'avg', 'a', 'b') makes one
    value of both. `near` (id, distance) keeps the sensors within `max_dist`.
    """
    known = with_directory(readings, directory)
    if exclude is None:
        rows = channel_readings(known, merge)
    else:
        rows = select_channel(known, exclude=exclude).select("id", "ts", "value")
    return rows if near is None else near_only(rows, near, max_dist).select("id", "ts", "value")


def validate_against_sensors(
    obs: DataFrame,
    features: DataFrame,
    readings: DataFrame,
    directory: DataFrame,
    sensor_features: DataFrame,
    when: str | tuple | None = None,
    min_support: int = 10,
    settings: Settings = Settings(),
    **truth_options,
) -> tuple[DataFrame, DataFrame]:
    """`validate_against` a two-channel sensor network; options as in `sensor_truth`."""
    truth = sensor_truth(readings, directory, **truth_options)
    return validate_against(obs, features, truth, sensor_features, when, min_support, settings)


def cross_validate(
    obs: DataFrame,
    features: DataFrame,
    when: tuple | None = None,
    k_by_station: Mapping[str, int] | DataFrame | None = None,
    min_support: int = 10,
    settings: Settings = Settings(),
) -> tuple[DataFrame, DataFrame]:
    """(predictions with truth, errors per station), every station held out once.

    Clusters and features of all folds are chosen in the same jobs, see `fold_features`.
    The per-timestamp fits of all folds then run in one pass over the readings: a
    timestamp holds one row per station, and a task fits a block of folds, each on the
    rows of the other stations with that fold's features. `k_by_station`, a mapping or a
    (station_id, k) table such as `station_clusters` of one parameter, gives the number of
    clusters per fold; other folds take it from `settings`.
    """
    cleaned = fill_gaps(obs, hours=settings.hours, method=settings.method)
    stations = cleaned.select(F.col("station_id").alias("id")).distinct()
    names = feature_names(keyed(features))
    vectors = to_vector(keyed(features), stations, names).persist()
    panel = series(cleaned).persist()
    try:
        folds = stations.withColumn("k", F.lit(settings.k))
        if k_by_station is not None:
            if isinstance(k_by_station, Mapping):
                k_by_station = obs.sparkSession.createDataFrame(
                    list(k_by_station.items()), "station_id string, k int"
                )
            tuned = k_by_station.select(F.col("station_id").alias("id"), F.col("k").alias("own_k"))
            folds = folds.join(tuned, "id", "left").select(
                "id", F.coalesce("own_k", "k").alias("k")
            )
        chosen = fold_features(
            panel, vectors, names, folds.select(F.col("id").alias("fold"), "k"), settings
        )
        listed = chosen.groupBy(F.col("fold").alias("id")).agg(
            F.array_sort(F.collect_list("index")).alias("mask")
        )
        empty = F.array().cast("array<int>")
        mask = cut(
            stations.join(listed, "id", "left").select("id", F.coalesce("mask", empty).alias("mask")),
            "fold-features",
        )
    finally:
        panel.unpersist()
        vectors.unpersist()
    n_folds = mask.count()
    tested = cleaned if when is None else cleaned.where(F.col("ts").between(*when))
    rows = training_rows(tested, vectors, keep_null_labels=True).join(mask, "id")
    blocks = max(1, -(-n_folds // _FOLDS_PER_TASK))
    held_out = _held_out_predictions(rows, blocks, min_support, settings)
    truth = obs.select(F.col("station_id").alias("id"), "ts", "value")
    result = join_truth(held_out, truth, ["id", "ts"]).withColumnRenamed("id", "station_id")
    return result, errors(result, by=["station_id"])


def _held_out_predictions(
    rows: DataFrame, blocks: int, min_support: int, settings: Settings
) -> DataFrame:
    fit = {"rf": forest.fit_forest, "gbt": forest.fit_boosted}[settings.model]

    def one_time(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "label"]).reset_index(drop=True)
        x = np.array(pdf["features"].tolist(), dtype=float).reshape(len(pdf), -1)
        label, weight = pdf["label"].to_numpy(float), pdf["weight"].to_numpy(float)
        found = []
        for at in pdf[pdf["home"] == key[1]].drop_duplicates("id").index:
            others = (pdf["id"] != pdf["id"][at]).to_numpy()
            usable = others & ~np.isnan(label)
            if weight[others].sum() < min_support or not usable.any():
                continue
            cols = np.asarray(pdf["mask"][at], dtype=int)
            fitted = fit(
                x[usable][:, cols], label[usable], weight[usable],
                settings.n_trees, settings.max_depth, settings.seed + int(key[0].timestamp()),
            )
            value = forest.predict(fitted, x[at : at + 1, cols])[0]
            found.append((pdf["id"][at], key[0], float(value)))
        return pd.DataFrame(found, columns=["id", "ts", "prediction"])

    placed = rows.withColumn("home", F.pmod(F.hash("id"), F.lit(blocks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    fitted = spread(placed, "ts", "block").groupBy("ts", "block")
    return fitted.applyInPandas(one_time, "id string, ts timestamp, prediction double")


def _chosen(
    panel: DataFrame, features: DataFrame, stations: DataFrame, settings: Settings
) -> DataFrame:
    """(feature, index) of the chosen features. Without series nothing tells features apart,
    so none is chosen and the models fall back to the mean of a time."""
    own = keyed(features).persist()
    names = feature_names(own)
    kept = panel.persist()
    vectors = to_vector(own, stations, names).persist()
    try:
        listed = []
        if not kept.isEmpty():
            chosen = choose_features(kept, vectors, names, settings)
            listed = [(r["feature"], r["index"]) for r in chosen.collect()]
    finally:
        kept.unpersist()
        vectors.unpersist()
        own.unpersist()
    return features.sparkSession.createDataFrame(listed, "feature string, index int")


def _on_grid(
    cleaned: DataFrame, context: DataFrame, targets: DataFrame, grid: DataFrame,
    when: str | tuple, min_support: int | None, frac: float | None, settings: Settings,
) -> DataFrame:
    gated = support_gate(
        _at(cleaned, when),
        min_rows=min_support,
        frac=frac if min_support is None else None,
        stations=cleaned,
    )
    # the places go along with the targets: joined later, they would meet a row per time
    points = grid.select(F.col("gid").cast("string").alias("id"), "lon", "lat")
    predicted = _predict(gated, context, targets.join(points, "id"), settings, ("lon", "lat"))
    return predicted.withColumnRenamed("id", "gid").select("gid", "ts", "prediction", "lon", "lat")


def _predict(
    train: DataFrame, context: DataFrame, targets: DataFrame, settings: Settings,
    keep: Sequence[str] = (),
) -> DataFrame:
    return predict(
        train, context, targets, settings.model, settings.n_trees, settings.max_depth,
        settings.seed, keep=keep,
    )


def _at(df: DataFrame, when: str | tuple | None) -> DataFrame:
    if when is None:
        return df
    if when == "latest":
        return df.where(F.col("ts") == df.agg(F.max("ts")).scalar())
    return df.where(F.col("ts").between(*when))
