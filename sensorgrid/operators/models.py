"""Clustering, feature importance, and prediction from geographic context."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sensorgrid.functions import unix_seconds
from sensorgrid.operators import forest
from sensorgrid.operators.fold_clusters import k_sweep  # noqa: F401
from sensorgrid.operators.features import as_scaled_vector, importance_rows
from sensorgrid.operators.panel import as_vector
from sensorgrid.operators.spread import spread

_MODEL_FIELDS = (
    "feature array<int>, threshold array<double>, lower array<int>, upper array<int>, "
    "value array<double>, root array<int>, share array<double>"
)
#: partitions of the station rows that a model is fitted on; raise it for large networks
FIT_PARTITIONS = 4
#: times whose ensembles may share a chunk
_CHUNK_TIMES = 64
_MODEL_COLUMNS = ("feature", "threshold", "lower", "upper", "value", "root", "share")

# Tuned number of clusters per held-out station, by parameter (hourly).
STATION_CLUSTERS = {
    "PM2.5": {
        "Central LA CO": 9, "W San Gabriel Vly": 9, "San Gabriel Mts": 9,
        "SW San Bernardino": 9, "W San Fernando Vly": 10, "E San Fernando Vly": 10,
        "E San Gabriel V-2": 10, "E San Gabriel V-1": 10, "NW Coastal LA": 10,
        "Santa Clarita Vly": 9, "SW Coastal LA": 10, "South Coastal LA": 10,
        "Southeast LA CO": 9, "Antelope Vly": 9,
    },
    "PM10": {
        "Central LA CO": 5, "W San Gabriel Vly": 5, "San Gabriel Mts": 5,
        "SW San Bernardino": 4, "E San Gabriel V-2": 5, "E San Gabriel V-1": 5,
        "Southeast LA CO": 4, "Antelope Vly": 4,
    },
    "O3": {
        "W San Fernando Vly": 11, "Central LA CO": 10, "South Coastal LA": 10,
        "W San Gabriel Vly": 10, "E San Gabriel V-1": 11, "E San Gabriel V-2": 11,
        "Southeast LA CO": 11, "SW Coastal LA": 12, "Antelope Vly": 11,
        "Pomona Walnut Vly": 12, "NW Coastal LA": 12, "S San Gabriel Vly": 11,
        "San Gabriel Mts": 11, "SW San Bernardino": 11, "S Central LA CO": 11,
        "Santa Clarita Vly": 11, "E San Fernando Vly": 13,
    },
}


def station_clusters(spark: SparkSession) -> DataFrame:
    """(station_id, parameter, k) of the tuned cluster numbers."""
    rows = [(s, p, k) for p, per_station in STATION_CLUSTERS.items() for s, k in per_station.items()]
    return spark.createDataFrame(rows, "station_id string, parameter string, k int")


def cluster(
    series: DataFrame, k: int, seed: int = 1, max_iter: int = 100, col: str = "series",
    id_col: str = "station_id", partitions: int = FIT_PARTITIONS,
) -> tuple[DataFrame, float]:
    """(rows with `cluster`, within-set squared error) of k-means on the scaled series. Fits.

    The scaled rows stay cached: the fit passes over them many times, and the result
    reads them again.
    """
    scaled = as_scaled_vector(packed(series, id_col, partitions), col).persist()
    model = KMeans(
        k=k, maxIter=max_iter, seed=seed, featuresCol="scaled", predictionCol="cluster"
    ).fit(scaled)
    return model.transform(scaled).drop("scaled"), float(model.summary.trainingCost)


def importance(
    vectors: DataFrame,
    clusters: DataFrame,
    names: DataFrame,
    n_trees: int = 100,
    max_depth: int = 5,
    seed: int = 1,
    id_col: str = "id",
    cluster_id: str = "station_id",
    partitions: int = FIT_PARTITIONS,
) -> DataFrame:
    """(index, feature, importance): how well each feature tells the clusters apart. Fits."""
    labelled = vectors.join(
        clusters.select(F.col(cluster_id).alias(id_col), F.col("cluster").cast("double")), id_col
    )
    kept = labelled.persist()
    try:
        scaled = as_scaled_vector(packed(kept, id_col, partitions), "features")
        model = RandomForestClassifier(
            numTrees=n_trees, maxDepth=max_depth, seed=seed,
            featuresCol="scaled", labelCol="cluster",
        ).fit(scaled)
    finally:
        kept.unpersist()
    vector = vectors.sparkSession.createDataFrame([(model.featureImportances,)], ["importance"])
    return importance_rows(vector, names)


def training_rows(
    train: DataFrame, context: DataFrame, id_col: str = "station_id", ts_col: str = "ts",
    label_col: str = "label", keep_null_labels: bool = False,
) -> DataFrame:
    """(id, ts, label, weight, features): labels joined to their station's context.

    Copies of a reading become one row with a weight, so the rows of one timestamp
    are bounded by its stations.
    """
    usable = F.col(ts_col).isNotNull()
    if not keep_null_labels:
        usable = usable & F.col(label_col).isNotNull()
    counted = (
        train.where(usable)
        .groupBy(
            F.col(id_col).alias("id"), F.col(ts_col).alias("ts"), F.col(label_col).alias("label")
        )
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    return counted.join(context.select("id", "features"), "id")


def fit_by_time(
    rows: DataFrame, model: str = "rf", n_trees: int = 100, max_depth: int = 5, seed: int = 1
) -> DataFrame:
    """(ts, ensemble columns): one ensemble per timestamp of `training_rows`."""
    fit = {"rf": forest.fit_forest, "gbt": forest.fit_boosted}[model]

    def one_time(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "label"])
        x = np.array(pdf["features"].tolist(), dtype=float).reshape(len(pdf), -1)
        fitted = fit(
            x, pdf["label"].to_numpy(float), pdf["weight"].to_numpy(float),
            n_trees, max_depth, seed + int(key[0].timestamp()),
        )
        return pd.DataFrame({"ts": [key[0]], **{c: [fitted[c]] for c in _MODEL_COLUMNS}})

    return spread(rows, "ts").groupBy("ts").applyInPandas(one_time, f"ts timestamp, {_MODEL_FIELDS}")


def predict_by_time(
    models: DataFrame,
    times: DataFrame,
    target_context: DataFrame,
    chunk_hours: float = 24,
    targets_per_block: int = 2000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, ts, prediction, *keep): every ensemble applied to every target.

    The output has times x targets rows whatever the plan. Ensembles are copied to
    the target blocks and targets to the time chunks, and each (chunk, block) is
    one group of bounded size; neither side is broadcast or collected. A chunk spans
    `chunk_hours` or, where it would hold few times, as many of these as hold up to
    `_CHUNK_TIMES`. `times` lists the timestamps that `models` may hold, `keep` columns
    of the targets that the rows carry on.
    """
    width = int(chunk_hours * 3600)
    span = F.floor(unix_seconds(F.col("ts")) / F.lit(width)).cast("long")
    held = times.where(F.col("ts").isNotNull()).select("ts").distinct()
    held = held.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    first = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(_CHUNK_TIMES))
    spans = held.select("span", first.cast("long").alias("_chunk"))
    chunks = spans.select("_chunk").distinct().agg(F.collect_set("_chunk"))
    n_targets = target_context.select("id").agg(F.count(F.lit(1)))
    last_block = F.floor(n_targets.scalar() / F.lit(targets_per_block)).cast("int")
    placed = (
        models.withColumn("span", span).join(spans, "span").drop("span")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), last_block)))
    )
    targets = (
        target_context.select("id", "features", *keep)
        .withColumn("_block", F.pmod(F.hash("id", *keep), last_block + 1))
        .withColumn("_chunk", F.explode(chunks.scalar()))
    )
    kept = [target_context.schema[name] for name in keep]
    schema = StructType(
        [StructField("id", StringType()), models.schema["ts"], StructField("prediction", DoubleType()), *kept]
    )

    def one_block(fitted: pa.Table, points: pa.Table) -> pa.Table:
        n, k = points.num_rows, fitted.num_rows
        flat = points.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.astype(float).reshape(n, -1) if n else np.empty((0, 0))
        ensembles = fitted.select(_MODEL_COLUMNS).to_pylist()
        predicted = [forest.predict(e, x) for e in ensembles] if n else []
        of_point, of_time = np.tile(np.arange(n), k), np.repeat(np.arange(k), n)
        return pa.table({
            "id": points.column("id").take(of_point),
            "ts": fitted.column("ts").take(of_time),
            "prediction": np.concatenate([np.empty(0), *predicted]),
            **{name: points.column(name).take(of_point) for name in keep},
        })

    return (
        spread(placed, "_chunk", "_block").groupBy("_chunk", "_block")
        .cogroup(spread(targets, "_chunk", "_block").groupBy("_chunk", "_block"))
        .applyInArrow(one_block, schema)
    )


def predict(
    train: DataFrame,
    context: DataFrame,
    target_context: DataFrame,
    model: str = "rf",
    n_trees: int = 100,
    max_depth: int = 5,
    seed: int = 1,
    id_col: str = "station_id",
    ts_col: str = "ts",
    label_col: str = "label",
    chunk_hours: float = 24,
    targets_per_block: int = 2000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, ts, prediction, *keep) for every timestamp of `train` and every target.

    Each timestamp gets its own ensemble ('rf' or 'gbt'), fitted on that
    timestamp's labels and the stations' context vectors. `keep` names columns of the
    targets that the rows carry on.
    """
    rows = training_rows(train, context, id_col, ts_col, label_col)
    models = fit_by_time(rows, model, n_trees, max_depth, seed)
    times = train.select(F.col(ts_col).alias("ts"))
    return predict_by_time(models, times, target_context, chunk_hours, targets_per_block, keep)


def predict_once(
    train: DataFrame,
    context: DataFrame,
    target_context: DataFrame,
    model: str = "rf",
    n_trees: int = 100,
    max_depth: int = 5,
    seed: int = 1,
    id_col: str = "station_id",
    label_col: str = "label",
) -> DataFrame:
    """(id, prediction) from one Spark ML fit on all rows of `train`. Fits eagerly.

    For one timestamp with many stations, e.g. the latest; `predict` is the form
    for many timestamps.
    """
    labelled = train.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")
    )
    rows = as_vector(labelled.join(context.select("id", "features"), "id"), "features")
    if model == "rf":
        fitter = RandomForestRegressor(numTrees=n_trees, maxDepth=max_depth, seed=seed)
    elif model == "gbt":
        fitter = GBTRegressor(maxIter=n_trees, maxDepth=max_depth, seed=seed)
    else:
        raise ValueError("model must be 'rf' or 'gbt'")
    kept = rows.persist()
    try:
        fitted = fitter.fit(packed(kept, "id"))
    finally:
        kept.unpersist()
    targets = as_vector(target_context.select("id", "features"), "features")
    return fitted.transform(targets).select("id", "prediction")


def packed(rows: DataFrame, id_col: str, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """One row per station, laid out by a hash of the station in a fixed order.

    Bagging and the start of k-means depend on the layout of the rows, so it depends on
    the stations only, not on their number or on the session.
    """
    return rows.repartition(partitions, id_col).sortWithinPartitions(id_col)
