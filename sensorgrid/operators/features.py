"""Geographic features: long (id, layer, class, ring, value) rows and dense vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.functions import feature_key
from sensorgrid.operators.numbering import number_rows

FEATURE_COLUMNS = ("id", "geo_feature", "feature_type", "buffer_size", "value")


def union_layers(layers: Mapping[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """All layers as one feature table with the columns and types of `FEATURE_COLUMNS`."""
    frames = list(layers.values()) if isinstance(layers, Mapping) else list(layers)
    typed = [
        f.select(
            F.col("id").cast("string").alias("id"),
            F.col("geo_feature").cast("string").alias("geo_feature"),
            F.col("feature_type").cast("string").alias("feature_type"),
            F.col("buffer_size").cast("int").alias("buffer_size"),
            F.col("value").cast("double").alias("value"),
        )
        for f in frames
    ]
    return reduce(DataFrame.unionByName, typed)


def scalar_layers(df: DataFrame, columns: Mapping[str, str], id_col: str = "id") -> DataFrame:
    """Plain numbers of a location as features of layer 'location' and ring 0.

    `columns` maps a feature name (longitude, latitude, ocean, elevation) to its column.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("feature_type"), F.col(col).cast("double").alias("value"))
            for name, col in columns.items()
        ]
    )
    return df.select(F.col(id_col).cast("string").alias("id"), F.inline(pairs)).select(
        "id",
        F.lit("location").alias("geo_feature"),
        "feature_type",
        F.lit(0).alias("buffer_size"),
        "value",
    )


def keyed(eav: DataFrame) -> DataFrame:
    """(id, feature, value) with the three name columns joined to one key."""
    key = feature_key(F.col("geo_feature"), F.col("feature_type"), F.col("buffer_size"))
    return eav.select("id", key.alias("feature"), "value")


def feature_names(features: DataFrame) -> DataFrame:
    """(feature, index): distinct keys in name order, numbered from 0.

    The table of names has one row per layer, class and ring, so numbering it in
    one task is safe however many locations there are.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy("feature")
    return (
        features.select("feature")
        .distinct()
        .select("feature", (F.row_number().over(by_name) - 1).alias("index"))
    )


def to_vector(
    features: DataFrame, ids: DataFrame, names: DataFrame, id_col: str = "id"
) -> DataFrame:
    """(id, features): for every id one array over all of `names`, absent features as 0.0.

    Only present features travel; the gaps between them are filled in place, so the
    work per id grows with the length of the vector and the plan does not grow at all.
    Repeated values of a feature are averaged.
    """
    size = F.coalesce(names.agg(F.max("index")).scalar() + 1, F.lit(0)).cast("int")
    cells = (
        features.join(names, "feature")
        .groupBy("id", "feature", "index")
        .agg(F.avg("value").alias("value"))
        .groupBy("id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("index", F.coalesce("value", F.lit(0.0)).alias("value")))
            ).alias("_cells")
        )
    )
    wanted = ids.select(F.col(id_col).cast("string").alias("id")).distinct()
    joined = wanted.join(cells, "id", "left").withColumn("_size", size)

    def spaced(cell, i):
        previous = F.when(i == 0, F.lit(-1)).otherwise(
            F.get(F.col("_cells"), i - 1).getField("index")
        )
        zeros = F.array_repeat(F.lit(0.0), cell.getField("index") - previous - 1)
        return F.concat(zeros, F.array(cell.getField("value")))

    last = F.element_at("_cells", -1).getField("index")
    tail = F.array_repeat(F.lit(0.0), F.col("_size") - last - 1)
    dense = F.concat(F.flatten(F.transform("_cells", spaced)), tail)
    empty = F.array_repeat(F.lit(0.0), F.col("_size"))
    return joined.select(
        "id", F.when(F.col("_cells").isNull(), empty).otherwise(dense).alias("features")
    )


def pivot_wide(features: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One column per feature key, averaged. Give `names` to skip the scan that finds them.

    Meant for up to some thousand names; `to_vector` has no such bound.
    """
    return features.groupBy("id").pivot("feature", list(names) if names else None).avg("value")


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric columns as one vector, nulls as 0.0."""
    filled = df.na.fill(0.0, subset=list(cols))
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(filled)


def scale(df: DataFrame, col: str, out: str) -> DataFrame:
    """Vector column with mean 0 and sample standard deviation 1 per slot. Fits eagerly."""
    scaler = StandardScaler(inputCol=col, outputCol=out, withMean=True, withStd=True)
    return scaler.fit(df).transform(df)


def as_scaled_vector(df: DataFrame, col: str, out: str = "scaled") -> DataFrame:
    """Array column as a scaled vector `out`; the array stays. Fits eagerly."""
    return scale(df.withColumn("_vector", array_to_vector(F.col(col))), "_vector", out).drop(
        "_vector"
    )


def pca(df: DataFrame, col: str, n: int, out: str) -> tuple[DataFrame, PCAModel]:
    """Vector column projected on its first `n` principal components. Fits eagerly."""
    model = PCA(k=n, inputCol=col, outputCol=out).fit(df)
    return model.transform(df), model


def importance_rows(importance: DataFrame, names: DataFrame, col: str = "importance") -> DataFrame:
    """(index, feature, importance) rows of a one-row importance vector."""
    return (
        importance.select(F.posexplode(vector_to_array(F.col(col))).alias("index", "importance"))
        .join(names, "index")
        .select("index", "feature", "importance")
    )


def select_features(
    importance: DataFrame,
    rule: str = "nonzero",
    frac: float = 0.01,
    min_keep: int = 0,
    factor: float = 1.8,
) -> DataFrame:
    """Rows of an importance table to keep.

    'nonzero' keeps every importance other than 0. 'top_frac' keeps the first
    int(`frac` x count) of them by falling importance (then name), at least
    `min_keep`. 'mean_factor' keeps those above `factor` x their mean.
    """
    nonzero = importance.where(F.col("importance") != 0)
    if rule == "nonzero":
        return nonzero
    if rule == "top_frac":
        keep = F.greatest(
            F.floor(nonzero.agg(F.count(F.lit(1))).scalar() * F.lit(float(frac))), F.lit(min_keep)
        )
        # a bucket holds importances within about one percent of each other
        falling = nonzero.withColumn("_fall", -F.col("importance"))
        step = F.when(
            F.col("importance") > 0, F.floor(-64 * F.log2(F.abs("importance")))
        ).otherwise(F.lit(1 << 20))
        ranked = number_rows(falling, ["_fall", "feature"], step, start=1, out="_rank").drop("_fall")
        return ranked.where(F.col("_rank") <= keep).drop("_rank")
    if rule == "mean_factor":
        mean = nonzero.agg(F.avg("importance"))
        return nonzero.where(F.col("importance") > mean.scalar() * F.lit(float(factor)))
    raise ValueError("rule must be 'nonzero', 'top_frac' or 'mean_factor'")


def sorted_features(importance: DataFrame) -> DataFrame:
    """Non-zero features by falling importance, then by name."""
    return select_features(importance).orderBy(F.desc("importance"), "feature")
