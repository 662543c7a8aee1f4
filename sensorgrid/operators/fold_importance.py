"""Feature importance for every fold at once, by forests grown level by level.

Features are binned once over all rows. Trees of all folds are rows of splits; one pass
over the stations adds a level to every tree: each block counts (node, feature, bin, class)
for the trees of a part, the counts are summed, and each node takes its best split. The
number of jobs follows the depth, not the folds or trees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.operators.fold_tiles import (
    FOLDS_PER_PART, cut, mark, pieces, salt_of, tile_pass, uniform, unmark,
)

_COLUMNS = ["part", "fold", "tree", "node", "role", "feature", "bin", "gain", "counts"]
_TREES_PER_PART = 8
_LEAST_GAIN = 1e-9


def forest_splits(
    vectors: DataFrame,
    clusters: DataFrame,
    n_trees: int = 100,
    max_depth: int = 5,
    seed: int = 1,
    max_bins: int = 32,
    bagging: bool = True,
    every_feature: bool = False,
    id_col: str = "id",
) -> DataFrame:
    """(fold, tree, node, feature, threshold, gain) of classification forests, one per fold.

    `vectors` is (id, features), `clusters` (fold, id, cluster) holds the rows of each fold.
    Node 1 is the root, node n has the children 2n and 2n + 1; rows up to `threshold` go to
    the first. `gain` is the drop of the Gini impurity times the weight of the node. Nodes
    look at the square root of the features' number, or at `every_feature`; rows weigh a
    Poisson draw per tree, or 1 without `bagging`. Thresholds are values of all `vectors`, at
    most `max_bins` - 1 quantiles per feature. Ties go to the lower feature, then threshold.
    Folds without a split have no rows. Fits.
    """
    flat = vectors.select(F.posexplode("features").alias("feature", "value"))
    shares = [i / max_bins for i in range(1, max_bins)]
    limits = cut(
        flat.groupBy("feature").agg(
            F.percentile_approx("value", F.array(*map(F.lit, shares)), 10_000).alias("q"),
            F.max("value").alias("most"),
        ).select("feature", F.filter(
            F.array_sort(F.array_distinct("q")), lambda v: v < F.col("most")
        ).alias("limits")),
        "forest-bins",
    )
    labels = clusters.where(F.col("cluster").isNotNull()).select(
        mark(F.col("fold")).alias("fold"), F.col("id").cast("string").alias("id"),
        F.col("cluster").cast("int").alias("cluster"),
    )
    width, n_bins = limits.agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size("limits")), F.lit(0)) + 1
    ).first()
    labels = cut(labels, "forest-labels")
    n_folds, last_class, most_rows = labels.agg(
        F.count_distinct("fold"), F.coalesce(F.max("cluster"), F.lit(0)), F.count(F.lit(1))
    ).first()
    tree_parts = -(-n_trees // _TREES_PER_PART)
    fold_parts = max(1, -(-n_folds // FOLDS_PER_PART))
    blocks = pieces(most_rows / max(1, n_folds) * max(1, width))
    home = F.pmod(F.xxhash64("fold"), F.lit(fold_parts)).cast("int").alias("home")

    listed = limits.agg(F.array_sort(F.collect_list(F.struct("feature", "limits")))).scalar()
    binned = vectors.select(
        F.col(id_col).cast("string").alias("id"), "features", listed.alias("limits")
    ).select("id", F.transform("features", lambda v, i: F.size(F.filter(
        F.get("limits", i).getField("limits"), lambda t: t < v
    ))).cast("array<smallint>").alias("bins"))
    by_home = labels.groupBy(home, "id").agg(
        F.array_sort(F.collect_list(F.struct("fold", "cluster"))).alias("own")
    )
    tree_part = F.explode(F.sequence(F.lit(0), F.lit(tree_parts - 1)))
    key = F.xxhash64("id")
    rows = cut(
        binned.join(by_home, "id").select(
            "bins", key.alias("key"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"),
            F.col("own.fold").alias("folds"), F.col("own.cluster").alias("classes"),
            F.col("home"), tree_part.alias("at"),
        ).withColumn("part", F.col("home") * tree_parts + F.col("at")).drop("home", "at"),
        "forest-rows",
    )
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))
    state = labels.select("fold").distinct().select("fold", home, trees.alias("tree")).select(
        (F.col("home") * tree_parts + F.col("tree") % tree_parts).alias("part"), "fold", "tree",
        F.lit(0).alias("node"), F.lit("tree").alias("role"), F.lit(-1).alias("feature"),
        F.lit(-1).alias("bin"), F.lit(0.0).alias("gain"),
        F.array().cast("array<double>").alias("counts"),
    )
    shape = (width if every_feature else max(1, int(np.ceil(np.sqrt(width)))), n_bins, last_class + 1)
    for depth in range(max_depth if width else 0):
        add = _add_counts(seed, depth, width, shape, bagging)
        state = cut(tile_pass(rows, blocks, state, add, _merge_counts(seed, width, shape)), "forest")
    found = state.where("role = 'split'").join(limits, "feature")
    return found.select(
        unmark(F.col("fold")).alias("fold"), "tree", "node", "feature",
        F.get("limits", F.col("bin")).alias("threshold"), "gain",
    )


def importance_folds(
    vectors: DataFrame, clusters: DataFrame, names: DataFrame, **options
) -> DataFrame:
    """(fold, index, feature, importance): how well features tell the clusters of a fold apart.

    Gains of `forest_splits` (same `options`) are shared out within each tree, averaged over
    the trees that split and add up to 1 per fold. Features that are never used have no row.
    """
    splits = cut(forest_splits(vectors, clusters, **options), "forest-splits")
    fold = mark(F.col("fold")).alias("fold")
    gains = splits.groupBy(fold, "tree", "feature").agg(F.sum("gain").alias("gain"))
    tree = gains.groupBy("fold", "tree").agg(F.sum("gain").alias("total"))
    split_trees = tree.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    shares = gains.join(tree, ["fold", "tree"]).groupBy("fold", "feature").agg(
        F.sum(F.col("gain") / F.col("total")).alias("share")
    )
    return (
        shares.join(split_trees, "fold").withColumnRenamed("feature", "index").join(names, "index")
        .select(unmark(F.col("fold")).alias("fold"), "index", "feature",
                (F.col("share") / F.col("n")).alias("importance"))
    )


def select_by_fold(
    importance: DataFrame, rule: str = "nonzero", frac: float = 0.01, min_keep: int = 0,
    factor: float = 1.8,
) -> DataFrame:
    """`select_features` within each fold of an importance table (fold, feature, ...).

    A fold has no more rows than there are features, so it may be ranked in one task.
    """
    nonzero = importance.where(F.col("importance") != 0)
    if rule == "nonzero":
        return nonzero
    fold = Window.partitionBy("fold")
    if rule == "top_frac":
        ranked = nonzero.withColumn(
            "_rank", F.row_number().over(fold.orderBy(F.desc("importance"), "feature"))
        ).withColumn("_n", F.count(F.lit(1)).over(fold))
        keep = F.greatest(F.floor(F.col("_n") * F.lit(float(frac))), F.lit(min_keep))
        return ranked.where(F.col("_rank") <= keep).drop("_rank", "_n")
    if rule == "mean_factor":
        judged = nonzero.withColumn("_mean", F.avg("importance").over(fold))
        return judged.where(F.col("importance") > F.col("_mean") * F.lit(float(factor))).drop("_mean")
    raise ValueError("rule must be 'nonzero', 'top_frac' or 'mean_factor'")


def _tried(seed: int, fold: str, tree: int, node: int, width: int, n: int) -> np.ndarray:
    """The features that a node looks at, ascending."""
    if n >= width:
        return np.arange(width)
    rng = np.random.default_rng([seed, salt_of(fold), tree, node])
    return np.sort(rng.choice(width, n, replace=False))


def _poisson(u: np.ndarray) -> np.ndarray:
    """Poisson draws of mean 1 from uniform numbers."""
    steps = np.exp(-1.0) / np.cumprod(np.maximum(np.arange(12), 1))
    return np.searchsorted(np.cumsum(steps), u).astype(float)


def _add_counts(seed: int, depth: int, width: int, shape: tuple[int, int, int], bagging: bool):
    n_tried, n_bins, n_classes = shape

    def add(block: pd.DataFrame, part: pd.DataFrame, first: bool) -> pd.DataFrame:
        found = [tuple(r) for r in part[_COLUMNS].itertuples(index=False)] if first else []
        if block.empty:
            return pd.DataFrame(found, columns=_COLUMNS)
        bins = np.array(block["bins"].tolist(), dtype=np.int64).reshape(len(block), width)
        keys = block["key"].to_numpy()
        row = np.repeat(np.arange(len(block)), block["folds"].map(len))
        folds, classes = np.concatenate(block["folds"].tolist()), np.concatenate(block["classes"].tolist())
        for (fold, tree), nodes in part.groupby(["fold", "tree"]):
            mine = folds == fold
            own, y = row[mine], classes[mine].astype(np.int64)
            weight = np.ones(len(own))
            if bagging:
                weight = _poisson(uniform(keys[own], seed, salt_of(fold), tree))
            feature, limit = np.full(2 << depth, -1), np.zeros(2 << depth, dtype=np.int64)
            splits = nodes[nodes["role"] == "split"]
            feature[splits["node"]], limit[splits["node"]] = splits["feature"], splits["bin"]
            at = np.where(weight > 0, 1, 0)
            for _ in range(depth):
                low = bins[own, np.maximum(feature[at], 0)] <= limit[at]
                at = np.where(feature[at] < 0, 0, 2 * at + ~low)
            for node in np.unique(at[at > 0]):
                here = at == node
                tried = _tried(seed, fold, int(tree), int(node), width, n_tried)
                slot = np.arange(len(tried)) * n_bins + bins[own[here]][:, tried]
                counts = np.bincount(
                    (slot * n_classes + y[here][:, None]).ravel(),
                    np.repeat(weight[here], len(tried)), len(tried) * n_bins * n_classes,
                )
                found.append((nodes["part"].iloc[0], fold, tree, node, "counts", -1, -1, 0.0, counts))
        return pd.DataFrame(found, columns=_COLUMNS)

    return add


def _merge_counts(seed: int, width: int, shape: tuple[int, int, int]):
    n_tried, n_bins, n_classes = shape

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        merged = [tuple(r) for r in found[found["role"] != "counts"][_COLUMNS].itertuples(index=False)]
        part = found["part"].iloc[0]
        counted = found[found["role"] == "counts"]
        for (fold, tree, node), rows in counted.groupby(["fold", "tree", "node"]):
            counts = np.sum(rows["counts"].tolist(), axis=0).reshape(-1, n_bins, n_classes)
            low = np.cumsum(counts, axis=1)
            all_ = low[:, -1:, :]
            high = all_ - low
            score = _purity(low) + _purity(high) - _purity(all_)
            score = np.round(score, 9)
            feature, at = np.unravel_index(np.argmax(score), score.shape)
            if score[feature, at] > _LEAST_GAIN:
                tried = _tried(seed, fold, int(tree), int(node), width, n_tried)
                merged.append((part, fold, tree, node, "split", int(tried[feature]), int(at),
                               float(score[feature, at]), []))
        return pd.DataFrame(merged, columns=_COLUMNS)

    return merge


def _purity(counts: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over the weight; 0 without weight."""
    total = counts.sum(axis=-1)
    return np.divide((counts**2).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)
