"""k-means for every (fold, k) at once.

The centres of all models are rows. One pass over the stations moves all of them, so the
number of jobs follows the iterations and not the folds. Seeds are drawn as in k-means++:
the next one falls on a row with a probability in proportion to its squared distance from
those before, by the largest log(u) / distance with u a hash of the row. The first k seeds
of a fold start its model of k clusters; of several starts the one with the least error stays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.operators.fold_tiles import (
    FOLDS_PER_PART, cut, fold_table, mark, own_mark, pieces, salt_of, tile_pass, uniform, unmark,
)

_COLUMNS = ["part", "fold", "start", "k", "cluster", "role", "amount", "x"]
_PASSES_PER_JOB = 4


def cluster_folds(
    series: DataFrame,
    models: DataFrame,
    seed: int = 1,
    max_iter: int = 100,
    tol: float = 1e-4,
    id_col: str = "station_id",
    col: str = "series",
    starts: int = 4,
) -> DataFrame:
    """(fold, k, id, cluster, gap): the cluster of every row in each of `models` (fold, k).

    Fold f is fitted on the rows other than `id_col` = f; slots are scaled to mean 0 and
    sample deviation 1 over the rows of the fold, constant slots to 0. `gap` is the squared
    distance from the centre. A model stops when no centre moves further than `tol`. A
    centre that loses its rows stays; of fewer than k distinct rows each is a centre. Ties
    go to the lower cluster, then to the earlier of the `starts`. Rows without an id belong to every fold. Fits.
    """
    wanted = cut(
        models.select(mark(F.col("fold")).alias("fold"), F.col("k").cast("int").alias("k")).distinct(),
        "kmeans-models",
    )
    rows, blocks, width = _placed(series, id_col, col)
    n_models, total_k, n_folds, most = wanted.agg(
        F.count(F.lit(1)), F.sum("k"), F.count_distinct("fold"), F.max("k")
    ).first()
    parts = max(-(-(n_folds or 0) // FOLDS_PER_PART), pieces(starts * (total_k or 0) * max(1, width)))
    part = F.pmod(F.xxhash64("fold"), F.lit(parts)).cast("int").alias("part")

    start = wanted.groupBy("fold").agg(F.max("k").alias("k")).select(
        part, "fold", F.lit(-1).alias("start"), "k", F.lit(-1).alias("cluster"), F.lit("fold").alias("role"),
        F.lit(0.0).alias("amount"), F.array().cast("array<double>").alias("x"),
    )
    state = tile_pass(rows, blocks, start, _add_moments, _merge_moments)
    for at in range(most or 0):
        state = tile_pass(rows, blocks, state, _add_picks(seed, at, starts), _merge_picks)
        if at % _PASSES_PER_JOB == _PASSES_PER_JOB - 1:
            state = cut(state, "kmeans-seeds")
    state = cut(state, "kmeans-seeds")
    seeds = state.where("role = 'centre'").withColumnRenamed("k", "_most")
    centres = seeds.join(wanted, "fold").where(F.col("cluster") < F.col("k")).select(*_COLUMNS)
    state = cut(state.where("role in ('mean', 'scale')").unionByName(centres), "kmeans")
    for at in range(0, max_iter, _PASSES_PER_JOB):
        for _ in range(min(_PASSES_PER_JOB, max_iter - at)):
            state = tile_pass(rows, blocks, state, _add_moves(tol), _merge_moves)
        state = cut(state, "kmeans")
        if state.where((F.col("role") == "centre") & (F.col("amount") > tol)).isEmpty():
            break
    best = _assigned(rows, blocks, state).groupBy("fold", "k", "start").agg(
        F.sum("gap").alias("cost")
    ).groupBy("fold", "k").agg(F.min_by("start", F.struct("cost", "start")).alias("start"))
    chosen = state.where("role in ('mean', 'scale')").unionByName(
        state.where("role = 'centre'").join(best, ["fold", "k", "start"], "left_semi")
    )
    found = _assigned(rows, blocks, cut(chosen, "kmeans-best"))
    return found.select(unmark(F.col("fold")).alias("fold"), "k", "id", "cluster", "gap")


def k_sweep(
    series: DataFrame,
    ks: Sequence[int],
    folds: DataFrame | Sequence[str | None] = (None,),
    id_col: str = "station_id",
    seed: int = 1,
    max_iter: int = 100,
) -> DataFrame:
    """(fold, k, cost): within-set squared error of every k with each of `folds` left out.

    `folds` is a list or a table with the column `fold`; null leaves out nobody. A fold
    without rows costs 0. Fits, all models in the same jobs.
    """
    spark = series.sparkSession
    sizes = F.explode(F.array(*[F.lit(int(k)) for k in dict.fromkeys(ks)])).alias("k")
    models = fold_table(spark, folds).select("fold", sizes)
    found = cluster_folds(series, models, seed, max_iter, id_col=id_col)
    costs = found.groupBy("fold", "k").agg(F.sum("gap").alias("cost"))
    return models.alias("m").join(
        costs.alias("c"),
        F.col("m.fold").eqNullSafe(F.col("c.fold")) & (F.col("m.k") == F.col("c.k")), "left",
    ).select("m.fold", "m.k", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def _placed(series: DataFrame, id_col: str, col: str) -> tuple[DataFrame, int, int]:
    """(rows by block, number of blocks, longest vector)."""
    rows = cut(
        series.select(
            F.col(id_col).cast("string").alias("id"), F.col(col).cast("array<double>").alias("x")
        ),
        "kmeans-rows",
    )
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = pieces(n * max(1, width))
    key = F.xxhash64("id", "x")
    block = F.pmod(key, F.lit(blocks)).cast("int")
    placed = rows.select(
        "id", own_mark(F.col("id")).alias("fold"), "x", key.alias("key"), block.alias("block")
    )
    return placed, blocks, width


def _matrix(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    return np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _add_moments(block: pd.DataFrame, part: pd.DataFrame, first: bool) -> pd.DataFrame:
    """Per fold the number of rows, mean, squares about it, least and greatest per slot."""
    x, found = _matrix(block["x"]), [tuple(r) for r in part.itertuples(index=False)] if first else []
    for row in part.itertuples():
        kept = x[(block["fold"] != row.fold).to_numpy()] if len(block) else x
        if not len(kept):
            continue
        mean = kept.mean(axis=0)
        stats = np.concatenate([mean, ((kept - mean) ** 2).sum(axis=0), kept.min(axis=0), kept.max(axis=0)])
        found.append((row.part, row.fold, -1, row.k, -1, "moments", float(len(kept)), stats))
    return _frame(found)


def _merge_moments(found: pd.DataFrame) -> pd.DataFrame:
    """A mean and a scale (one over the deviation) per fold that has rows."""
    merged = []
    for (part, fold, k), rows in found[found["role"] == "moments"].groupby(["part", "fold", "k"]):
        n = rows["amount"].to_numpy()
        mean, squares, least, most = np.split(_matrix(rows["x"]), 4, axis=1)
        centre = (n[:, None] * mean).sum(axis=0) / n.sum()
        squares = squares.sum(axis=0) + (n[:, None] * (mean - centre) ** 2).sum(axis=0)
        varies = (least.min(axis=0) < most.max(axis=0)) & (squares > 0)
        scale = np.sqrt(np.divide(n.sum() - 1, squares, out=np.zeros_like(squares), where=varies))
        head = (part, fold, -1, k, -1)
        merged += [(*head, "mean", 0.0, centre), (*head, "scale", 0.0, scale)]
    return _frame(merged)


def _scaled(block: pd.DataFrame, part: pd.DataFrame):
    """(fold, its state, its rows of the block, these rows scaled) of every fold of the part."""
    x = _matrix(block["x"])
    for fold, rows in part.groupby("fold"):
        mean = rows.loc[rows["role"] == "mean", "x"].iloc[0]
        scale = rows.loc[rows["role"] == "scale", "x"].iloc[0]
        kept = (block["fold"] != fold).to_numpy(bool)
        if kept.any():
            yield fold, rows, block[kept], (x[kept] - mean) * scale


def _gaps(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    gaps = np.empty((len(z), len(centres)))
    for i, centre in enumerate(centres):
        gaps[:, i] = ((z - centre) ** 2).sum(axis=1)
    return gaps


def _add_picks(seed: int, at: int, starts: int):
    """Each block proposes the next seed for every fold and start that wants one more."""

    def add(block: pd.DataFrame, part: pd.DataFrame, first: bool) -> pd.DataFrame:
        found = [tuple(r) for r in part.itertuples(index=False)] if first else []
        if block.empty:
            return _frame(found)
        for fold, rows, own, z in _scaled(block, part):
            most, keys = rows["k"].max(), own["key"].to_numpy()
            for start in range(starts if at < most else 0):
                centres = rows[(rows["role"] == "centre") & (rows["start"] == start)]
                if len(centres) < at:
                    continue
                apart = _gaps(z, _matrix(centres["x"])).min(axis=1) if at else np.ones(len(z))
                chance = np.log(uniform(keys, seed, salt_of(fold), start, at))
                score = np.divide(chance, apart, out=np.full(len(z), -np.inf), where=apart > 0)
                best = int(np.argmax(score))
                if score[best] > -np.inf:
                    head = (rows["part"].iloc[0], fold, start, most, at)
                    found.append((*head, "pick", float(score[best]), z[best]))
        return _frame(found)

    return add


def _merge_picks(found: pd.DataFrame) -> pd.DataFrame:
    kept = found[found["role"] != "pick"]
    picks = found[found["role"] == "pick"]
    best = picks.loc[picks.groupby(["fold", "start"])["amount"].idxmax()]
    return pd.concat([kept, best.assign(role="centre", amount=np.inf)]) if len(best) else kept


def _add_moves(tol: float):
    """Each block sums its rows per centre, for models that still move."""

    def add(block: pd.DataFrame, part: pd.DataFrame, first: bool) -> pd.DataFrame:
        found = [tuple(r) for r in part.itertuples(index=False)] if first else []
        if block.empty:
            return _frame(found)
        for fold, rows, _, z in _scaled(block, part):
            for (start, k), model in rows[rows["role"] == "centre"].groupby(["start", "k"]):
                if model["amount"].max() <= tol:
                    continue
                model = model.sort_values("cluster")
                nearest = _gaps(z, _matrix(model["x"])).argmin(axis=1)
                for at, cluster in enumerate(model["cluster"]):
                    mine = z[nearest == at]
                    if len(mine):
                        head = (model["part"].iloc[0], fold, start, k, cluster)
                        found.append((*head, "sum", float(len(mine)), mine.sum(axis=0)))
        return _frame(found)

    return add


def _merge_moves(found: pd.DataFrame) -> pd.DataFrame:
    """The state with centres moved to their rows' means; `amount` is how far."""
    merged = [tuple(r) for r in found[found["role"].isin(["mean", "scale"])][_COLUMNS].itertuples(index=False)]
    key = ["fold", "start", "k", "cluster"]
    sums = {at: rows for at, rows in found[found["role"] == "sum"].groupby(key)}
    touched = {at[:3] for at in sums}
    for row in found[found["role"] == "centre"].itertuples():
        x, moved = np.asarray(row.x, dtype=float), row.amount
        if (row.fold, row.start, row.k) in touched:
            moved, rows = 0.0, sums.get((row.fold, row.start, row.k, row.cluster))
            if rows is not None:
                mean = _matrix(rows["x"]).sum(axis=0) / rows["amount"].sum()
                x, moved = mean, float(np.sqrt(((mean - x) ** 2).sum()))
        merged.append((row.part, row.fold, row.start, row.k, row.cluster, "centre", moved, x))
    return _frame(merged)


def _assigned(rows: DataFrame, blocks: int, state: DataFrame) -> DataFrame:
    """(fold, start, k, id, cluster, gap) of every row and model."""
    placed = state.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = state.agg(F.collect_set("part")).scalar()
    schema = "fold string, start int, k int, id string, cluster int, gap double"

    def one_tile(block: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame(columns=["fold", "start", "k", "id", "cluster", "gap"])]
        for fold, models, own, z in _scaled(block, part) if len(block) and len(part) else ():
            for (start, k), model in models[models["role"] == "centre"].groupby(["start", "k"]):
                model = model.sort_values("cluster")
                gaps = _gaps(z, _matrix(model["x"]))
                nearest = gaps.argmin(axis=1)
                found.append(pd.DataFrame({
                    "fold": fold, "start": start, "k": k, "id": own["id"].to_numpy(object),
                    "cluster": model["cluster"].to_numpy()[nearest],
                    "gap": gaps[np.arange(len(z)), nearest],
                }))
        return pd.concat(found[1:]) if len(found) > 1 else found[0]

    return (
        rows.withColumn("part", F.explode(parts)).groupBy("block", "part")
        .cogroup(placed.groupBy("block", "part")).applyInPandas(one_tile, schema)
    )
