"""Whitening of vectors with distributed block matrices.

Vectors are cut to whole numbers, x = floor(256 * c). The fit list, each distinct x once, is
centred, indexed and laid out as a BlockMatrix of row blocks; its transpose times itself is the
scatter, of which one small matrix reaches the driver for `eigh`. The whitening matrix is a
BlockMatrix of one block, and multiplying by it projects the rows, block by block.

The middle dimension of the scatter is split, so that blocks are multiplied where they lie and
one small partial sum per split moves on. Copies of a vector meet as partial distinct lists,
and rows are laid out by number, so a vector that fills a third of the table is no hot key.
The driver holds the (row, column) places of the blocks, 1,024 rows each, and matrices of
width * width.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import cut, numbered, part_of, place_of

COMPONENTS = 4
SCALE = 256
_BLOCK_ROWS = 1024
#: Row blocks whose products are summed before they move.
_BLOCKS_PER_SPLIT = 8
#: Eigenvalues below this share of their sum are rounding, not variance.
_NO_VARIANCE = 1e-12
_EXACT = "decimal(38,0)"


def whole_numbers(vector: Column) -> Column:
    """x = floor(256 * c) per entry; null if the vector is null or an entry is null or not finite."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(
        vector.isNotNull() & usable,
        F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))),
    )


def indexed(frame: DataFrame, name: str = "index") -> DataFrame:
    """`frame` with gapless numbers from 0; written once, then numbered by its write tasks."""
    rows = cut(numbered(frame, "_row"), "whitening-rows").withColumn("_part", part_of("_row"))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("size")).sort("_part").collect()
    starts, first = [], 0  # one number per write task
    for part, size in sizes:
        starts.append((part, first))
        first += size
    offsets = F.broadcast(
        frame.sparkSession.createDataFrame(starts, "_part long, _first long")
    )
    return rows.join(offsets, "_part").withColumn(name, F.col("_first") + place_of("_row")).drop(
        "_part", "_row", "_first"
    )


def _centred(x: Column, mean: np.ndarray) -> Column:
    """Entries minus the mean, as a vector; entries that a short vector lacks count as 0."""
    means = F.lit([float(m) for m in mean])
    return array_to_vector(F.zip_with(
        F.slice(x, F.lit(1), F.lit(len(mean))), means,
        lambda a, m: F.coalesce(a, F.lit(0)).cast("double") - m,
    ))


def to_blocks(rows: DataFrame, width: int) -> BlockMatrix:
    """Rows (index, vector of `width`) as blocks of 1,024 rows."""
    plain = MLUtils.convertVectorColumnsFromML(rows.select("index", "vector"), "vector")
    return IndexedRowMatrix(plain, 0, width).toBlockMatrix(_BLOCK_ROWS, width)


def _multiply(left: BlockMatrix, right: BlockMatrix, splits: int, rows: int) -> BlockMatrix:
    """Product of block matrices with the middle dimension in `splits` parts."""
    product = left._java_matrix_wrapper.call(
        "multiply", right._java_matrix_wrapper._java_model, splits
    )
    return BlockMatrix(product, rows, right.colsPerBlock)


def scatter(blocks: BlockMatrix, n: int, width: int) -> np.ndarray:
    """Transpose times itself, as a local matrix of width * width."""
    splits = max(1, -(-n // (_BLOCK_ROWS * _BLOCKS_PER_SPLIT)))
    return _multiply(blocks.transpose(), blocks, splits, width).toLocalMatrix().toArray()


def project(spark, blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """Rows (index, z): the rows of `blocks` times a small local matrix."""
    width, parts = matrix.shape
    block = spark.createDataFrame(
        [(((0, 0)), Matrices.dense(width, parts, matrix.T.ravel().tolist()))],
        ["at", "block"],
    ).rdd.map(lambda row: ((row[0][0], row[0][1]), row[1]))
    right = BlockMatrix(block, width, parts, width, parts)
    product = blocks.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    return rows.select("index", vector_to_array("vector").alias("z"))


def components_of(covariance: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, and unit eigenvectors in columns; no more than `limit`.

    The entry of largest size is positive in each. Without variance there is none.
    """
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:limit]
    order = order[values[order] > _NO_VARIANCE * max(np.trace(covariance), 0.0)]
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(order))])


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    vector: str = "embedding",
    id_col: str = "vec_id",
) -> DataFrame:
    """One row per usable vector and component: the id, component, n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out. Shorter
    vectors count as 0 in the dimensions they lack. n is the number of distinct x; deviation
    the exact sum of (n * x - S) ** 2, null where a long cannot hold it. Components without
    variance have no rows, nor has a table of fewer than two distinct vectors; explained is a
    component's share of the variance, identity_error the largest difference of the fit list's
    whitened covariance from the identity. Equal eigenvalues: their order is that of `eigh`.
    Repeated rows and null ids each keep their rows; other columns play no part.
    """
    spark = vectors.sparkSession
    usable = vectors.select(
        F.col(id_col).alias("id"), whole_numbers(F.col(vector)).alias("x")
    ).where(F.col("x").isNotNull())
    rows = indexed(usable)
    fit = indexed(rows.select("x").distinct())
    width, n = fit.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    empty = spark.createDataFrame([], vectors.select(F.col(id_col)).schema).select(
        id_col, *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"),
            ("explained", "double"), ("identity_error", "double"),
        )]
    )
    if not width:
        return empty
    sums = _sums(fit, width)
    mean = np.array([int(s) / n for s in sums])
    centred = fit.select("index", _centred(F.col("x"), mean).alias("vector"))
    blocks = to_blocks(centred, width).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(blocks, n, width) / n
    values, axes = components_of((covariance + covariance.T) / 2, components)
    if not len(values):
        return empty
    matrix = axes / np.sqrt(values)
    error = _identity_error(project(spark, blocks, matrix), n, len(values))
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    explained = values / np.trace(covariance)
    every = rows.select("index", _centred(F.col("x"), mean).alias("vector"))
    projected = project(spark, to_blocks(every, width), matrix)
    return (
        rows.select("id", "index", _deviation(F.col("x"), n, sums).alias("deviation"))
        .join(projected, "index")
        .select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
        .select(
            F.col("id").alias(id_col), (F.col("at") + 1).alias("component"),
            F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            F.get(F.lit([float(e) for e in explained]), F.col("at")).alias("explained"),
            F.lit(float(error)).alias("identity_error"),
        )
    )


def _sums(fit: DataFrame, width: int) -> list[int]:
    """Exact sum of each dimension over the fit list."""
    found = fit.agg(*[
        F.sum(F.get("x", F.lit(d)).cast(_EXACT)).alias(f"s{d}") for d in range(width)
    ]).first()
    return [int(s) for s in found]


def _deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over the dimensions of (n * x - S) ** 2, exact; null beyond a long."""
    def far(a: Column, s: Column) -> Column:
        step = (F.coalesce(a, F.lit(0)).cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")) - s
        step = step.try_cast("decimal(19,0)")
        return (step * step).cast(_EXACT)

    exact = F.array(*[F.lit(str(s)).cast(_EXACT) for s in sums])
    squares = F.zip_with(x, exact, far)
    total = F.aggregate(squares, F.lit(0).cast(_EXACT), lambda a, b: F.try_add(a, b).cast(_EXACT))
    return total.try_cast("long")


def _identity_error(projected: DataFrame, n: int, parts: int) -> float:
    """Largest entry of the covariance of z minus the identity; centred before multiplying."""
    means = projected.agg(*[F.sum(F.get("z", F.lit(c))) / n for c in range(parts)]).first()
    entry = [F.get("z", F.lit(c)) - F.lit(means[c]) for c in range(parts)]
    pairs = [(a, b) for a in range(parts) for b in range(a, parts)]
    found = projected.agg(*[F.sum(entry[a] * entry[b]) / n for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))
