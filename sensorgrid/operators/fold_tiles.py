"""Tiles of (row block, folds): how the models of many folds share their passes.

A fold is a model input without one of the rows; fold null leaves nobody out. Rows lie in
blocks of bounded size, folds in parts of bounded size, and a pass brings each block
together with each part once. What a block adds to a part is summed per part, so a pass
is two shuffles and one job, however many folds there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.operators.spread import spread
from sensorgrid.session import shared_dir

#: numbers in the rows of a block, and in the models of a part
TILE_CELLS = 1 << 21
#: folds in a part
FOLDS_PER_PART = 8


def fold_table(spark: SparkSession, folds: DataFrame | Sequence[str | None]) -> DataFrame:
    """(fold) of a table with that column or a list of names."""
    if isinstance(folds, DataFrame):
        return folds.select(F.col("fold").cast("string").alias("fold")).distinct()
    return spark.createDataFrame([(f,) for f in dict.fromkeys(folds)], "fold string")


def mark(fold: Column) -> Column:
    """A text for every fold, null included, that no other fold has."""
    return F.coalesce(F.concat(F.lit("="), fold.cast("string")), F.lit("-"))


def own_mark(row_id: Column) -> Column:
    """The text of the fold that leaves this row out; empty without an id."""
    return F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit(""))


def unmark(marked: Column) -> Column:
    """The fold of its text."""
    return F.when(marked != "-", F.substr(marked, F.lit(2)))


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read back."""
    spark, folder = df.sparkSession, shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def pieces(cells: float) -> int:
    """Number of blocks or parts for so many numbers."""
    return max(1, -(-int(cells) // TILE_CELLS))


def tile_pass(
    rows: DataFrame, blocks: int, state: DataFrame,
    add: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
) -> DataFrame:
    """The state after one pass over all rows.

    `rows` have a `block` from 0 to `blocks` - 1 and, where they differ by part, a `part`;
    `state` has a `part`. `add` gets a block, a part and whether the block is the first,
    which hands the state on; `merge` makes the next state of a part. Both return the
    columns of `state`.
    """
    schema = state.schema
    placed = state.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if "part" not in rows.columns:
        parts = state.agg(F.collect_set("part")).scalar()
        rows = rows.withColumn("part", F.explode(parts))

    def one_tile(key: tuple, block: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame(columns=schema.names)
        found = add(block, part[schema.names], key[0] == 0)
        return found[schema.names]

    def one_part(found: pd.DataFrame) -> pd.DataFrame:
        return merge(found)[schema.names]

    added = (
        spread(rows, "block", "part").groupBy("block", "part")
        .cogroup(spread(placed, "block", "part").groupBy("block", "part"))
        .applyInPandas(one_tile, schema)
    )
    return spread(added, "part").groupBy("part").applyInPandas(one_part, schema)


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers between 0 and 1 that depend on keys and salt alone, not on the layout."""
    z = keys.astype(np.int64).view(np.uint64).copy()
    for value in salt:
        z ^= np.uint64(int(value) & (2**64 - 1))
        z *= np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def salt_of(name: str) -> int:
    """A number for a fold."""
    return zlib.crc32(name.encode())
