"""Rolling statistics per station and gap filling.

Stations differ a lot in size, and one of them may hold a large share of all
rows. A window per station would put that station into one task, so every
operator here cuts a station's timeline into chunks and copies into each chunk
the few neighbouring rows that its frames reach ("halo"). The result is the
same as with one window per station.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sensorgrid.functions import unix_seconds
from sensorgrid.operators import frames
from sensorgrid.operators.numbering import number_rows

_CHUNK_WINDOWS = 8
_ROWS_PER_CHUNK = 500_000
_ROWS_PER_BLOCK = 65536


def row_frame(keys: Sequence[str], order: Sequence[str], k: int) -> Window:
    """Centred frame of `k` rows; an even `k` counts as the next smaller odd number."""
    reach = (k - 1) // 2
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)


def rolling(
    df: DataFrame,
    id_col: str = "station_id",
    ts_col: str = "ts",
    value_col: str = "value",
    hours: float = 3,
    centered: bool = False,
    extra_keys: Sequence[str] = (),
    sum_copies: bool = False,
) -> DataFrame:
    """Add `unix_time`, rolling `mean` and rolling exact `median` (nulls skipped).

    `sum_copies` is for feeds in which a few readings are repeated a great many times.
    Equal readings are counted first, the frames run over the counts, and the results
    are joined back. Without such copies it only adds shuffles.
    """
    timed = df.withColumn("unix_time", unix_seconds(F.col(ts_col)))
    keys = [id_col, *extra_keys]
    if not sum_copies:
        rolled = _in_chunks(timed.withColumn("_c", F.lit(1)), keys, value_col, hours, centered)
        return rolled.drop("_c")
    moments = [*keys, "unix_time"]
    counted = timed.groupBy(*moments, value_col).agg(F.count(F.lit(1)).alias("_c"))
    rolled = _in_chunks(counted, keys, value_col, hours, centered)
    per_moment = rolled.groupBy(*[F.col(m).alias(f"_m_{m}") for m in moments]).agg(
        F.first("mean").alias("mean"), F.first("median").alias("median")
    )
    same = reduce(and_, [F.col(m).eqNullSafe(F.col(f"_m_{m}")) for m in moments])
    return timed.join(per_moment, same).drop(*[f"_m_{m}" for m in moments])


def _in_chunks(
    df: DataFrame, keys: list[str], value_col: str, hours: float, centered: bool
) -> DataFrame:
    """Rolling mean and median of rows that stand for `_c` readings each.

    A chunk with more than `_ROWS_PER_CHUNK` rows is cut into parts by time.
    """
    size = int(hours * 3600)
    ahead = size if centered else 0
    chunk = max(_CHUNK_WINDOWS * size, 1)
    placed = df.withColumn("_own", _floor_div(F.col("unix_time"), chunk))
    crowded = placed.groupBy(*keys, "_own").agg(
        F.ceil(F.count(F.lit(1)) / _ROWS_PER_CHUNK).cast("int").alias("_parts")
    ).where("_parts > 1 and _own is not null")
    crowded = crowded.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_own").alias("_k"), "_parts"
    )
    spread = placed.withColumn(
        "_chunk",
        F.explode_outer(
            F.sequence(
                _floor_div(F.col("unix_time") - ahead, chunk),
                _floor_div(F.col("unix_time") + size, chunk),
            )
        ),
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    spread = spread.join(crowded, same & (F.col("_chunk") == F.col("_k")), "left").drop(
        "_k", *[f"_k_{k}" for k in keys]
    )
    parts = F.coalesce("_parts", F.lit(1))
    step = F.ceil(F.lit(chunk) / parts)

    def part(time: Column) -> Column:
        inside = time - F.col("_chunk") * chunk
        return F.least(F.greatest(_floor_div(inside, step), F.lit(0)), parts - 1)

    cut = spread.withColumn("_at", part(F.col("unix_time"))).withColumn(
        "_part",
        F.explode_outer(F.sequence(
            part(F.col("unix_time") - ahead), part(F.col("unix_time") + size)
        )),
    )
    is_own = F.col("_chunk").eqNullSafe(F.col("_own")) & F.col("_part").eqNullSafe(F.col("_at"))
    piece = [*keys, "_chunk", "_part"]
    # nulls leave a hash as it is, so they count by themselves
    number = F.xxhash64(*[c for k in piece for c in (F.col(k), F.col(k).isNull())])
    rows = (
        cut.withColumn("_is_own", is_own).withColumn("_value", F.col(value_col).cast("double"))
        .withColumn("_piece", number)
        .repartition(*piece).sortWithinPartitions(*piece, "unix_time")
        .select(*df.columns, "_is_own", "_value", "_piece")
    )
    schema = StructType([
        *df.schema, StructField("mean", DoubleType()), StructField("median", DoubleType()),
    ])
    return rows.mapInArrow(frames.chunk_statistics(size, ahead), schema)


def row_window(
    df: DataFrame,
    id_col: str = "station_id",
    ts_col: str = "ts",
    value_col: str = "value",
    k: int = 3,
    extra_order: Sequence[str] = (),
    chunk_hours: float = 1,
    rows_per_block: int = _ROWS_PER_BLOCK,
) -> DataFrame:
    """Add `mean` over the centred `k`-row frame of each station.

    Rows get a position per station first; frames then run inside blocks of
    positions that overlap by the reach of the frame.
    """
    reach = (k - 1) // 2
    block = max(rows_per_block, reach, 1)
    numbered = number_rows(
        df,
        order=[ts_col, *extra_order],
        bucket=_floor_div(unix_seconds(F.col(ts_col)), int(chunk_hours * 3600)),
        keys=[id_col],
        out="_pos",
    )
    spread = numbered.withColumn("_own", _floor_div(F.col("_pos"), block)).withColumn(
        "_block",
        F.explode(
            F.sequence(
                _floor_div(F.greatest(F.col("_pos") - reach, F.lit(0)), block),
                _floor_div(F.col("_pos") + reach, block),
            )
        ),
    )
    frame = row_frame([id_col, "_block"], ["_pos"], k)
    return (
        spread.withColumn("mean", F.avg(value_col).over(frame))
        .where(F.col("_block") == F.col("_own"))
        .drop("_block", "_own", "_pos")
    )


def fill_gaps(
    df: DataFrame,
    id_col: str = "station_id",
    ts_col: str = "ts",
    value_col: str = "value",
    hours: float = 3,
    method: str = "median",
    centered: bool = False,
    extra_keys: Sequence[str] = (),
    sum_copies: bool = False,
) -> DataFrame:
    """Add `label`: the reading, or the rolling `method` ('mean' / 'median') where it is null."""
    if method not in ("mean", "median"):
        raise ValueError("method must be 'mean' or 'median'")
    rolled = rolling(df, id_col, ts_col, value_col, hours, centered, extra_keys, sum_copies)
    return rolled.withColumn("label", F.coalesce(F.col(value_col), F.col(method)))


def _floor_div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("long")
