"""Row numbers without a single-task window.

A global `row_number()` pulls all rows into one task. Here rows are numbered
inside buckets, and only the table of bucket sizes is summed up in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    keys: Sequence[str] = (),
    start: int | Column = 0,
    out: str = "row_index",
) -> DataFrame:
    """Add consecutive numbers from `start`, ordered by (bucket, *order) inside `keys`.

    Choose `bucket` so that one bucket fits one task. If it never decreases along
    `order`, the numbers follow `order` itself. Only bucket sizes, one small row
    per (key, bucket), are accumulated per key.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    running = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = running.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    match = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        tagged.join(offsets, match)
        .withColumn(out, (F.row_number().over(within) - 1 + F.col("_offset") + first).cast("long"))
        .drop("_bucket", "_b", "_offset", *[f"_k_{k}" for k in keys])
    )
