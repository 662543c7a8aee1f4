"""Spreading of few rows that each stand for much work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by `cols` over the session's number of shuffle partitions.

    A short input file is one split, and adaptive execution merges small shuffle
    partitions; both go by bytes. Where a row leads to a model fit or to thousands of
    pairs, bytes say little, and a fixed number of partitions keeps all cores busy.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
