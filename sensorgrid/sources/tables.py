"""Table scans with projection, condition and the latest slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(
    spark: SparkSession,
    source: str,
    cols: Sequence[str] = ("*",),
    where: str | None = None,
    format: str | None = None,
    **options: str,
) -> DataFrame:
    """Scan of a catalog table or, with `format`, of a path.

    `cols` may hold SQL expressions with aliases, also aggregates; `where` is a
    condition with or without the leading keyword. Both reach the scan.
    """
    df = spark.read.format(format).options(**options).load(source) if format else spark.table(source)
    if where and where.strip():
        condition = where.strip()
        if condition.lower().startswith("where "):
            condition = condition[6:]
        df = df.where(condition)
    return df.selectExpr(*cols)


def read_query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Result of a query; keyword arguments name DataFrames it may use, as `{name}`."""
    return spark.sql(sql, **views) if views else spark.sql(sql)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table_or_query: str,
    cols: Sequence[str] = ("*",),
    where: str = "",
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Scan of a database table or `select` with projection and condition run by the database.

    With `partition_column` and `bounds` the scan is split over that many tasks.
    """
    head = table_or_query.strip()
    inner = f"({head}) as src" if head.lower().startswith("select") else head
    reader = spark.read.format("jdbc").options(**options).option("url", url).option(
        "dbtable", f"(select {', '.join(cols)} from {inner} {where}) as sub"
    )
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]), numPartitions=str(partitions),
        )
    return reader.load()


def latest(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Rows of the newest timestamp; the lookup is a subquery whose result is pushed to the scan."""
    return df.where(F.col(ts_col) == df.agg(F.max(ts_col)).scalar())


def latest_time(df: DataFrame, ts_col: str = "ts", out: str = "max_ts") -> DataFrame:
    """One row with the newest timestamp."""
    return df.agg(F.max(ts_col).alias(out))


def time_range(df: DataFrame, start, end, ts_col: str = "ts") -> DataFrame:
    """Rows from `start` to `end`, both included."""
    return df.where(F.col(ts_col).between(start, end))


def at_time(df: DataFrame, ts, ts_col: str = "ts") -> DataFrame:
    """Rows of one timestamp."""
    return df.where(F.col(ts_col) == F.lit(ts))
