"""Writers of prediction results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.functions import time_of_file

GRID_COLUMNS = ("gid", "prediction", "lon", "lat")
GRID_HEADER = ("gid", "prediction", "longitude", "latitude")


@dataclass(frozen=True)
class Sink:
    """Where to write: kind 'table', 'jdbc', 'documents', 'csv' or 'grid_text'."""

    kind: str
    target: str
    options: dict = field(default_factory=dict)


def append_table(df: DataFrame, table: str, schema: str | None = None, format: str = "parquet") -> None:
    """Append to a catalog table, made on first use."""
    name = f"{schema}.{table}" if schema else table
    df.write.mode("append").format(format).saveAsTable(name)


def append_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a database table."""
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, **options).save()


def nest_by_time(
    df: DataFrame,
    ts_col: str = "ts",
    gid_col: str = "gid",
    value_col: str = "prediction",
    parts: int = 1,
) -> DataFrame:
    """(timestamp, data: array<struct<gid, aqi>>): one document per timestamp, by gid.

    A document holds the whole grid of its time. For grids too large for one document
    raise `parts`: each time then has that many documents, numbered by `part`.
    """
    item = F.struct(F.col(gid_col).cast("int").alias("gid"), F.col(value_col).alias("aqi"))
    keys = [F.col(ts_col).alias("timestamp")]
    if parts > 1:
        keys.append(F.pmod(F.hash(F.col(gid_col)), F.lit(parts)).alias("part"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("data"))


def write_documents(df: DataFrame, path: str, mode: str = "append", **columns) -> None:
    """Nested documents as JSON lines."""
    nest_by_time(df, **columns).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, ts_col: str = "ts", mode: str = "append") -> None:
    """CSV with header, one folder per timestamp, as many files as there are tasks."""
    df.write.mode(mode).option("header", True).partitionBy(ts_col).csv(path)


def write_grid_text(df: DataFrame, path: str, ts_col: str = "ts", mode: str = "append") -> None:
    """`gid,prediction,longitude,latitude` lines, one folder per timestamp."""
    named = [F.col(c).alias(h) for c, h in zip(GRID_COLUMNS, GRID_HEADER)]
    write_csv(df.select(*named, ts_col), path, ts_col, mode)


def written_times(spark: SparkSession, path: str, ts_col: str = "ts") -> DataFrame:
    """Timestamps already written by `write_csv`, read from the folder names only."""
    schema = f"_line string, {ts_col} timestamp"
    return spark.read.schema(schema).csv(path).select(ts_col).distinct()


def written_file_times(spark: SparkSession, path: str, ts_col: str = "ts") -> DataFrame:
    """Timestamps in the names of the result files under `path`."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("f"))
    name = F.url_decode(F.col("f"))
    return files.select(time_of_file(name).alias(ts_col)).where(F.col(ts_col).isNotNull()).distinct()


def pending_times(times: DataFrame, existing: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Distinct requested times that are not written yet."""
    return times.select(ts_col).distinct().join(existing.select(ts_col), ts_col, "left_anti")


def write_result(df: DataFrame, sinks: Sequence[Sink]) -> None:
    """Write one result to every sink. The result is kept while more than one reads it."""
    kept = df.persist() if len(sinks) > 1 else df
    try:
        for sink in sinks:
            if sink.kind == "table":
                append_table(kept, sink.target, **sink.options)
            elif sink.kind == "jdbc":
                append_jdbc(kept, table=sink.target, **sink.options)
            elif sink.kind == "documents":
                write_documents(kept, sink.target, **sink.options)
            elif sink.kind == "csv":
                write_csv(kept, sink.target, **sink.options)
            elif sink.kind == "grid_text":
                write_grid_text(kept, sink.target, **sink.options)
            else:
                raise ValueError(f"unknown sink kind {sink.kind!r}")
    finally:
        if kept is not df:
            kept.unpersist()
