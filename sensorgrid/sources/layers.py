"""Feature layers: their names, their tables, and the request grid of a network."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layers that are plain columns of the location table, and the column to read.
SCALAR_LAYERS = {
    "longitude": "lon", "latitude": "lat", "ocean": "distance", "elevation": "elevation",
}


def layer_tables(
    spark: SparkSession, prefix: str, exclude: str = "buildings", database: str | None = None
) -> list[str]:
    """Names of the catalog tables that start with `prefix`, without those holding `exclude`."""
    tables = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return sorted(
        t.name for t in tables if t.name.startswith(prefix) and exclude not in t.name
    )


def layer_name(table: str) -> str:
    """Layer of a map table: its name without the first two `_` parts."""
    return "_".join(table.split("_")[2:])


def feature_table_name(ring_table: str, layer: str) -> str:
    """Feature table of a layer, named after the ring table without its last two parts."""
    return "_".join(ring_table.split("_")[:-2]) + "_geofeature_" + layer


def layer_catalog(
    network: str, layers: Sequence[str], location_table: str | None = None
) -> dict[str, str]:
    """Table of every layer by rule: `<network>_geofeature_<layer>`.

    The plain-number layers read `location_table`, by default `<network>_elevation`.
    """
    plain = location_table or f"{network}_elevation"
    return {
        layer: plain if layer in SCALAR_LAYERS else f"{network}_geofeature_{layer}"
        for layer in layers
    }


def open_layers(spark: SparkSession, catalog: Mapping[str, str]) -> dict[str, DataFrame]:
    """Layer tables as long feature rows, ready for `union_layers`."""
    from sensorgrid.operators.features import scalar_layers

    opened = {}
    for layer, table in catalog.items():
        df = spark.table(table)
        column = SCALAR_LAYERS.get(layer)
        opened[layer] = df if column is None else scalar_layers(df, {layer: column})
    return opened


def request_grid(
    stations: DataFrame, start: str, end: str, step: str = "1 hour", out: str = "ts"
) -> DataFrame:
    """Every station at every step from `start` up to, but without, `end`."""
    first, stop = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    stride = F.expr(f"interval {step}")
    steps = F.when(first < stop, F.sequence(first, stop, stride)).otherwise(
        F.array().cast("array<timestamp>")
    )
    return stations.withColumn(out, F.explode(steps)).where(F.col(out) < stop)
