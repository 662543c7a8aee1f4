"""String expressions: keys, names, and cleaning of text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_key(geo_feature: Column, feature_type: Column, buffer_size: Column) -> Column:
    """`layer_class_ring` name of one geographic feature."""
    return F.concat_ws("_", geo_feature, feature_type, buffer_size.cast("string"))


def empty_to_null(text: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(text, F.lit(""))


def zero_to_null(value: Column) -> Column:
    """Null for a numeric zero."""
    return F.when(value != 0, value)


def unquote(text: Column) -> Column:
    """Text without surrounding double quotes."""
    return F.trim(text, F.lit('"'))


def layer_of_table(table: Column) -> Column:
    """Layer name: the table name without its first two `_` parts."""
    parts = F.split(table, "_")
    return F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def feature_table(ring_table: Column, layer: Column) -> Column:
    """Output table name: the ring table without its last two parts, plus the layer."""
    parts = F.split(ring_table, "_")
    stem = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return F.concat(stem, F.lit("_geofeature_"), layer)


def parse_loose_timestamp(text: Column) -> Column:
    """UTC timestamp from the first six digit groups, whatever separates them."""
    part = F.regexp_extract_all(text, F.lit(r"(\d+)"))

    def at(i: int) -> Column:
        return F.get(part, F.lit(i)).cast("int")

    return F.try_make_timestamp(at(0), at(1), at(2), at(3), at(4), at(5), F.lit("UTC"))


def time_of_file(path: Column) -> Column:
    """Timestamp encoded as `yyyy-MM-dd HH:mm:ss[.f]` in a result file name."""
    found = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[ T_](\d{2}:\d{2}:\d{2})", 0)
    return F.try_to_timestamp(F.regexp_replace(found, "[T_]", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
