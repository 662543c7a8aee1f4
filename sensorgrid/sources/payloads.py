"""Parsing of the text and JSON payloads of station, weather and sensor services.

Payloads are a string column; files are read with `spark.read.text(..., wholetext=True)`
or as one payload per line. Schemas are fixed, so nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.functions import (
    empty_to_null,
    parse_loose_timestamp,
    unquote,
    wkt_lat,
    wkt_lon,
    wkt_point,
    zero_to_null,
)
from sensorgrid.operators.channels import has_point

# Columns of the delimited station feed, in order.
STATION_FEED = (
    "lat", "lon", "ts", "parameter", "concentration", "unit", "aqi", "category",
)
STATION_TIME = "yyyy-MM-dd'T'HH:mm"

# Fields of the current-weather object and their column names.
WEATHER_TEXT = {"summary": "summary", "icon": "icon"}
WEATHER_NUMBERS = {
    "precipIntensity": "precip_intensity",
    "precipProbability": "precip_probability",
    "temperature": "temperature",
    "apparentTemperature": "apparent_temperature",
    "dewPoint": "dew_point",
    "humidity": "humidity",
    "pressure": "pressure",
    "windSpeed": "wind_speed",
    "windBearing": "wind_bearing",
    "cloudCover": "cloud_cover",
    "uvIndex": "uv_index",
    "visibility": "visibility",
    "ozone": "ozone",
}

# Fields of a sensor directory entry and their column names.
DIRECTORY_FIELDS = {
    "ID": "id",
    "Lat": "lat",
    "Lon": "lon",
    "THINGSPEAK_PRIMARY_ID": "sensor_id",
    "THINGSPEAK_PRIMARY_ID_READ_KEY": "sensor_key",
    "ParentID": "parent_id",
}

# Numbered fields of a sensor feed entry, in order from field1.
FEED_FIELDS = (
    "pm1_atm", "pm2_5_atm", "pm10_atm", "uptime", "rssi", "temperature", "humidity", "pm2_5_cf_1",
)


def parse_station_csv(df: DataFrame, col: str = "line") -> DataFrame:
    """One observation per non-empty line of the station feed; other columns are kept.

    A line is eight quoted fields: latitude, longitude, UTC minute, parameter,
    concentration, unit, index, category. An empty field, or one that is no number where a
    number belongs, is null.
    """
    schema = ", ".join(f"{name} string" for name in STATION_FEED)
    others = [c for c in df.columns if c != col]
    fields = (
        df.where(F.length(F.trim(F.col(col))) > 0)
        .withColumn("_row", F.from_csv(F.col(col), schema, {"quote": '"', "mode": "PERMISSIVE"}))
        .select(*others, "_row.*")
    )

    def text(name: str):
        return empty_to_null(unquote(F.col(name)))

    return fields.select(
        *others,
        F.try_to_timestamp(text("ts"), F.lit(STATION_TIME)).alias("ts"),
        text("lon").try_cast("double").alias("lon"),
        text("lat").try_cast("double").alias("lat"),
        text("parameter").alias("parameter"),
        text("concentration").try_cast("double").alias("concentration"),
        text("unit").alias("unit"),
        text("aqi").try_cast("double").alias("aqi"),
        text("category").try_cast("int").alias("category"),
    )


def flatten_weather(df: DataFrame, col: str = "payload", zero_as_null: bool = False) -> DataFrame:
    """Time zone and the current-weather fields of weather payloads; other columns are kept.

    Missing and empty fields are null. `zero_as_null` also drops measured zeros.
    """
    parts = [f"{f}: string" for f in WEATHER_TEXT] + [f"{f}: double" for f in WEATHER_NUMBERS]
    schema = f"timezone string, currently struct<{', '.join(parts)}>"
    others = [c for c in df.columns if c != col]
    parsed = df.withColumn("_w", F.from_json(F.col(col), schema))
    now = F.col("_w.currently")
    texts = [empty_to_null(now.getField(f)).alias(n) for f, n in WEATHER_TEXT.items()]
    numbers = [
        (zero_to_null(now.getField(f)) if zero_as_null else now.getField(f)).alias(n)
        for f, n in WEATHER_NUMBERS.items()
    ]
    return parsed.select(
        *others, empty_to_null(F.col("_w.timezone")).alias("timezone"), *texts, *numbers
    )


def explode_directory(df: DataFrame, col: str = "payload") -> DataFrame:
    """One row per located sensor of directory payloads, with its point as text."""
    kinds = {"Lat": "double", "Lon": "double"}
    entry = ", ".join(f"{f}: {kinds.get(f, 'string')}" for f in DIRECTORY_FIELDS)
    parsed = df.select(
        F.explode(F.from_json(F.col(col), f"results array<struct<{entry}>>")["results"]).alias("s")
    )
    named = parsed.select(
        *[empty_to_null(F.col(f"s.{f}")).alias(n) if f not in kinds else F.col(f"s.{f}").alias(n)
          for f, n in DIRECTORY_FIELDS.items()]
    )
    return has_point(named).withColumn("location", wkt_point(F.col("lon"), F.col("lat")))


def explode_feed(df: DataFrame, col: str = "payload") -> DataFrame:
    """One row per entry of sensor feed payloads: id, ts, entry_id and the named readings.

    A reading is a number in text; an empty one is null, a zero stays.
    """
    numbered = [f"field{i + 1}" for i in range(len(FEED_FIELDS))]
    entry = ", ".join(["created_at: string", "entry_id: long", *[f"{f}: string" for f in numbered]])
    schema = f"channel struct<id: long>, feeds array<struct<{entry}>>"
    parsed = df.select(F.from_json(F.col(col), schema).alias("p")).select(
        F.col("p.channel.id").alias("id"), F.inline("p.feeds")
    )
    return parsed.select(
        "id",
        parse_loose_timestamp(F.col("created_at")).alias("ts"),
        "entry_id",
        *[empty_to_null(F.trim(F.col(f))).try_cast("double").alias(n)
          for f, n in zip(numbered, FEED_FIELDS)],
    )


def parse_wkt_point(df: DataFrame, col: str = "location") -> DataFrame:
    """Add lon and lat of a WKT point column."""
    return df.withColumn("lon", wkt_lon(F.col(col))).withColumn("lat", wkt_lat(F.col(col)))
