"""Checks of inputs off the beaten track, of map shapes as text, and of sinks and layers.

Sinks write to the shared folder and are read back; layers go through the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.adapters import Inputs
from checks.registry import check
from checks.relational import _AQI_SQL, _exploded, _LABELS, _valued, rounded, station_lines
from checks.spatial import (
    _AREA_SQL, _COUNT_SQL, _LENGTH_SQL, CORNERS, _boxes, _grid, _lines, _pois,
)
from sensorgrid import shared_dir
from sensorgrid.functions import (
    register_sql_functions,
    time_of_file,
    wkt_paths,
    wkt_point,
    wkt_rings,
)
from sensorgrid.operators import ingest, panel, rollup, spatial, windows
from sensorgrid.sinks import Sink, write_csv, write_grid_text, write_result, written_times
from sensorgrid.sources import layer_catalog, layer_tables, open_layers, parse_station_csv

# ---------------------------------------------------------------- missing values


@check(
    "median_null_key_split",
    "select nullif(event_type, 'click') as event_type, round(median(case when event_type <> "
    "'error' then value end), 6) as median from events group by 1",
)
def _(d: Inputs) -> DataFrame:
    rows = _valued(d).withColumn("event_type", F.nullif("event_type", F.lit("click")))
    return rounded(rollup.median_by_split(rows, ["event_type"]), "median")


@check(
    "median_tiny_values_split",
    "select event_type, round(median(value * 1e-300) * 1e300, 6) as median from events group by 1",
)
def _(d: Inputs) -> DataFrame:
    rows = d.events.withColumn("value", F.col("value") * F.lit(1e-300))
    found = rollup.median_by_split(rows, ["event_type"])
    return rounded(found.withColumn("median", F.col("median") * F.lit(1e300)), "median")


_UNPLACED = "select poi_id, case when p_size % 10 = 0 then null else lon end as lon, lat from a_poi"
_KNOWN = (
    "known as (select min(poi_id) as station_id, lon, lat from a_poi where p_size <= 25 "
    "and p_size % 10 <> 0 group by 2, 3)"
)
_UPSERT = (
    f"with batch as ({_UNPLACED}), {_KNOWN}, fresh as (select distinct lon, lat from batch p where "
    "lon is not null and not exists (select 1 from known k where k.lon = p.lon and k.lat = p.lat)), "
    "all_st as (select * from known union all select (select max(station_id) from known) + "
    "row_number() over (order by lon, lat), lon, lat from fresh) "
)


@check(
    "station_upsert_unplaced",
    _UPSERT + "select poi_id, station_id from batch p left join all_st s "
    "on s.lon = p.lon and s.lat = p.lat",
)
def _(d: Inputs) -> DataFrame:
    known = d.sql(f"with {_KNOWN} select * from known")
    return ingest.upsert_stations(d.sql(_UNPLACED), known)[0].select("poi_id", "station_id")


@check(
    "series_unnamed_station",
    f"with {_LABELS.format(obs='a_obs_day')} select station_id, row_number() over "
    "(partition by station_id order by ts) - 1 as pos, round(label, 6) as value from lab "
    "where ts in (select ts from lab group by ts having count(*) = "
    "(select count(distinct station_id) from lab))",
)
def _(d: Inputs) -> DataFrame:
    unnamed = d.a_obs_day.select(F.lit(None).cast("string").alias("station_id"), "ts", "value")
    return _exploded(panel.series(windows.fill_gaps(d.a_obs_day.unionByName(unnamed))))


@check(
    "station_csv_bad_numbers",
    "select e.event_id, case when e.user_id % 3 > 0 then e.value end as concentration, "
    "e.user_id * 1.0e0 as aqi from events e",
)
def _(d: Inputs) -> DataFrame:
    # every third sensor reports text where the concentration belongs
    broken = F.regexp_replace("line", r'^("[^"]*","[^"]*","[^"]*","[^"]*",)"[^"]*"', '$1"N/A"')
    third = F.regexp_extract("line", r'"UG/M3","(\d+)"', 1).try_cast("int") % 3 == 0
    lines = station_lines(d).withColumn("line", F.when(third, broken).otherwise(F.col("line")))
    return parse_station_csv(lines).select("event_id", "concentration", "aqi")


# ---------------------------------------------------------------- rings and shapes


@check(
    "ring_point_count_uneven",
    _COUNT_SQL.format(box="").replace("generate_series(100, 3000, 100)", "generate_series(100, 300, 100)"),
)
def _(d: Inputs) -> DataFrame:
    return spatial.count_in_rings(_grid(d), _pois(d), step=100, max_radius=250)


def _lines_text(d: Inputs) -> DataFrame:
    """Every line as a path of two pieces, written as text."""
    def at(x, y):
        return F.concat(x.cast("string"), F.lit(" "), y.cast("string"))

    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    corners = F.concat_ws(", ", at(x0, y0), at(x1, y1), at(x1 + F.lit(0.003), y1))
    return d.a_line.select(
        "line_id", "fclass", F.concat(F.lit("MULTILINESTRING (("), corners, F.lit("))")).alias("shape")
    )


def _paths(d: Inputs) -> DataFrame:
    return _lines_text(d).select("line_id", "fclass", F.explode(wkt_paths(F.col("shape"))).alias("path"))


_PIECES = (
    "select line_id, fclass, x0, y0, x1, y1, x0 as u0, y0 as v0, x1 as u1, y1 as v1 from a_line "
    "union all select line_id, fclass, x1, y1, x1 + 0.003e0, y1, x0, y0, x1, y1 from a_line"
)


@check("wkt_lines", f"select line_id, x0, y0, x1, y1 from ({_PIECES}) p")
def _(d: Inputs) -> DataFrame:
    return spatial.segments(_paths(d)).select("line_id", "x0", "y0", "x1", "y1")


_TOUCHES = (
    "select * from ({pieces}) p where least(u0, u1) <= -118.2e0 and greatest(u0, u1 + 0.003e0) >= "
    "-118.6e0 and least(v0, v1) <= 34.2e0 and greatest(v0, v1) >= 33.8e0"
)


@check(
    "geo_features_paths",
    "select cast(id as varchar) as id, 'roads' as geo_feature, feature_type, buffer_size, value, "
    "measurement from (" + _LENGTH_SQL.replace(
        "a_line s where", f"({_TOUCHES.format(pieces=_PIECES)}) s where"
    ) + ") q",
)
def _(d: Inputs) -> DataFrame:
    built = spatial.geo_features(_grid(d), {"roads": ("paths", _paths(d))}, CORNERS)
    return rounded(built, "value", places=3)


@check(
    "wkt_polygons",
    "with b as (select b.*, p.lon, p.lat from a_box b join a_poi p using (poi_id)) "
    "select poi_id, false as hole, x0 as x, y0 as y from b union all select poi_id, false, x1, y0 "
    "from b union all select poi_id, false, x1, y1 from b union all select poi_id, false, x0, y1 "
    "from b union all select poi_id, true, x0, y0 from b union all select poi_id, true, lon, y0 "
    "from b union all select poi_id, true, lon, lat from b",
)
def _(d: Inputs) -> DataFrame:
    box = d.a_box.join(d.a_poi.select("poi_id", "lon", "lat"), "poi_id")

    def ring(*corners):
        pairs = [F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"))
                 for x, y in corners]
        return F.concat(F.lit("("), F.concat_ws(",", *pairs), F.lit(")"))

    outline = ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    hole = ring(("x0", "y0"), ("lon", "y0"), ("lon", "lat"), ("x0", "y0"))
    text = F.concat(F.lit("MULTIPOLYGON(("), outline, F.lit(", "), hole, F.lit("))"))
    rings = box.select("poi_id", F.explode(wkt_rings(text)).alias("ring"))
    return rings.select("poi_id", "ring.hole", F.explode("ring.points").alias("p")).select(
        "poi_id", "hole", "p.x", "p.y"
    )


@check(
    "geo_features_all_kinds",
    "select 'pois' as geo_feature, 'count' as measurement, count(distinct feature_type) as classes "
    f"from ({_COUNT_SQL.format(box='')}) p union all select 'roads', 'length', "
    f"count(distinct feature_type) from ({_LENGTH_SQL}) l union all select 'land', 'area', "
    f"count(distinct feature_type) from ({_AREA_SQL}) a",
)
def _(d: Inputs) -> DataFrame:
    layers = {
        "pois": ("points", _pois(d)), "roads": ("lines", _lines(d)), "land": ("polygons", _boxes(d)),
    }
    built = spatial.geo_features(_grid(d), layers)
    return built.groupBy("geo_feature", "measurement").agg(
        F.countDistinct("feature_type").alias("classes")
    )


def _wkt_layers(d: Inputs) -> dict[str, DataFrame]:
    """Layers as WKT text: points, lines, boxes, and one that holds points and lines."""
    def pair(x: str, y: str):
        return F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))

    def ring(*corners):
        return F.concat(F.lit("(("), F.concat_ws(", ", *[pair(*c) for c in corners]), F.lit("))"))

    pois = d.a_poi.select("fclass", wkt_point(F.col("lon"), F.col("lat")).alias("geometry"))
    line = F.concat(F.lit("LINESTRING("), pair("x0", "y0"), F.lit(", "), pair("x1", "y1"), F.lit(")"))
    roads = d.a_line.select("fclass", line.alias("geometry"))
    box = ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    land = d.a_box.select("fclass", F.concat(F.lit("POLYGON"), box).alias("geometry"))
    return {"pois": pois, "roads": roads, "land": land, "mixed": pois.unionByName(roads)}


@check(
    "layer_kinds",
    "select 'pois' as layer, 'points' as kind, count(*) as n from a_poi union all select 'roads', "
    "'paths', count(*) from a_line union all select 'land', 'polygons', count(*) from a_box union "
    "all select 'mixed', 'points', count(*) from a_poi union all select 'mixed', 'paths', count(*) "
    "from a_line",
)
def _(d: Inputs) -> DataFrame:
    return spatial.layer_kinds(_wkt_layers(d))


@check(
    "geo_features_from_data",
    "with p as (select 'count' as measurement, count(distinct feature_type) as classes, "
    f"round(sum(value), 3) as total from ({_COUNT_SQL.format(box='')}) p), l as (select 'length' as "
    "measurement, count(distinct feature_type) as classes, round(sum(value) / 1e6, 3) as total "
    f"from ({_LENGTH_SQL}) l), a as (select 'area' as measurement, count(distinct feature_type) as "
    f"classes, round(sum(value) / 1e9, 3) as total from ({_AREA_SQL}) a) "
    "select 'pois' as geo_feature, * from p union all select 'roads', * from l union all "
    "select 'land', * from a union all select 'mixed', * from p union all select 'mixed', * from l",
)
def _(d: Inputs) -> DataFrame:
    """Kinds come from the shapes; the mixed layer gives counts and lengths."""
    built = spatial.geo_features_of(_grid(d), _wkt_layers(d))
    unit = F.when(F.col("measurement") == "length", 1e6).when(
        F.col("measurement") == "area", 1e9
    ).otherwise(1.0)
    return built.groupBy("geo_feature", "measurement").agg(
        F.countDistinct("feature_type").alias("classes"),
        F.round(F.sum(F.col("value") / unit), 3).alias("total"),
    )


# ---------------------------------------------------------------- sinks and layers


def _results(d: Inputs) -> DataFrame:
    return d.sql(
        "select p.poi_id as gid, p.lon, p.lat, p.p_size * 1.0e0 as prediction, t.ts from a_poi p "
        "join (select distinct ts from a_obs_day) t on day(t.ts) % 25 = p.p_size % 25"
    )


_RESULT_SQL = (
    "select p.poi_id as gid, p.p_size * 1.0e0 as prediction, t.ts from a_poi p "
    "join (select distinct ts from a_obs_day) t on day(t.ts) % 25 = p.p_size % 25"
)


@check("sink_csv", _RESULT_SQL)
def _(d: Inputs) -> DataFrame:
    folder = shared_dir(d.spark, "csv")
    write_csv(_results(d), folder)
    schema = "gid long, lon double, lat double, prediction double, ts timestamp"
    back = d.spark.read.schema(schema).option("header", True).csv(folder)
    return back.select("gid", "prediction", "ts")


@check("sink_grid_text", _RESULT_SQL)
def _(d: Inputs) -> DataFrame:
    folder = shared_dir(d.spark, "grid-text")
    write_grid_text(_results(d), folder)
    schema = "gid long, prediction double, longitude double, latitude double, ts timestamp"
    back = d.spark.read.schema(schema).option("header", True).csv(folder)
    return back.select("gid", "prediction", "ts")


@check("written_times", f"select distinct ts from ({_RESULT_SQL}) r")
def _(d: Inputs) -> DataFrame:
    folder = shared_dir(d.spark, "times")
    write_csv(_results(d), folder)
    return written_times(d.spark, folder)


@check("sink_router", f"select 'csv' as sink, * from ({_RESULT_SQL}) a union all select 'table', * from ({_RESULT_SQL}) b")
def _(d: Inputs) -> DataFrame:
    folder = shared_dir(d.spark, "router")
    table = folder.rsplit("/", 1)[-1].replace("-", "_")
    write_result(_results(d), [Sink("csv", folder), Sink("table", table)])
    schema = "gid long, lon double, lat double, prediction double, ts timestamp"
    back = d.spark.read.schema(schema).option("header", True).csv(folder)
    columns = ["sink", "gid", "prediction", "ts"]
    return back.withColumn("sink", F.lit("csv")).select(*columns).unionByName(
        d.spark.table(table).withColumn("sink", F.lit("table")).select(*columns)
    )


@check(
    "layers_from_catalog",
    "select id, geo_feature, feature_type, buffer_size, cast(value as double) as value from a_eav",
)
def _(d: Inputs) -> DataFrame:
    prefix = shared_dir(d.spark, "layers").rsplit("/", 1)[-1].replace("-", "_")
    for flag in ("A", "N", "R"):
        d.a_eav.where(F.col("geo_feature") == flag).createOrReplaceTempView(f"{prefix}_geofeature_{flag}")
    names = [t.rsplit("_", 1)[-1].upper() for t in layer_tables(d.spark, prefix)]
    opened = open_layers(d.spark, layer_catalog(prefix, names))
    found = None
    for layer in opened.values():
        found = layer if found is None else found.unionByName(layer)
    return found.select(
        "id", "geo_feature", "feature_type", "buffer_size", F.col("value").cast("double").alias("value")
    )


@check("time_of_file", "select event_id, date_trunc('second', ts) as ts from events")
def _(d: Inputs) -> DataFrame:
    name = F.concat(F.lit("out/result "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".0.csv"))
    return d.events.select("event_id", time_of_file(name).alias("ts"))


# ---------------------------------------------------------------- queries as text


def _as_text(d: Inputs, text: str, **tables: DataFrame) -> DataFrame:
    spark = d.events.sparkSession
    register_sql_functions(spark)
    return spark.sql(text, **tables)


@check(
    "sql_hourly_index",
    f"select event_type, date_trunc('hour', ts) as hour, round(avg(aqi), 5) as aqi from (select "
    f"event_type, ts, {_AQI_SQL.format(c='value')} as aqi from events) group by 1, 2",
)
def _(d: Inputs) -> DataFrame:
    return _as_text(
        d, "SELECT event_type, date_trunc('HOUR', ts) AS hour, round(avg(aqi_pm25(value)), 5) AS aqi "
        "FROM {events} GROUP BY 1, 2", events=d.events,
    )


@check(
    "sql_weighted_by_distance",
    "select d.id_a as id, round(sum(v.value / d.distance) / sum(1 / d.distance), 6) as value "
    "from a_distance d join (select station_id, avg(value) as value from a_obs_day group by 1) v "
    "on v.station_id = d.id_b group by 1",
)
def _(d: Inputs) -> DataFrame:
    return _as_text(
        d, "SELECT a.station_id AS id, round(sum(v.value * w) / sum(w), 6) AS value FROM ("
        "SELECT a.station_id, b.station_id AS other, inverse_distance_weight("
        "distance_m(a.lon, a.lat, b.lon, b.lat), 1) AS w FROM {station} a JOIN {station} b "
        "ON a.station_id <> b.station_id) a JOIN (SELECT station_id, avg(value) AS value "
        "FROM {obs} GROUP BY 1) v ON v.station_id = a.other GROUP BY 1",
        station=d.a_station, obs=d.a_obs_day,
    )


@check(
    "sql_rings_of_stations",
    "select station_id, s as buffer_size, round(100.0e0 * (s - 100) / 2900, 6) as share "
    "from a_station, unnest(generate_series(100, 3000, 100)) g(s)",
)
def _(d: Inputs) -> DataFrame:
    return _as_text(
        d, "SELECT s.station_id, r.buffer_size, round(rescale(r.buffer_size, 100, 3000, 0, 100), 6) "
        "AS share FROM {station} s, LATERAL rings(100, 3000) r", station=d.a_station,
    )
