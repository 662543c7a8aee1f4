from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorgrid.functions import parse_loose_timestamp, time_of_file
from sensorgrid.sinks import (
    Sink,
    nest_by_time,
    pending_times,
    write_result,
    written_file_times,
    written_times,
)
from sensorgrid.sources import (
    explode_directory,
    explode_feed,
    feature_table_name,
    flatten_weather,
    latest,
    layer_catalog,
    layer_name,
    layer_tables,
    open_layers,
    parse_station_csv,
    parse_wkt_point,
    read_query,
    read_table,
    request_grid,
)
from sensorgrid.operators.features import union_layers

NINE, TEN = datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 10)


def payload(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_station_feed(spark):
    lines = [
        '"10.5","20.25","2021-03-04T05:06","PM2.5","7.75","UG/M3","31","1"', "",
        '"10.5","20.25","2021-03-04T05:06","O3","N/A","PPB","12",""', "   ",
    ]
    df = spark.createDataFrame([(t,) for t in lines], "line string")
    rows = sorted(parse_station_csv(df).collect(), key=lambda r: r.parameter)
    assert [r.parameter for r in rows] == ["O3", "PM2.5"]
    assert rows[0].category is None and rows[1].category == 1
    assert rows[0].concentration is None  # no number
    assert (rows[1].lat, rows[1].lon) == (10.5, 20.25)
    assert rows[1].ts == datetime(2021, 3, 4, 5, 6) and rows[1].concentration == 7.75


def test_weather(spark):
    text = json.dumps({"timezone": "X", "currently": {"temperature": 0, "humidity": 0.5, "icon": ""}})
    row = flatten_weather(payload(spark, text)).first()
    assert (row.timezone, row.temperature, row.humidity) == ("X", 0.0, 0.5)
    assert row.icon is None and row.wind_speed is None
    assert flatten_weather(payload(spark, text), zero_as_null=True).first().temperature is None


def test_directory(spark):
    entries = [
        {"ID": 1, "Lat": 34.0, "Lon": -118.0, "THINGSPEAK_PRIMARY_ID": "9", "ParentID": None},
        {"ID": 2, "Lat": 0, "Lon": -118.0}, {"ID": 3, "Lon": -118.0}, {"ID": 4, "Lat": 1.0, "Lon": 2.0},
    ]
    rows = explode_directory(payload(spark, json.dumps({"results": entries}))).collect()
    assert {(r.id, r.sensor_id, r.location) for r in rows} == {
        ("1", "9", "POINT(-118.0 34.0)"), ("4", None, "POINT(2.0 1.0)")
    }


def test_feed(spark):
    text = json.dumps({"channel": {"id": 5}, "feeds": [
        {"created_at": "2018-06-14T16:00:05Z", "entry_id": 1, "field1": "", "field2": "0"},
    ]})
    row = explode_feed(payload(spark, text)).first()
    assert (row.id, row.entry_id, row.pm1_atm, row.pm2_5_atm) == (5, 1, None, 0.0)
    assert row.ts == datetime(2018, 6, 14, 16, 0, 5) and row.humidity is None


@pytest.mark.parametrize("text,expected", [
    ("2018-06-14T16:00:05Z", datetime(2018, 6, 14, 16, 0, 5)),
    ("2018/6/14 16:00:05", datetime(2018, 6, 14, 16, 0, 5)),
    ("2018-06", None), ("", None),
])
def test_loose_timestamps(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(parse_loose_timestamp(F.col("t")))
    assert df.first()[0] == expected


def test_wkt(spark):
    df = spark.createDataFrame([("POINT(-118.25 34)",), ("POINT EMPTY",)], "location string")
    got = [(r.lon, r.lat) for r in parse_wkt_point(df).collect()]
    assert got == [(-118.25, 34.0), (None, None)]


def test_request_grid(spark):
    stations = spark.createDataFrame([("a",), ("b",)], "station_id string")
    got = request_grid(stations, "2024-01-01 02:00:00", "2024-01-01 05:00:00").collect()
    assert {(r.station_id, r.ts.hour) for r in got} == {(s, h) for s in "ab" for h in (2, 3, 4)}
    assert request_grid(stations, "2024-01-02", "2024-01-01").count() == 0


def test_tables_and_layers(spark):
    spark.sql("create database if not exists maps")
    for name in ("city_osm_roads", "city_osm_buildings_a", "other_osm_roads"):
        spark.range(1).write.mode("overwrite").saveAsTable(f"maps.{name}")
    assert layer_tables(spark, "city", database="maps") == ["city_osm_roads"]
    assert layer_name("california_osm_landuse_a") == "landuse_a"
    assert feature_table_name("reporting_areas_3000m_buffer", "roads") == (
        "reporting_areas_geofeature_roads"
    )
    assert read_table(spark, "maps.city_osm_roads", ["id + 1 as n"], "where id = 0").first().n == 1
    assert read_query(spark, "select count(*) as n from maps.city_osm_roads").first().n == 1


def test_layer_catalog_opens_as_one_table(spark):
    spark.createDataFrame(
        [("s", "roads", "path", 100, 2.0)],
        "id string, geo_feature string, feature_type string, buffer_size int, value double",
    ).write.mode("overwrite").saveAsTable("net_geofeature_roads")
    spark.createDataFrame(
        [("s", 5.0, 6.0, 7.0)], "id string, lon double, lat double, elevation double"
    ).write.mode("overwrite").saveAsTable("net_elevation")
    catalog = layer_catalog("net", ["roads", "elevation", "longitude"])
    assert catalog == {
        "roads": "net_geofeature_roads", "elevation": "net_elevation", "longitude": "net_elevation"
    }
    rows = union_layers(open_layers(spark, catalog)).collect()
    assert {(r.feature_type, r.value) for r in rows} == {
        ("path", 2.0), ("elevation", 7.0), ("longitude", 5.0)
    }


@pytest.fixture(scope="module")
def result(spark):
    return spark.createDataFrame(
        [("2", NINE, 5.0, 1.0, 2.0), ("1", NINE, 4.0, 1.0, 2.0), ("1", TEN, 3.0, 1.0, 2.0)],
        "gid string, ts timestamp, prediction double, lon double, lat double",
    )


def test_latest_is_pushed_to_the_scan(spark, result, tmp_path):
    path = str(tmp_path / "t")
    result.write.parquet(path)
    df = latest(spark.read.parquet(path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), EqualTo(ts,ScalarSubquery" in plan
    assert df.count() == 1


def test_documents(result):
    rows = {r.timestamp: [(i.gid, i.aqi) for i in r["data"]] for r in nest_by_time(result).collect()}
    assert rows == {NINE: [(1, 4.0), (2, 5.0)], TEN: [(1, 3.0)]}
    parts = nest_by_time(result, parts=4).collect()
    assert sorted((r.timestamp, i.gid) for r in parts for i in r["data"]) == [
        (NINE, 1), (NINE, 2), (TEN, 1)
    ]


def test_router_writes_every_sink(spark, result, tmp_path):
    where = {k: str(tmp_path / k) for k in ("documents", "csv", "grid_text")}
    sinks = [Sink(k, v) for k, v in where.items()] + [Sink("table", "written")]
    write_result(result, sinks)
    write_result(result.where("gid = '2'"), [Sink("table", "written")])
    assert spark.table("written").count() == 4
    assert spark.read.json(where["documents"]).count() == 2
    assert spark.read.option("header", True).csv(where["csv"]).count() == 3
    text = spark.read.option("header", True).csv(where["grid_text"])
    assert text.columns[:4] == ["gid", "prediction", "longitude", "latitude"]
    with pytest.raises(ValueError):
        write_result(result, [Sink("fax", "x")])


def test_pending_times_after_a_write(spark, result, tmp_path):
    path = str(tmp_path / "csv")
    write_result(result.where("gid = '2'"), [Sink("csv", path)])
    done = written_times(spark, path)
    assert [r.ts for r in done.collect()] == [NINE]
    assert [r.ts for r in pending_times(result, done).collect()] == [TEN]


def test_times_of_file_names(spark, tmp_path):
    (tmp_path / "2024-01-01 09:00:00.0.txt").write_text("x")
    (tmp_path / "notes.txt").write_text("x")
    assert [r.ts for r in written_file_times(spark, str(tmp_path)).collect()] == [NINE]
    df = spark.createDataFrame([("2024-01-01 10:00:00.0.txt",)], "f string")
    assert df.select(time_of_file(F.col("f"))).first()[0] == TEN
