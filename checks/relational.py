"""Checks of scans, windows, panels, channels, interpolation, metrics, rollup and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.adapters import Inputs
from checks.registry import check
from sensorgrid.functions import (
    aqi_pm25,
    feature_table,
    layer_of_table,
    parse_loose_timestamp,
    rescale,
    unix_seconds,
    unquote,
    utc_to_local,
    wkt_point,
    zero_to_null,
)
from sensorgrid.operators import channels, idw, ingest, metrics, panel, rollup, windows
from sensorgrid.plans import networks
from sensorgrid.sinks import nest_by_time, pending_times
from sensorgrid.sources import (
    at_time,
    explode_directory,
    explode_feed,
    flatten_weather,
    latest,
    parse_station_csv,
    parse_wkt_point,
    read_query,
    read_table,
    request_grid,
    time_range,
)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


# ---------------------------------------------------------------- scans and projections


@check(
    "scan_project_filter",
    "select event_id, ts, value * 2 as double_value from events "
    "where event_type = 'click' and value > 0",
)
def _(d: Inputs) -> DataFrame:
    return read_table(
        d.spark, f"{d.sf_dir}/events.parquet", ["event_id", "ts", "value * 2 as double_value"],
        "where event_type = 'click' and value > 0", format="parquet",
    )


@check(
    "scan_subquery",
    "select id, distance from (select * from a_near where distance <= 50) ed",
)
def _(d: Inputs) -> DataFrame:
    return read_query(
        d.spark, "select id, distance from (select * from {near} where distance <= 50) ed",
        near=d.a_near,
    )


@check(
    "scan_max_time",
    "select max(ts) as max_ts from events where event_type = 'view'",
)
def _(d: Inputs) -> DataFrame:
    return read_table(
        d.spark, f"{d.sf_dir}/events.parquet", ["max(ts) as max_ts"], "event_type = 'view'",
        format="parquet",
    )


@check(
    "latest_slice",
    "select station_id, ts, round(value, 6) as value from a_obs_user "
    "where ts = (select max(ts) from a_obs_user)",
)
def _(d: Inputs) -> DataFrame:
    return rounded(latest(d.a_obs_user), "value")


@check(
    "time_range",
    "select station_id, ts, round(value, 6) as value from a_obs_user "
    "where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 00:00:00'",
)
def _(d: Inputs) -> DataFrame:
    start, end = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")
    return rounded(time_range(d.a_obs_user, start, end), "value")


@check(
    "time_slice",
    "select station_id, ts, round(value, 6) as value from a_obs_day "
    "where ts = timestamp '2024-01-10 00:00:00'",
)
def _(d: Inputs) -> DataFrame:
    return rounded(at_time(d.a_obs_day, F.lit("2024-01-10").cast("timestamp")), "value")


@check(
    "rename_cast_drop",
    "select cast(id as varchar) as station, ts, pm2_5 as value from a_sensor_minute",
)
def _(d: Inputs) -> DataFrame:
    renamed = d.a_sensor_minute.withColumnRenamed("pm2_5", "value")
    cast = renamed.withColumn("station", F.col("id").cast("string"))
    return cast.select("station", "ts", "value")


@check("distinct_rows", "select distinct sensor_id, channel from a_sensor_minute")
def _(d: Inputs) -> DataFrame:
    return d.a_sensor_minute.select("sensor_id", "channel").distinct()


@check(
    "positive_values",
    "select station_id, count(*) as n from a_obs_user where value > 0 group by 1",
)
def _(d: Inputs) -> DataFrame:
    return d.a_obs_user.where("value > 0").groupBy("station_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- payloads


@check(
    "station_csv",
    """
    select e.event_id, cast(date_trunc('minute', e.ts) as timestamp) as ts, s.lon, s.lat,
           e.event_type as parameter, e.value as concentration, 'UG/M3' as unit,
           e.user_id * 1.0e0 as aqi,
           case when e.event_type <> 'error' then cast(e.user_id % 6 as integer) end as category
    from events e join a_station s on s.station_id = concat('s', e.user_id % 12)
    """,
)
def _(d: Inputs) -> DataFrame:
    return parse_station_csv(station_lines(d))


def station_lines(d: Inputs) -> DataFrame:
    """Feed lines written from the events, with an empty line after each."""
    fields = d.sql(
        "select e.event_id, e.ts, s.lon, s.lat, e.event_type, e.value, e.user_id "
        "from events e join a_station s on s.station_id = concat('s', e.user_id % 12)"
    )
    category = F.when(F.col("event_type") == "error", F.lit("")).otherwise(
        (F.col("user_id") % 6).cast("string")
    )
    parts = [
        F.col("lat").cast("string"), F.col("lon").cast("string"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.col("event_type"),
        F.col("value").cast("string"), F.lit("UG/M3"), F.col("user_id").cast("string"), category,
    ]
    quoted = [F.concat(F.lit('"'), p, F.lit('"')) for p in parts]
    line = F.concat_ws(",", *quoted)
    return fields.select("event_id", F.explode(F.array(line, F.lit(""))).alias("line"))


_WEATHER_SQL = """
    select event_id, event_type as timezone, nullif(event_type, 'error') as summary,
           cast(null as varchar) as icon, {humidity} as humidity, value as temperature
    from events
"""


def weather_payloads(d: Inputs) -> DataFrame:
    now = F.struct(
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("summary"),
        (F.col("user_id") % 3 * 1.0).alias("humidity"),
        F.col("value").alias("temperature"),
    )
    return d.events.select(
        "event_id",
        F.to_json(F.struct(F.col("event_type").alias("timezone"), now.alias("currently"))).alias(
            "payload"
        ),
    )


@check("weather_json", _WEATHER_SQL.format(humidity="user_id % 3 * 1.0e0"))
def _(d: Inputs) -> DataFrame:
    flat = flatten_weather(weather_payloads(d))
    return flat.select("event_id", "timezone", "summary", "icon", "humidity", "temperature")


@check(
    "weather_json_zero_as_null",
    _WEATHER_SQL.format(humidity="nullif(user_id % 3 * 1.0e0, 0)"),
)
def _(d: Inputs) -> DataFrame:
    flat = flatten_weather(weather_payloads(d), zero_as_null=True)
    return flat.select("event_id", "timezone", "summary", "icon", "humidity", "temperature")


def feed_payloads(d: Inputs) -> DataFrame:
    """One feed payload per event: the reading itself and an entry with empty fields."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    full = F.struct(
        at.alias("created_at"), F.col("event_id").alias("entry_id"),
        F.col("value").cast("string").alias("field2"), F.lit("0").alias("field4"),
        F.lit("").alias("field8"),
    )
    empty = F.struct(
        at.alias("created_at"), (-F.col("event_id") - 1).alias("entry_id"),
        F.lit("").alias("field2"), F.lit("").alias("field4"), F.lit("7.5").alias("field8"),
    )
    return d.events.select(
        F.to_json(
            F.struct(
                F.struct(F.col("user_id").alias("id")).alias("channel"),
                F.array(full, empty).alias("feeds"),
            )
        ).alias("payload")
    )


_FEED_SQL = """
    select user_id as id, cast(date_trunc('second', ts) as timestamp) as ts, event_id as entry_id,
           value as pm2_5_atm, 0.0e0 as uptime, cast(null as double) as pm2_5_cf_1 from events
    union all
    select user_id, cast(date_trunc('second', ts) as timestamp), -event_id - 1, null, null, 7.5e0
    from events
"""


@check("sensor_feed_json", _FEED_SQL)
def _(d: Inputs) -> DataFrame:
    feed = explode_feed(feed_payloads(d))
    return feed.select("id", "ts", "entry_id", "pm2_5_atm", "uptime", "pm2_5_cf_1")


def directory_payloads(d: Inputs) -> DataFrame:
    entry = F.struct(
        F.col("gid").alias("ID"),
        F.when(F.col("gid") % 10 == 0, 0.0).otherwise(F.col("lat")).alias("Lat"),
        F.when(F.col("gid") % 11 == 0, None).otherwise(F.col("lon")).alias("Lon"),
        (F.col("gid") + 100000).alias("THINGSPEAK_PRIMARY_ID"),
        F.concat(F.lit("key"), "gid").alias("THINGSPEAK_PRIMARY_ID_READ_KEY"),
        F.when(F.col("gid") % 2 == 0, F.col("gid") - 1).alias("ParentID"),
    )
    return d.a_grid.select(F.to_json(F.struct(F.array(entry).alias("results"))).alias("payload"))


_DIRECTORY_SQL = """
    select cast(gid as varchar) as id, lat, lon, cast(gid + 100000 as varchar) as sensor_id,
           concat('key', gid) as sensor_key,
           case when gid % 2 = 0 then cast(gid - 1 as varchar) end as parent_id
           {extra}
    from a_grid where gid % 10 <> 0 and gid % 11 <> 0
"""


@check("sensor_directory_json", _DIRECTORY_SQL.format(extra=""))
def _(d: Inputs) -> DataFrame:
    return explode_directory(directory_payloads(d)).drop("location")


@check(
    "sensor_directory_channels",
    _DIRECTORY_SQL.format(extra=", case when gid % 2 = 0 then 'a' else 'b' end as channel"),
)
def _(d: Inputs) -> DataFrame:
    return networks.build_directory(directory_payloads(d), "payload").drop("location")


@check("wkt_point", "select gid, lon, lat from a_grid")
def _(d: Inputs) -> DataFrame:
    text = d.a_grid.select("gid", wkt_point(F.col("lon"), F.col("lat")).alias("location"))
    return parse_wkt_point(text).select("gid", "lon", "lat")


@check(
    "located_points",
    "select gid, lon, lat from (select gid, case when gid % 10 = 0 then 0 else lon end as lon, "
    "case when gid % 11 <> 0 then lat end as lat from a_grid) g where lon <> 0 and lat <> 0",
)
def _(d: Inputs) -> DataFrame:
    holes = d.a_grid.select(
        "gid", F.when(F.col("gid") % 10 == 0, 0.0).otherwise(F.col("lon")).alias("lon"),
        F.when(F.col("gid") % 11 != 0, F.col("lat")).alias("lat"),
    )
    return channels.has_point(holes)


@check(
    "request_grid",
    "select s.station_id, h.ts from a_station s cross join (select unnest(generate_series("
    "timestamp '2024-01-01 02:00:00', timestamp '2024-01-02 04:00:00', interval 1 hour)) as ts) h",
)
def _(d: Inputs) -> DataFrame:
    stations = d.a_station.select("station_id")
    return request_grid(stations, "2024-01-01 02:00:00", "2024-01-02 05:00:00")


# ---------------------------------------------------------------- scalar functions


@check(
    "scalar_text",
    r"""
    select p_partkey, epoch(timestamp '2024-01-01 00:00:00' + p_partkey * interval 1 minute)::bigint
             as seconds,
           trim(concat('"', p_name, '"'), '"') as bare,
           array_to_string(list_slice(string_split(concat('region_osm_', p_brand, '_a'), '_'), 3, 99), '_')
             as layer,
           concat('network_areas_geofeature_', p_brand) as output_table,
           timestamp '2024-01-01 00:00:00' + p_partkey * interval 1 minute as loose_ts
    from part
    """,
)
def _(d: Inputs) -> DataFrame:
    ts = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, p_partkey, 0)")
    return d.part.withColumn("ts", ts).select(
        "p_partkey",
        unix_seconds(F.col("ts")).alias("seconds"),
        unquote(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("bare"),
        layer_of_table(F.concat(F.lit("region_osm_"), "p_brand", F.lit("_a"))).alias("layer"),
        feature_table(F.lit("network_areas_3000m_buffer"), F.col("p_brand")).alias("output_table"),
        parse_loose_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("loose_ts"),
    )


@check(
    "rescale",
    "select event_id, round(50 + (value - 12.0e0) / 23.5e0 * 50, 6) as scaled from events",
)
def _(d: Inputs) -> DataFrame:
    return d.events.select(
        "event_id", F.round(rescale(F.col("value"), 12, 35.5, 50, 100), 6).alias("scaled")
    )


_AQI_SQL = """
    case when {c} >= 0 and {c} < 12 then {c} / 12e0 * 50
         when {c} >= 12 and {c} < 35.5e0 then 50 + ({c} - 12) / 23.5e0 * 50
         when {c} >= 35.5e0 and {c} < 55.5e0 then 100 + ({c} - 35.5e0) / 20e0 * 50
         when {c} >= 55.5e0 and {c} < 150.5e0 then 150 + ({c} - 55.5e0) / 95e0 * 50
         when {c} >= 150.5e0 and {c} < 250.5e0 then 200 + ({c} - 150.5e0)
         when {c} >= 250.5e0 and {c} < 350.5e0 then 300 + ({c} - 250.5e0)
         when {c} >= 350.5e0 and {c} < 500.5e0 then 400 + ({c} - 350.5e0) / 150e0 * 100 end
"""


@check(
    "aqi_from_pm25",
    f"select event_id, round({_AQI_SQL.format(c='(value * 2 - 10)')}, 5) as aqi from events",
)
def _(d: Inputs) -> DataFrame:
    return d.events.select("event_id", F.round(aqi_pm25(F.col("value") * 2 - 10), 5).alias("aqi"))


@check(
    "zero_to_null",
    "select event_id, nullif(user_id % 5, 0) as v from events",
)
def _(d: Inputs) -> DataFrame:
    return d.events.select("event_id", zero_to_null(F.col("user_id") % 5).alias("v"))


@check(
    "tz_hour",
    "select event_id, date_trunc('hour', (ts at time zone 'UTC') at time zone "
    "'America/Los_Angeles') as local_hour from events",
)
def _(d: Inputs) -> DataFrame:
    local = utc_to_local(F.col("ts").cast("timestamp"), "America/Los_Angeles")
    return d.events.select("event_id", F.date_trunc("hour", local).alias("local_hour"))


# ---------------------------------------------------------------- windows

_HOURS = (
    "over (partition by station_id order by epoch(ts)::bigint "
    "range between {back} preceding and {ahead} following)"
)
_BACK3 = _HOURS.format(back=10800, ahead=0)


@check(
    "rolling_mean",
    f"select station_id, ts, round(avg(value) {_BACK3}, 6) as mean from a_obs_user",
)
def _(d: Inputs) -> DataFrame:
    return rounded(windows.rolling(d.a_obs_user).select("station_id", "ts", "mean"), "mean")


@check(
    "rolling_median",
    f"select station_id, ts, round(median(value) {_BACK3}, 6) as median from a_obs_user",
)
def _(d: Inputs) -> DataFrame:
    return rounded(windows.rolling(d.a_obs_user).select("station_id", "ts", "median"), "median")


@check(
    "rolling_centered",
    f"select station_id, ts, round(avg(value) {_HOURS.format(back=7200, ahead=7200)}, 6) as mean, "
    f"round(median(value) {_HOURS.format(back=7200, ahead=7200)}, 6) as median from a_obs_user",
)
def _(d: Inputs) -> DataFrame:
    rolled = windows.rolling(d.a_obs_user, hours=2, centered=True)
    return rounded(rolled.select("station_id", "ts", "mean", "median"), "mean", "median")


@check(
    "rolling_extra_key",
    "select event_id, round(avg(value) over (partition by user_id, event_type order by "
    "epoch(date_trunc('second', ts))::bigint range between 86400 preceding and current row), 6) "
    "as mean from events",
)
def _(d: Inputs) -> DataFrame:
    rolled = windows.rolling(d.events, "user_id", hours=24, extra_keys=["event_type"])
    return rounded(rolled.select("event_id", "mean"), "mean")


@check(
    "rolling_copies",
    "select event_id, n, round(avg(value) over w, 6) as mean, round(median(value) over w, 6) as "
    "median from (select *, unnest(range(user_id % 3 + 1)) as n from events) e "
    "window w as (partition by event_type order by epoch(date_trunc('second', ts))::bigint "
    "range between 7200 preceding and current row)",
)
def _(d: Inputs) -> DataFrame:
    repeated = d.events.withColumn("n", F.explode(F.expr("sequence(0L, user_id % 3)")))
    rolled = windows.rolling(repeated, "event_type", hours=2, sum_copies=True)
    return rounded(rolled.select("event_id", "n", "mean", "median"), "mean", "median")


@check(
    "row_window_mean",
    "select station_id, ts, round(avg(value) over (partition by station_id order by ts "
    "rows between 2 preceding and 2 following), 6) as mean from a_obs_user",
)
def _(d: Inputs) -> DataFrame:
    framed = windows.row_window(d.a_obs_user, k=5, rows_per_block=128)
    return rounded(framed.select("station_id", "ts", "mean"), "mean")


def _fill_sql(stat: str) -> str:
    return (
        f"select station_id, ts, round(value, 6) as value, "
        f"round(coalesce(value, {stat}(value) {_BACK3}), 6) as label from a_obs_user"
    )


@check("fill_gaps_median", _fill_sql("median"))
def _(d: Inputs) -> DataFrame:
    filled = windows.fill_gaps(d.a_obs_user, method="median")
    return rounded(filled.select("station_id", "ts", "value", "label"), "value", "label")


@check("fill_gaps_mean", _fill_sql("avg"))
def _(d: Inputs) -> DataFrame:
    filled = windows.fill_gaps(d.a_obs_user, method="mean")
    return rounded(filled.select("station_id", "ts", "value", "label"), "value", "label")


# ---------------------------------------------------------------- panels


@check("station_count", "select count(distinct station_id) as n_stations from a_obs_user")
def _(d: Inputs) -> DataFrame:
    return panel.station_count(d.a_obs_user)


@check(
    "support_count",
    "select station_id, ts, round(value, 6) as value from a_obs_user "
    "qualify count(*) over (partition by ts) >= 10",
)
def _(d: Inputs) -> DataFrame:
    gated = panel.support_gate(d.a_obs_user, min_rows=10)
    return rounded(gated.select("station_id", "ts", "value"), "value")


@check(
    "support_fraction",
    "select station_id, ts, round(value, 6) as value from a_obs_hour qualify count(*) over "
    "(partition by ts) >= floor(0.75e0 * (select count(distinct station_id) from a_obs_hour))",
)
def _(d: Inputs) -> DataFrame:
    gated = panel.support_gate(d.a_obs_hour, frac=0.75)
    return rounded(gated.select("station_id", "ts", "value"), "value")


@check(
    "times_with_support",
    "select ts, count(station_id) as n_rows from a_obs_user group by ts having count(*) >= 10",
)
def _(d: Inputs) -> DataFrame:
    return panel.eligible_times(d.a_obs_user, min_rows=10)


@check(
    "loo_split_counts",
    "select f.station_id, sum(case when o.station_id = f.station_id then 1 else 0 end)::bigint "
    "as n_test, sum(case when o.station_id <> f.station_id then 1 else 0 end)::bigint as n_train "
    "from (select distinct station_id from a_obs_user) f, a_obs_user o group by 1",
)
def _(d: Inputs) -> DataFrame:
    return panel.leave_one_out_sizes(d.a_obs_user)


@check(
    "loo_split",
    f"select 'train' as part, station_id, ts, round(coalesce(value, median(value) {_BACK3}), 6) "
    "as reading from a_obs_user where station_id <> 's3' union all "
    "select 'test', station_id, ts, round(value, 6) from a_obs_user where station_id = 's3'",
)
def _(d: Inputs) -> DataFrame:
    train, test = panel.leave_one_out(d.a_obs_user, windows.fill_gaps(d.a_obs_user), "s3")
    return train.select(
        F.lit("train").alias("part"), "station_id", "ts", F.round("label", 6).alias("reading")
    ).union(
        test.select(F.lit("test"), "station_id", "ts", F.round("value", 6))
    )


@check(
    "complete_times",
    "select ts from a_obs_hour group by ts "
    "having count(*) = (select count(distinct station_id) from a_obs_hour)",
)
def _(d: Inputs) -> DataFrame:
    return panel.complete_times(d.a_obs_hour)


_LABELS = (
    "lab as (select station_id, ts, coalesce(coalesce(value, median(value) over (partition by "
    "station_id order by epoch(ts)::bigint range between 10800 preceding and current row)), 0.0e0) "
    "as label from {obs})"
)


def _exploded(df: DataFrame, id_col: str = "station_id", col: str = "series") -> DataFrame:
    flat = df.select(id_col, F.posexplode(col).alias("pos", "value"))
    return flat.withColumn("pos", F.col("pos").cast("long")).withColumn("value", F.round("value", 6))


@check(
    "series_complete",
    f"with {_LABELS.format(obs='a_obs_day')} select station_id, row_number() over "
    "(partition by station_id order by ts) - 1 as pos, round(label, 6) as value from lab "
    "where ts in (select ts from lab group by ts having count(*) = "
    "(select count(distinct station_id) from lab))",
)
def _(d: Inputs) -> DataFrame:
    return _exploded(panel.series(windows.fill_gaps(d.a_obs_day)))


@check(
    "series_tolerant",
    f"with {_LABELS.format(obs='a_obs_hour')}, kept as (select station_id from lab group by 1 "
    "having count(*) >= (select count(distinct ts) from lab) - 225), rows_kept as "
    "(select * from lab where station_id in (select station_id from kept)), shared as "
    "(select ts from rows_kept group by ts having count(*) = (select count(*) from kept)) "
    "select station_id, row_number() over (partition by station_id order by ts) - 1 as pos, "
    "round(label, 6) as value from rows_kept where ts in (select ts from shared)",
)
def _(d: Inputs) -> DataFrame:
    cleaned = windows.fill_gaps(d.a_obs_hour)
    return _exploded(panel.series_tolerant(cleaned, tolerance=225))


@check(
    "series_tolerant_two_networks",
    "with both_nets as (select station_id, ts, value from a_obs_day_even union all "
    "select station_id, ts, value from a_obs_day_odd), base as "
    "(select distinct ts from a_obs_day_even), kept as (select station_id from both_nets "
    "group by 1 having count(*) >= (select count(*) from base) - 3), rows_kept as "
    "(select * from both_nets where station_id in (select station_id from kept)), shared as "
    "(select ts from rows_kept group by ts having count(*) = (select count(*) from kept)) "
    "select station_id, row_number() over (partition by station_id order by ts) - 1 as pos, "
    "round(coalesce(value, 0), 6) as value from rows_kept "
    "where ts in (select ts from shared) and ts in (select ts from base)",
)
def _(d: Inputs) -> DataFrame:
    first = d.a_obs_day_even.withColumnRenamed("value", "label")
    second = d.a_obs_day_odd.withColumnRenamed("value", "label")
    return _exploded(panel.series_tolerant(first.unionByName(second), first, tolerance=3))


@check(
    "times_per_station",
    "select station_id, row_number() over (partition by station_id order by ts) - 1 as pos, ts "
    "from (select distinct station_id, ts from a_obs_user) o",
)
def _(d: Inputs) -> DataFrame:
    times = panel.times_per_station(d.a_obs_user)
    flat = times.select("station_id", F.posexplode("times").alias("pos", "ts"))
    return flat.withColumn("pos", F.col("pos").cast("long"))


# ---------------------------------------------------------------- channels


def _readings(d: Inputs) -> DataFrame:
    hour = d.a_sensor_minute.withColumn("ts", F.date_trunc("hour", "ts"))
    return hour.withColumnRenamed("pm2_5", "value")


def _merge_sql(how: str) -> str:
    return (
        "select id, cast(date_trunc('hour', ts) as timestamp) as ts, "
        f"round({how}(pm2_5), 6) as value from a_sensor_minute group by 1, 2"
    )


@check("channel_max", _merge_sql("max"))
def _(d: Inputs) -> DataFrame:
    return rounded(channels.merge_channels(_readings(d), "max"), "value")


@check("channel_min", _merge_sql("min"))
def _(d: Inputs) -> DataFrame:
    return rounded(channels.merge_channels(_readings(d), "min"), "value")


@check("channel_avg", _merge_sql("avg"))
def _(d: Inputs) -> DataFrame:
    return rounded(channels.merge_channels(_readings(d), "avg"), "value")


@check(
    "channel_only",
    "select id, ts, pm2_5 from a_sensor_minute where channel = 'b'",
)
def _(d: Inputs) -> DataFrame:
    return channels.select_channel(d.a_sensor_minute, only="b").select("id", "ts", "pm2_5")


@check(
    "channel_exclude_near",
    "select m.id, m.ts, m.pm2_5 from a_sensor_minute m join a_near n on m.id = n.id "
    "where m.channel <> 'b' and n.distance <= 50",
)
def _(d: Inputs) -> DataFrame:
    bare = d.a_sensor_minute.select("sensor_id", "ts", "pm2_5")
    joined = channels.with_directory(bare, d.a_directory)
    kept = channels.near_only(channels.select_channel(joined, exclude="b"), d.a_near, 50)
    return kept.select("id", "ts", "pm2_5")


@check(
    "sensor_directory_join",
    "select event_id, sensor_id, id, channel, pm2_5 from a_sensor_minute",
)
def _(d: Inputs) -> DataFrame:
    bare = d.a_sensor_minute.select("event_id", "sensor_id", "pm2_5")
    return channels.with_directory(bare, d.a_directory).select(
        "event_id", "sensor_id", "id", "channel", "pm2_5"
    )


# ---------------------------------------------------------------- interpolation and errors

_IDW_SQL = """
    with w as (select id_a, id_b, 1.0e0 / distance as weight from {distance}),
    times as (select ts, count(station_id) as n from {source} group by ts {having}),
    p as (select w.id_a, s.ts, sum(s.value * w.weight) / sum({divisor}) as prediction
          from {source} s join times using (ts) join w on s.station_id = w.id_b group by 1, 2)
    select t.station_id, t.ts, round(t.value, 6) as truth, round(p.prediction, 6) as prediction
    from {target} t join p on p.id_a = t.station_id and p.ts = t.ts {loo}
"""
_LOO = dict(
    distance="a_distance_user", source="a_obs_user", target="a_obs_user", having="",
    divisor="w.weight", loo="join times on times.ts = t.ts where times.n - 1 >= 8",
)
_TWO = dict(
    distance="a_distance24", source="a_obs_even", target="a_obs_odd", having="having count(*) >= 6",
    divisor="w.weight", loo="",
)


def _two_networks(d: Inputs, **options) -> DataFrame:
    return idw.idw(d.a_obs_odd, d.a_obs_even, d.a_distance24, min_sources=6, **options)


@check("idw", _IDW_SQL.format(**_TWO))
def _(d: Inputs) -> DataFrame:
    return rounded(_two_networks(d), "truth", "prediction")


@check(
    "idw_known_weights_only",
    _IDW_SQL.format(**{**_TWO, "divisor": "case when s.value is not null then w.weight end"}),
)
def _(d: Inputs) -> DataFrame:
    return rounded(_two_networks(d, null_weight_in_denominator=False), "truth", "prediction")


@check("idw_loo", _IDW_SQL.format(**_LOO))
def _(d: Inputs) -> DataFrame:
    return rounded(idw.idw_loo(d.a_obs_user, d.a_distance_user, min_sources=8), "truth", "prediction")


_ERRORS = (
    "round(sqrt(sum(pow(truth - prediction, 2)) / count(*)), 5) as rmse, "
    "round(sum(abs(truth - prediction)) / count(*), 5) as mae, count(*) as n"
)
_RAW_IDW = _IDW_SQL.replace("round(t.value, 6)", "t.value").replace(
    "round(p.prediction, 6)", "p.prediction"
)


@check(
    "idw_loo_station_errors",
    _RAW_IDW.format(
        **{**_LOO, "distance": "a_distance_user_all", "loo": _LOO["loo"].replace(">= 8", ">= 10")}
    ).replace(
        "    select t.station_id", ", r as (select t.station_id"
    ) + f") select station_id, {_ERRORS} from r group by 1",
)
def flagship(d: Inputs) -> DataFrame:
    out = networks.idw_station_errors(d.a_obs_user, d.a_distance_user_all)
    return rounded(out, "rmse", "mae", places=5)


@check(
    "idw_time_errors",
    _RAW_IDW.format(**_TWO).replace("    select t.station_id", ", r as (select t.station_id")
    + f") select ts, {_ERRORS.replace('as n', 'as sensor_count')} from r group by 1",
)
def _(d: Inputs) -> DataFrame:
    out = networks.idw_network_errors(d.a_obs_odd, d.a_obs_even, d.a_distance24, 6)
    return rounded(out, "rmse", "mae", places=5)


_PAIRS = (
    "pairs as (select o.station_id, o.ts, o.value as truth, p.value as prediction "
    "from a_obs_day o join a_obs_day_even p on o.ts = p.ts and o.station_id = p.station_id)"
)


def _pairs(d: Inputs) -> DataFrame:
    predicted = d.a_obs_day_even.withColumnRenamed("value", "prediction")
    return metrics.join_truth(predicted, d.a_obs_day)


@check(
    "prediction_truth_join",
    f"with {_PAIRS} select station_id, ts, round(truth, 6) as truth, "
    "round(prediction, 6) as prediction from pairs",
)
def _(d: Inputs) -> DataFrame:
    return rounded(_pairs(d), "truth", "prediction")


@check("rmse_mae_global", f"with {_PAIRS} select {_ERRORS} from pairs")
def _(d: Inputs) -> DataFrame:
    return rounded(metrics.errors(_pairs(d)), "rmse", "mae", places=5)


@check("rmse_mae_by_key", f"with {_PAIRS} select station_id, {_ERRORS} from pairs group by 1")
def _(d: Inputs) -> DataFrame:
    return rounded(metrics.errors(_pairs(d), by=["station_id"]), "rmse", "mae", places=5)


# ---------------------------------------------------------------- rollup

_MEDIAN_SQL = (
    "select {keys}, round(median(case when event_type <> 'error' then value end), 6) as median "
    "from events group by {keys}"
)


def _valued(d: Inputs) -> DataFrame:
    return d.events.withColumn(
        "value", F.when(F.col("event_type") != "error", F.col("value"))
    )


@check("median_by_key", _MEDIAN_SQL.format(keys="user_id, event_type"))
def _(d: Inputs) -> DataFrame:
    return rounded(rollup.median_by(_valued(d), ["user_id", "event_type"]), "median")


@check("median_by_key_split", _MEDIAN_SQL.format(keys="event_type"))
def _(d: Inputs) -> DataFrame:
    return rounded(rollup.median_by_split(_valued(d), ["event_type"]), "median")


@check(
    "band_join_median",
    "select sensor_id, anchor, round(median(pm2_5), 6) as median from a_sensor_minute m join "
    "(select distinct ts as anchor from a_obs_hour where value is not null) a on "
    "m.ts > anchor - interval 10 minute and m.ts < anchor + interval 10 minute group by 1, 2",
)
def _(d: Inputs) -> DataFrame:
    anchors = d.a_obs_hour.where("value is not null").select(F.col("ts").alias("anchor"))
    near = rollup.band_join(d.a_sensor_minute, anchors)
    return rounded(rollup.median_by(near, ["sensor_id", "anchor"], "pm2_5"), "median")


@check(
    "anchor_times",
    "select distinct ts as anchor from a_obs_hour where ts > timestamp '2024-01-10 12:00:00' "
    "order by 1",
)
def _(d: Inputs) -> DataFrame:
    return rollup.anchor_times(
        d.a_obs_hour, after=F.lit("2024-01-10 12:00:00").cast("timestamp")
    )


_ROLLUP_SQL = f"""
    with near as (select sensor_id, pm2_5, ts,
                         cast(date_trunc('hour', ts + interval 30 minute) as timestamp) as anchor
                  from a_sensor_minute),
    med as (select anchor, sensor_id, median(pm2_5) as con from near
            where abs(epoch_us(ts) - epoch_us(anchor)) < 600000000 group by 1, 2),
    r as (select anchor as ts, m.sensor_id as id, {_AQI_SQL.format(c='con')} as aqi, con, lon, lat
          from med m join a_sensor_place p on p.sensor_id = m.sensor_id)
    select ts, id, round(aqi, 5) as aqi, round(con, 6) as aqi_concentration, lon, lat
    from r where aqi is not null and aqi <> 0
"""


@check("hourly_rollup", _ROLLUP_SQL)
def _(d: Inputs) -> DataFrame:
    rolled = rollup.hourly_rollup(d.a_sensor_minute, d.a_sensor_place)
    return rounded(rounded(rolled, "aqi", places=5), "aqi_concentration")


@check(
    "rollup_pending",
    f"with recent as ({_ROLLUP_SQL} and ts > timestamp '2024-01-20 00:00:00' and ts in (select ts from a_obs_hour)) "
    "select 100 + row_number() over (order by ts, id) as uid, * from recent",
)
def _(d: Inputs) -> DataFrame:
    rolled = d.spark.sql("select 100L as uid, timestamp '2024-01-20 00:00:00' as ts")
    built = networks.roll_up_pending(
        d.a_sensor_minute, d.a_sensor_place, d.a_obs_hour.select("ts"), rolled
    )
    return rounded(rounded(built, "aqi", places=5), "aqi_concentration")


# ---------------------------------------------------------------- ingest


@check("latest_by_key", "select id, max(ts) as max_ts from a_sensor_minute group by 1")
def _(d: Inputs) -> DataFrame:
    return ingest.latest_by(d.a_sensor_minute)


def _split_feed(d: Inputs) -> tuple[DataFrame, DataFrame]:
    """(batch, stored): channel b readings arrive, channel a readings are stored."""
    rows = d.a_sensor_minute
    return rows.where("channel = 'b'"), rows.where("channel = 'a' and pm2_5 > 60")


@check(
    "drop_late",
    "select b.event_id, b.id, b.ts, b.pm2_5 from a_sensor_minute b left join (select id, max(ts) "
    "as last from a_sensor_minute where channel = 'a' and pm2_5 > 60 group by 1) s on s.id = b.id "
    "where b.channel = 'b' and (s.last is null or b.ts > s.last)",
)
def _(d: Inputs) -> DataFrame:
    batch, stored = _split_feed(d)
    return ingest.drop_late(batch, stored).select("event_id", "id", "ts", "pm2_5")


@check(
    "feed_ingest",
    f"with f as ({_FEED_SQL}) select f.id, f.ts, entry_id, pm2_5_atm, uptime, pm2_5_cf_1 from f "
    "left join (select user_id as id, max(ts) as last from events where value > 60 group by 1) s "
    "on s.id = f.id where s.last is null or f.ts > s.last",
)
def _(d: Inputs) -> DataFrame:
    stored = d.events.where("value > 60").select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")
    )
    fresh = networks.ingest_feed(feed_payloads(d), "payload", stored)
    return fresh.select("id", "ts", "entry_id", "pm2_5_atm", "uptime", "pm2_5_cf_1")


@check(
    "skip_seen",
    "select station_id, ts, round(value, 6) as value from a_obs_user "
    "where ts <> (select max(ts) from a_obs_user where value is null)",
)
def _(d: Inputs) -> DataFrame:
    rest = ingest.skip_seen(d.a_obs_user, d.a_obs_user.where("value is null"))
    return rounded(rest.select("station_id", "ts", "value"), "value")


@check(
    "surrogate_uid",
    "select event_id, row_number() over (order by ts, event_id) "
    "+ (select max(event_id) from events) as uid from events",
)
def _(d: Inputs) -> DataFrame:
    stored = d.events.select(F.col("event_id").alias("uid"))
    numbered = ingest.with_uid(
        d.events, ["ts", "event_id"], F.date_trunc("hour", "ts"), stored
    )
    return numbered.select("event_id", "uid")


_KNOWN = (
    "known as (select min(poi_id) as station_id, lon, lat from a_poi where p_size <= 25 "
    "group by 2, 3)"
)
_STATIONS = (
    f"{_KNOWN}, fresh as (select distinct lon, lat from a_poi p where not exists "
    "(select 1 from known k where k.lon = p.lon and k.lat = p.lat)), all_st as "
    "(select * from known union all select (select max(station_id) from known) + row_number() "
    "over (order by lon, lat), lon, lat from fresh)"
)


def _known_stations(d: Inputs) -> DataFrame:
    return d.sql(f"with {_KNOWN} select * from known")


@check("station_upsert", f"with {_STATIONS} select * from all_st")
def _(d: Inputs) -> DataFrame:
    return ingest.upsert_stations(d.a_poi, _known_stations(d))[1]


@check(
    "station_lookup",
    f"with {_STATIONS} select poi_id, station_id from a_poi p "
    "join all_st s on s.lon = p.lon and s.lat = p.lat",
)
def _(d: Inputs) -> DataFrame:
    return ingest.upsert_stations(d.a_poi, _known_stations(d))[0].select("poi_id", "station_id")


@check(
    "station_feed_ingest",
    """
    with known as (select 7 as station_id, lon, lat from a_station where station_id = 's4'),
    fresh as (select distinct lon, lat from a_station where station_id <> 's4'),
    st as (select * from known union all
           select 7 + row_number() over (order by lon, lat), lon, lat from fresh)
    select e.event_id, st.station_id::bigint as station_id,
           cast(date_trunc('hour', e.ts) as timestamp) as ts, e.value as concentration
    from events e join a_station s on s.station_id = concat('s', e.user_id % 12)
    join st on st.lon = s.lon and st.lat = s.lat
    where cast(date_trunc('minute', e.ts) as timestamp) <>
          (select max(date_trunc('minute', ts)) from events)
    """,
)
def _(d: Inputs) -> DataFrame:
    known = d.a_station.where("station_id = 's4'").select(
        F.lit(7).cast("long").alias("station_id"), "lon", "lat"
    )
    stored = d.events.select(F.date_trunc("minute", F.col("ts")).alias("ts"))
    rows, _ = networks.ingest_station_feed(station_lines(d), "line", known, stored)
    return rows.select("event_id", "station_id", "ts", "concentration")


# ---------------------------------------------------------------- sinks


@check(
    "nested_documents",
    "select ts as timestamp, row_number() over (partition by ts order by gid) - 1 as pos, "
    "gid, round(aqi, 6) as aqi from (select ts, cast(substr(station_id, 2) as integer) as gid, "
    "value as aqi from a_obs_day) o",
)
def _(d: Inputs) -> DataFrame:
    rows = d.a_obs_day.withColumn("gid", F.substring("station_id", 2, 9))
    nested = nest_by_time(rows, value_col="value")
    flat = nested.select("timestamp", F.posexplode("data").alias("pos", "item"))
    return flat.select(
        "timestamp", F.col("pos").cast("long").alias("pos"), "item.gid",
        F.round("item.aqi", 6).alias("aqi"),
    )


@check(
    "pending_times",
    "select distinct ts from a_obs_user where ts not in "
    "(select ts from a_obs_user where value is null)",
)
def _(d: Inputs) -> DataFrame:
    return pending_times(d.a_obs_user, d.a_obs_user.where("value is null"))
