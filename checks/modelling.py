"""Checks of models, prediction pipelines and streams. Models have no SQL counterpart."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.adapters import Inputs
from checks.registry import check
from checks.relational import rounded
from sensorgrid import shared_dir
from sensorgrid.operators import (
    features,
    fold_clusters,
    fold_importance,
    models,
    panel,
    windows,
)
from sensorgrid.plans import grid
from sensorgrid.streaming import (
    dedupe_stream,
    hourly_median_stream,
    stream_drop_late,
    write_stream,
)

_SETTINGS = grid.Settings(k=4, importance_trees=20, n_trees=20)


def _panel(d: Inputs) -> DataFrame:
    return panel.series(windows.fill_gaps(d.a_obs_day))


def _vectors(d: Inputs) -> tuple[DataFrame, DataFrame]:
    keyed = features.keyed(d.a_eav)
    names = features.feature_names(keyed)
    ids = d.a_station.select(F.col("station_id").alias("id"))
    return features.to_vector(keyed, ids, names), names


def _folds(d: Inputs) -> DataFrame:
    """Every station left out once, and nobody."""
    nobody = d.spark.sql("select cast(null as string) as fold")
    return d.a_station.select(F.col("station_id").alias("fold")).unionByName(nobody)


@check("pca")
def _(d: Inputs) -> DataFrame:
    wide = d.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    scaled = features.as_scaled_vector(wide, "x")
    projected, _ = features.pca(scaled, "scaled", 3, "projected")
    return projected.select("vec_id", vector_to_array("projected").alias("projected"))


@check("kmeans")
def _(d: Inputs) -> DataFrame:
    return models.cluster(_panel(d), k=4)[0].select("station_id", "cluster")


@check("k_sweep")
def _(d: Inputs) -> DataFrame:
    return models.k_sweep(_panel(d), ks=range(2, 11), folds=_folds(d))


@check(
    "k_sweep_one",
    "with lab as (select station_id, ts, coalesce(value, median(value) over (partition by "
    "station_id order by epoch(ts)::bigint range between 10800 preceding and current row)) as "
    "label from a_obs_day), slots as (select station_id, ts, coalesce(avg(label), 0) as x from lab "
    "group by 1, 2), kept as (select * from slots where ts in (select ts from slots group by ts "
    "having count(*) = (select count(distinct station_id) from slots))), folds as (select "
    "station_id as fold from a_station union all select null), m as (select fold, ts, avg(x) as m, "
    "stddev_samp(x) as sd, min(x) as lo, max(x) as hi from folds join kept on fold is null or "
    "station_id <> fold group by 1, 2) select m.fold, cast(1 as integer) as k, round(sum(case when "
    "lo < hi then pow((x - m) / sd, 2) else 0 end), 4) as cost from m join kept k on k.ts = m.ts "
    "and (fold is null or station_id <> fold) group by 1",
)
def _(d: Inputs) -> DataFrame:
    """With one cluster the error is the sum of squares of the scaled series."""
    return rounded(models.k_sweep(_panel(d), [1], _folds(d)), "cost", places=4)


_STUMP = (
    "with names as (select feature, row_number() over (order by feature) - 1 as j from (select "
    "distinct geo_feature || '_' || feature_type || '_' || buffer_size as feature from a_eav) q), "
    "cells as (select s.station_id as id, n.j, coalesce(v.value, 0) as x, "
    "cast(substr(s.station_id, 2) as integer) % 3 as y from a_station s cross join names n left join "
    "(select id, geo_feature || '_' || feature_type || '_' || buffer_size as feature, value from "
    "a_eav) v on v.id = s.station_id and v.feature = n.feature), "
    "rows as (select f.station_id as fold, c.* from a_station f join cells c on c.id <> f.station_id), "
    "cuts as (select distinct j, x as t from cells), "
    "sides as (select fold, r.j, t, r.x <= t as low, y, count(*) as c from rows r join cuts u "
    "on u.j = r.j group by 1, 2, 3, 4, 5), "
    "pure as (select fold, j, t, low, sum(c) as n, sum(c * c) / sum(c) as p from sides group by "
    "1, 2, 3, 4), "
    "base as (select fold, sum(c * c) / sum(c) as p from (select fold, y, count(*) as c from rows "
    "where j = 0 group by 1, 2) q group by 1), "
    "gains as (select s.fold, j, t, round(sum(s.p) - any_value(b.p), 6) as gain from pure s join "
    "base b on b.fold = s.fold group by 1, 2, 3), "
    "best as (select *, row_number() over (partition by fold order by gain desc, j, t) as rank "
    "from gains where gain > 0) "
    "select fold, cast(j as integer) as feature, t as threshold, gain from best where rank = 1"
)


@check("importance_stumps", _STUMP)
def _(d: Inputs) -> DataFrame:
    """One split over all features and rows: the largest drop of the Gini impurity."""
    vectors, _ = _vectors(d)
    stations = d.a_station.select("station_id")
    label = F.col("id").substr(2, 9).cast("int") % 3
    labels = stations.select(F.col("station_id").alias("fold")).join(
        stations.select(F.col("station_id").alias("id")), F.col("fold") != F.col("id")
    ).withColumn("cluster", label)
    splits = fold_importance.forest_splits(
        vectors, labels, n_trees=1, max_depth=1, bagging=False, every_feature=True
    )
    return rounded(splits.select("fold", "feature", "threshold", "gain"), "gain")


@check("importance_folds")
def _(d: Inputs) -> DataFrame:
    vectors, names = _vectors(d)
    clusters = fold_clusters.cluster_folds(_panel(d), _folds(d).withColumn("k", F.lit(4)))
    return fold_importance.importance_folds(vectors, clusters, names, n_trees=20)


@check("importance")
def _(d: Inputs) -> DataFrame:
    vectors, names = _vectors(d)
    clusters, _ = models.cluster(_panel(d), k=4)
    return models.importance(vectors, clusters, names, n_trees=50)


def _contexts(d: Inputs) -> tuple[DataFrame, DataFrame]:
    vectors, names = _vectors(d)
    targets = d.a_grid.select(F.col("gid").alias("id"))
    return vectors, features.to_vector(features.keyed(d.a_eav_grid), targets, names)


def _labels(d: Inputs) -> DataFrame:
    return windows.fill_gaps(d.a_obs_day)


@check("predict_rf")
def _(d: Inputs) -> DataFrame:
    context, targets = _contexts(d)
    return models.predict(_labels(d), context, targets, "rf", n_trees=20)


@check("predict_gbt")
def _(d: Inputs) -> DataFrame:
    context, targets = _contexts(d)
    return models.predict(_labels(d), context, targets, "gbt", n_trees=20)


@check("predict_once_rf")
def _(d: Inputs) -> DataFrame:
    context, targets = _contexts(d)
    latest = _labels(d).where(F.col("ts") == d.a_obs_day.agg(F.max("ts")).scalar())
    return models.predict_once(latest, context, targets, "rf", n_trees=20)


@check("predict_once_gbt")
def _(d: Inputs) -> DataFrame:
    context, targets = _contexts(d)
    latest = _labels(d).where(F.col("ts") == d.a_obs_day.agg(F.max("ts")).scalar())
    return models.predict_once(latest, context, targets, "gbt", n_trees=10)


_GRID_ROWS = (
    "select cast(g.gid as varchar) as gid, t.ts, g.lon, g.lat from a_grid g, "
    "(select ts from a_obs_day group by ts having count(*) >= "
    "floor(0.75e0 * (select count(distinct station_id) from a_obs_day)) {latest}) t"
)


# A boosted ensemble of depth 0 predicts the mean of its labels, which SQL can tell.
_MEAN = grid.Settings(k=4, importance_trees=5, model="gbt", n_trees=1, max_depth=0)
_LABELLED = (
    "with lab as (select station_id, ts, coalesce(value, median(value) over (partition by "
    "station_id order by epoch(ts)::bigint range between 10800 preceding and current row)) "
    "as label from {obs}) "
)


def _every(df: DataFrame):
    """The time range of the data."""
    return df.agg(F.min("ts")).scalar(), df.agg(F.max("ts")).scalar()


@check(
    "predict_gbt_mean",
    _LABELLED.format(obs="a_obs_day") + "select cast(g.gid as varchar) as id, t.ts, t.prediction "
    "from a_grid g, (select ts, round(avg(label), 6) as prediction from lab where label is not "
    "null group by 1) t",
)
def _(d: Inputs) -> DataFrame:
    context, targets = _contexts(d)
    found = models.predict(_labels(d), context, targets, "gbt", n_trees=1, max_depth=0)
    return rounded(found, "prediction")


@check(
    "predict_gbt_stump",
    "with g as (select o.ts, s.lat as x, count(*) as n, sum(o.value) as y from a_obs_day o "
    "join a_station s using (station_id) where o.value is not null group by 1, 2), "
    "c as (select ts, x, lead(x) over (partition by ts order by x) as up, "
    "sum(n) over (partition by ts order by x rows unbounded preceding) as n, "
    "sum(y) over (partition by ts order by x rows unbounded preceding) as y, "
    "sum(n) over (partition by ts) as all_n, sum(y) over (partition by ts) as all_y from g), "
    "e as (select *, case when up is not null then y * y / n + "
    "(all_y - y) * (all_y - y) / (all_n - n) - all_y * all_y / all_n end as gain from c), "
    "b as (select *, row_number() over (partition by ts order by gain desc nulls last, x) as nth "
    "from e) "
    "select cast(g.gid as varchar) as id, b.ts, round(case when b.gain is null or b.gain <= 1e-12 "
    "then b.all_y / b.all_n when g.lat <= (b.x + b.up) / 2 then b.y / b.n "
    "else (b.all_y - b.y) / (b.all_n - b.n) end, 6) as prediction "
    "from a_grid g, b where b.nth = 1",
)
def _(d: Inputs) -> DataFrame:
    """One tree of one split on the latitude."""
    context = d.a_station.select(F.col("station_id").alias("id"), F.array("lat").alias("features"))
    targets = d.a_grid.select(F.col("gid").cast("string").alias("id"), F.array("lat").alias("features"))
    found = models.predict(
        d.a_obs_day, context, targets, "gbt", n_trees=1, max_depth=1, label_col="value"
    )
    return rounded(found, "prediction")


@check(
    "predict_grid_mean",
    _LABELLED.format(obs="a_obs_day") + "select cast(g.gid as varchar) as gid, t.ts, g.lon, g.lat, "
    "t.prediction from a_grid g, (select ts, round(avg(label), 6) as prediction from lab group by "
    "ts having count(*) >= floor(0.75e0 * (select count(distinct station_id) from lab)) "
    "and count(label) > 0) t",
)
def _(d: Inputs) -> DataFrame:
    found = grid.predict_grid(
        d.a_obs_day, d.a_eav, d.a_eav_grid, d.a_grid, _every(d.a_obs_day), settings=_MEAN
    )
    return rounded(found, "prediction")


@check(
    "cross_validate_mean",
    _LABELLED.format(obs="a_obs_day") + "select o.station_id, o.ts, round(o.value, 6) as truth, "
    "round(avg(l.label), 6) as prediction from a_obs_day o join lab l on l.ts = o.ts and "
    "l.station_id <> o.station_id group by 1, 2, o.value having count(*) >= 10 and count(l.label) > 0",
)
def _(d: Inputs) -> DataFrame:
    tuned = d.a_station.select("station_id", (F.length("station_id") + 1).alias("k"))
    found, _ = grid.cross_validate(d.a_obs_day, d.a_eav, k_by_station=tuned, settings=_MEAN)
    return rounded(found.select("station_id", "ts", "truth", "prediction"), "truth", "prediction")


@check(
    "validate_against_mean",
    _LABELLED.format(obs="a_obs_day_even") + "select o.station_id as id, o.ts, round(o.value, 6) as "
    "truth, t.prediction from a_obs_day_odd o join (select ts, round(avg(label), 6) as prediction "
    "from lab group by 1 having count(*) >= 10 and count(label) > 0) t on t.ts = o.ts",
)
def _(d: Inputs) -> DataFrame:
    truth = d.a_obs_day_odd.withColumnRenamed("station_id", "id")
    found, _ = grid.validate_against(
        d.a_obs_day_even, d.a_eav24, truth, d.a_eav24, min_support=10, settings=_MEAN
    )
    return rounded(found.select("id", "ts", "truth", "prediction"), "truth", "prediction")


_SENSOR_DAY = (
    "select sensor_id, id, channel, cast(date_trunc('day', ts) as timestamp) as ts, "
    "avg(pm2_5) as value from a_sensor_minute group by 1, 2, 3, 4"
)
_AGAINST = (
    _LABELLED.format(obs="a_obs_day") + "select cast(o.id as varchar) as id, o.ts, "
    "round(o.value, 6) as truth, t.prediction from ({truth}) o join (select ts, "
    "round(avg(label), 6) as prediction from lab group by 1 having count(*) >= 10 "
    "and count(label) > 0) t on t.ts = o.ts"
)


def _against_sensors(d: Inputs, **options) -> DataFrame:
    readings = d.sql(_SENSOR_DAY).select("sensor_id", "ts", "value")
    found, _ = grid.validate_against_sensors(
        d.a_obs_day, d.a_eav, readings, d.a_directory, d.a_eav_sensor, settings=_MEAN, **options
    )
    return rounded(found.select("id", "ts", "truth", "prediction"), "truth", "prediction")


@check(
    "validate_against_merged",
    _AGAINST.format(truth=f"select id, ts, max(value) as value from ({_SENSOR_DAY}) s group by 1, 2"),
)
def _(d: Inputs) -> DataFrame:
    return _against_sensors(d, merge="max")


@check(
    "validate_against_near",
    _AGAINST.format(
        truth=f"select s.id, s.ts, s.value from ({_SENSOR_DAY}) s join a_near n on n.id = s.id "
        "where s.channel <> 'b' and n.distance <= 50"
    ),
)
def _(d: Inputs) -> DataFrame:
    return _against_sensors(d, exclude="b", near=d.a_near, max_dist=50)


@check(
    "kmeans_nearest",
    "select station_id, true as nearest from a_station",
)
def _(d: Inputs) -> DataFrame:
    """The centre (mean of the members) of a station's own cluster is its nearest."""
    rows = features.as_scaled_vector(models.cluster(_panel(d), k=4)[0].drop("scaled"), "series")
    flat = rows.select("station_id", "cluster", F.posexplode(vector_to_array("scaled")).alias("i", "x"))
    centres = flat.groupBy(F.col("cluster").alias("c"), "i").agg(F.avg("x").alias("m"))
    apart = flat.join(centres, "i").groupBy("station_id", "cluster", "c").agg(
        F.sum(F.pow(F.col("x") - F.col("m"), 2)).alias("gap")
    )
    best = apart.groupBy("station_id").agg(
        F.min("gap").alias("least"), F.min(F.when(F.col("c") == F.col("cluster"), F.col("gap"))).alias("own")
    )
    return best.select("station_id", (F.col("own") <= F.col("least") + 1e-6).alias("nearest"))


@check(
    "pca_norms",
    "with n as (select count(*) as k, len(any_value(embedding)) as dims from embeddings), x as ("
    "select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from "
    "embeddings), s as (select i, avg(v) as m, stddev_samp(v) as sd from x group by 1) "
    "select vec_id, round(sum(pow(case when sd > 0 then (v - m) / sd else 0 end, 2)), 4) as norm "
    "from x join s using (i) group by 1",
)
def _(d: Inputs) -> DataFrame:
    """A projection on all components keeps the squared length of every row."""
    wide = d.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    dims = wide.select(F.size("x")).first()[0]
    projected, _ = features.pca(features.as_scaled_vector(wide, "x"), "scaled", dims, "projected")
    squares = F.aggregate(
        vector_to_array("projected"), F.lit(0.0), lambda total, v: total + v * v
    )
    return rounded(projected.select("vec_id", squares.alias("norm")), "norm", places=4)


@check("predict_grid")
def _(d: Inputs) -> DataFrame:
    every = _every(d.a_obs_day)
    return grid.predict_grid(
        d.a_obs_day, d.a_eav, d.a_eav_grid, d.a_grid, every, settings=_SETTINGS
    )


@check("predict_grid_keys", _GRID_ROWS.format(latest=""))
def _(d: Inputs) -> DataFrame:
    every = _every(d.a_obs_day)
    settings = grid.Settings(k=4, importance_trees=5, n_trees=2)
    return grid.predict_grid(
        d.a_obs_day, d.a_eav, d.a_eav_grid, d.a_grid, every, settings=settings
    ).select("gid", "ts", "lon", "lat")


@check("predict_grid_latest")
def _(d: Inputs) -> DataFrame:
    return grid.predict_grid(
        d.a_obs_day, d.a_eav, d.a_eav_grid, d.a_grid, "latest", settings=_SETTINGS
    )


@check("cross_validate")
def _(d: Inputs) -> DataFrame:
    return grid.cross_validate(d.a_obs_day, d.a_eav, settings=_SETTINGS)[1]


@check(
    "cross_validate_truth",
    "select station_id, ts, round(value, 6) as truth from a_obs_day o where (select count(*) from "
    "a_obs_day p where p.ts = o.ts and p.station_id <> o.station_id) >= 10",
)
def _(d: Inputs) -> DataFrame:
    settings = grid.Settings(k=4, importance_trees=5, n_trees=2)
    result, _ = grid.cross_validate(d.a_obs_day, d.a_eav, settings=settings)
    return rounded(result.select("station_id", "ts", "truth"), "truth")


@check("validate_against")
def _(d: Inputs) -> DataFrame:
    truth = d.a_obs_day_odd.withColumnRenamed("station_id", "id")
    return grid.validate_against(
        d.a_obs_day_even, d.a_eav24, truth, d.a_eav24, min_support=10, settings=_SETTINGS
    )[1]


@check("predict_grid_network")
def _(d: Inputs) -> DataFrame:
    day = d.a_sensor_minute.select(
        "sensor_id", F.date_trunc("day", "ts").alias("ts"), F.col("pm2_5").alias("value")
    )
    settings = grid.Settings(k=4, importance_trees=20, n_trees=20, rule="mean_factor")
    every = _every(day)
    return grid.predict_grid_network(
        day, d.a_directory, d.a_eav_sensor.unionByName(d.a_eav), d.a_eav_grid, d.a_grid,
        extra_obs=d.a_obs_day, tolerance=31, when=every, min_support=40, settings=settings,
    )


# ---------------------------------------------------------------- streams


def _stream(d: Inputs) -> DataFrame:
    """The events as a file stream, timestamps in session time."""
    schema = d.events.schema
    rows = d.spark.readStream.schema(schema).parquet(f"{d.sf_dir}/events*.parquet")
    return rows.select(
        "event_id", F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("pm2_5"), "event_type",
    )


@check(
    "stream_drop_late",
    "select event_id, e.user_id as id, ts, value as pm2_5, event_type from events e left join "
    "(select user_id, max(ts) as last from events where value > 60 group by 1) s "
    "on s.user_id = e.user_id where s.last is null or e.ts > s.last",
)
def _(d: Inputs) -> DataFrame:
    folder = shared_dir(d.spark, "drop-late")
    stored = d.events.where("value > 60").select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")
    )
    stream = _stream(d)
    stream_drop_late(stream, folder, f"{folder}/checkpoint", stored).awaitTermination()
    return d.spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)


@check(
    "stream_hourly_median",
    "select anchor, user_id as id, round(median(value), 6) as median from (select *, "
    "cast(date_trunc('hour', ts + interval 30 minute) as timestamp) as anchor from events) e "
    "where abs(epoch_us(ts) - epoch_us(anchor)) < 600000000 and anchor + interval 30 minute <= "
    "(select max(ts) - interval 10 minute from events) group by 1, 2",
)
def _(d: Inputs) -> DataFrame:
    folder = shared_dir(d.spark, "hourly")
    medians = hourly_median_stream(_stream(d), "id")
    write_stream(medians, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return rounded(d.spark.read.schema(medians.schema).parquet(f"{folder}/rows"), "median")


@check(
    "stream_dedupe",
    "select distinct user_id as id, cast(date_trunc('hour', ts) as timestamp) as ts from events",
)
def _(d: Inputs) -> DataFrame:
    folder = shared_dir(d.spark, "dedupe")
    pulls = _stream(d).select("id", F.date_trunc("hour", "ts").alias("ts"))
    once = dedupe_stream(pulls, ["id", "ts"])
    write_stream(once, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return d.spark.read.schema(once.schema).parquet(f"{folder}/rows")
