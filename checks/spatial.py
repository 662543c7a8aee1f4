"""Checks of rings, ring contents, the study region, and feature tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.adapters import Inputs, _metres
from checks.registry import check
from checks.relational import _exploded, rounded
from sensorgrid.operators import features, spatial
from sensorgrid.operators.spread import spread
from sensorgrid.plans import networks

CORNERS = [(-118.6, 34.2), (-118.2, 33.8)]
_RINGS = "(select unnest(generate_series(100, 3000, 100)) as r) ring"


# ---------------------------------------------------------------- geometry


@check(
    "bbox_filter",
    "select poi_id, lon, lat from a_poi where lon between -118.6e0 and -118.2e0 "
    "and lat between 33.8e0 and 34.2e0",
)
def _(d: Inputs) -> DataFrame:
    return spatial.in_box(d.a_poi, CORNERS).select("poi_id", "lon", "lat")


@check(
    "bbox_filter_lines",
    "select line_id from a_line where least(x0, x1) <= -118.2e0 and greatest(x0, x1) >= -118.6e0 "
    "and least(y0, y1) <= 34.2e0 and greatest(y0, y1) >= 33.8e0",
)
def _(d: Inputs) -> DataFrame:
    return spatial.in_box(d.a_line, CORNERS, "lines").select("line_id")


@check("rings", f"select gid, lon, lat, r::integer as buffer_size from a_grid, {_RINGS}")
def _(d: Inputs) -> DataFrame:
    return spatial.rings(d.a_grid)


def _grid(d: Inputs) -> DataFrame:
    return d.a_grid.withColumnRenamed("gid", "id")


def _pois(d: Inputs) -> DataFrame:
    """The point layer; the given file is one split, so its rows are spread first."""
    return spread(d.a_poi, "poi_id")


def _lines(d: Inputs) -> DataFrame:
    return spread(d.a_line, "line_id")


_COUNT_SQL = (
    f"with pairs as (select g.gid, p.fclass, {_metres('g', 'p')} as dist "
    "from a_grid g, a_poi p where abs(g.lat - p.lat) < 0.03e0 and abs(g.lon - p.lon) < 0.05e0{box}) "
    "select gid as id, fclass as feature_type, r::integer as buffer_size, "
    "count(*)::double as value, 'count' as measurement "
    f"from pairs, {_RINGS} where dist <= r group by 1, 2, 3"
)


@check("ring_point_count", _COUNT_SQL.format(box=""))
def _(d: Inputs) -> DataFrame:
    return spatial.count_in_rings(_grid(d), _pois(d))


# metres east and north of the location g
def _plane_sql(x: str, y: str) -> tuple[str, str]:
    unit = "(radians(1e0) * 6371008.8e0)"
    return f"(({x} - g.lon) * cos(radians(g.lat)) * {unit})", f"(({y} - g.lat) * {unit})"


_AX, _AY = _plane_sql("s.x0", "s.y0")
_BX, _BY = _plane_sql("s.x1", "s.y1")
_LENGTH_SQL = (
    f"with seg as (select g.gid, s.fclass, {_AX} as ax, {_AY} as ay, {_BX} as bx, {_BY} as by_ "
    "from a_grid g, a_line s where least(s.y0, s.y1) < g.lat + 0.03e0 "
    "and greatest(s.y0, s.y1) > g.lat - 0.03e0 and least(s.x0, s.x1) < g.lon + 0.05e0 "
    "and greatest(s.x0, s.x1) > g.lon - 0.05e0), "
    "m as (select *, bx - ax as dx, by_ - ay as dy from seg), "
    "q as (select *, dx*dx + dy*dy as dd, ax*dx + ay*dy as ad, ax*ax + ay*ay as aa from m), "
    f"c as (select *, ad*ad - dd*(aa - r*r*1e0) as disc from q, {_RINGS} where dd > 0), "
    "l as (select gid, fclass, r, (least(1, greatest(0, (-ad + sqrt(disc)) / dd)) "
    "- least(1, greatest(0, (-ad - sqrt(disc)) / dd))) * sqrt(dd) as len from c where disc > 0) "
    "select gid as id, fclass as feature_type, r::integer as buffer_size, "
    "round(sum(len), 3) as value, 'length' as measurement "
    "from l group by 1, 2, 3 having sum(len) > 0"
)


@check("ring_line_length", _LENGTH_SQL)
def _(d: Inputs) -> DataFrame:
    return rounded(spatial.length_in_rings(_grid(d), _lines(d)), "value", places=3)


def _sector(ux: str, uy: str, vx: str, vy: str) -> str:
    return f"r*r/2e0 * atan2(({ux})*({vy}) - ({uy})*({vx}), ({ux})*({vx}) + ({uy})*({vy}))"


_AREA_SQL = (
    "with s as (select fclass, poi_id, unnest([{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y0}, "
    "{'x0': x1, 'y0': y0, 'x1': x1, 'y1': y1}, {'x0': x1, 'y0': y1, 'x1': x0, 'y1': y1}, "
    "{'x0': x0, 'y0': y1, 'x1': x0, 'y1': y0}]) as e, x0 as bx0, y0 as by0, x1 as bx1, y1 as by1 "
    "from a_box), "
    "s2 as (select fclass, poi_id, e.x0 as x0, e.y0 as y0, e.x1 as x1, e.y1 as y1, "
    "bx0, by0, bx1, by1 from s), "
    f"seg as (select g.gid, s.fclass, s.poi_id, {_AX} as ax, {_AY} as ay, {_BX} as bx, {_BY} as by_ "
    "from a_grid g, s2 s where s.by0 < g.lat + 0.03e0 and s.by1 > g.lat - 0.03e0 "
    "and s.bx0 < g.lon + 0.05e0 and s.bx1 > g.lon - 0.05e0), "
    "m as (select *, bx - ax as dx, by_ - ay as dy from seg), "
    "q as (select *, dx*dx + dy*dy as dd, ax*dx + ay*dy as ad, ax*ax + ay*ay as aa from m), "
    f"c as (select *, ad*ad - dd*(aa - r*r*1e0) as disc from q, {_RINGS}), "
    "t as (select *, case when disc > 0 then least(1, greatest(0, (-ad - sqrt(disc)) / dd)) end "
    "as t1, case when disc > 0 then least(1, greatest(0, (-ad + sqrt(disc)) / dd)) end as t2 from c), "
    f"o as (select gid, fclass, r, case when disc <= 0 then {_sector('ax', 'ay', 'bx', 'by_')} else "
    f"{_sector('ax', 'ay', 'ax+t1*dx', 'ay+t1*dy')} + ((ax+t1*dx)*(ay+t2*dy) - (ay+t1*dy)*(ax+t2*dx)) "
    f"/ 2 + {_sector('ax+t2*dx', 'ay+t2*dy', 'bx', 'by_')} end as part from t) "
    "select gid as id, fclass as feature_type, r::integer as buffer_size, "
    "round(sum(part), 1) as value, 'area' as measurement from o group by 1, 2, 3 "
    "having sum(part) > 0.05e0"
)


def _boxes(d: Inputs) -> DataFrame:
    corners = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return spread(d.a_box, "poi_id").select("poi_id", "fclass", spatial.box_rings(*corners).alias("rings"))


@check("ring_box_area", _AREA_SQL)
def _(d: Inputs) -> DataFrame:
    areas = spatial.area_in_rings(_grid(d), _boxes(d)).where("value > 0.05")
    return rounded(areas, "value", places=1)


@check(
    "geo_features",
    "select cast(id as varchar) as id, geo_feature, feature_type, buffer_size, value, measurement "
    "from ("
    "select *, 'pois' as geo_feature from ("
    + _COUNT_SQL.format(
        box=" and p.lon between -118.6e0 and -118.2e0 and p.lat between 33.8e0 and 34.2e0"
    )
    + ") p union all select *, 'roads' from ("
    + _LENGTH_SQL.replace(
        "from a_grid g, a_line s where",
        "from a_grid g, a_line s where least(s.x0, s.x1) <= -118.2e0 and greatest(s.x0, s.x1) "
        ">= -118.6e0 and least(s.y0, s.y1) <= 34.2e0 and greatest(s.y0, s.y1) >= 33.8e0 and",
    )
    + ") l) u",
)
def _(d: Inputs) -> DataFrame:
    layers = {"pois": ("points", _pois(d)), "roads": ("lines", _lines(d))}
    built = spatial.geo_features(_grid(d), layers, CORNERS)
    return built.withColumn(
        "value",
        F.when(F.col("measurement") == "length", F.round("value", 3)).otherwise(F.col("value")),
    )


# integer lattice points: orientation tests are exact, so the hull is too
_LATTICE = "lattice as (select distinct c_custkey * 31 % 113 as x, c_custkey * 17 % 109 as y from customer)"
_GAP = (
    "select {key}, max(gap) as widest from (select {key}, coalesce(lead(ang) over w, "
    "min(ang) over (partition by {key}) + 2 * pi()) - ang as gap "
    "from {angles} window w as (partition by {key} order by ang)) group by {key}"
)


@check(
    "convex_hull",
    f"with {_LATTICE}, ang as (select p.x, p.y, atan2(q.y - p.y, q.x - p.x) as ang "
    "from lattice p join lattice q on p.x <> q.x or p.y <> q.y), "
    f"wide as ({_GAP.format(key='x, y', angles='ang')}) "
    "select x::double as x, y::double as y from wide where widest > pi() + 1e-9",
)
def _(d: Inputs) -> DataFrame:
    points = d.sql(f"with {_LATTICE} select * from lattice")
    return spatial.region_hull(points, "x", "y").select(F.inline("hull"))


@check(
    "inside_region",
    "with ang as (select p.poi_id, atan2(g.lat - p.lat, g.lon - p.lon) as ang "
    "from a_poi p cross join a_grid g), "
    f"wide as ({_GAP.format(key='poi_id', angles='ang')}) "
    "select poi_id from wide where widest < pi() - 1e-12",
)
def _(d: Inputs) -> DataFrame:
    return networks.sensors_in_region(d.a_poi, d.a_grid).select("poi_id")


_OUTLINE = [(-118.8, 33.8), (-118.0, 33.9), (-118.3, 34.1), (-118.05, 34.4), (-118.7, 34.3)]


def _crossings_sql() -> str:
    closed = list(zip(_OUTLINE, _OUTLINE[1:] + _OUTLINE[:1]))
    return " + ".join(
        f"(case when ({ay}e0 > lat) <> ({by}e0 > lat) and "
        f"lon < {ax}e0 + (lat - {ay}e0) * ({bx}e0 - {ax}e0) / ({by}e0 - {ay}e0) then 1 else 0 end)"
        for (ax, ay), (bx, by) in closed
    ).replace("- -", "+ ").replace("(-", "(0-")


@check("inside_polygon", f"select poi_id from a_poi where ({_crossings_sql()}) % 2 = 1")
def _(d: Inputs) -> DataFrame:
    corners = ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in _OUTLINE)
    outline = d.spark.sql(f"select array({corners}) as outline")
    return spatial.inside_polygon(d.a_poi, outline).select("poi_id")


# ---------------------------------------------------------------- feature tables

_KEY = "concat_ws('_', geo_feature, feature_type, buffer_size)"


@check(
    "feature_key",
    f"select id, {_KEY} as feature, value from a_eav",
)
def _(d: Inputs) -> DataFrame:
    return features.keyed(d.a_eav)


@check(
    "feature_names",
    f"select feature, row_number() over (order by feature) - 1 as index from "
    f"(select distinct {_KEY} as feature from a_eav) k",
)
def _(d: Inputs) -> DataFrame:
    return features.feature_names(features.keyed(d.a_eav))


_SCALARS = (
    "select cast(gid as varchar) as id, 'location' as geo_feature, unnest(['longitude', "
    "'latitude', 'elevation']) as feature_type, 0 as buffer_size, unnest([lon, lat, "
    "(gid % 500) * 1.0e0]) as value from a_grid"
)


def _scalar_features(d: Inputs) -> DataFrame:
    located = d.a_grid.withColumn("elevation", F.col("gid") % 500 * F.lit(1.0))
    columns = {"longitude": "lon", "latitude": "lat", "elevation": "elevation"}
    return features.scalar_layers(located, columns, "gid")


@check("scalar_layers", _SCALARS)
def _(d: Inputs) -> DataFrame:
    return _scalar_features(d)


@check(
    "union_layers",
    f"select * from ({_SCALARS}) s union all "
    "select id, geo_feature, feature_type, buffer_size, value from a_eav",
)
def _(d: Inputs) -> DataFrame:
    return features.union_layers({"location": _scalar_features(d), "land": d.a_eav})


@check(
    "eav_vector",
    f"with k as (select feature, row_number() over (order by feature) - 1 as pos from "
    f"(select distinct {_KEY} as feature from a_eav) n), "
    f"v as (select id, {_KEY} as feature, avg(value) as value from a_eav "
    "where value > 1000 group by 1, 2), "
    "i as (select distinct concat('s', s_suppkey % 15) as id from supplier) "
    "select i.id, k.pos, round(coalesce(v.value, 0), 6) as value from i cross join k "
    "left join v on v.id = i.id and v.feature = k.feature",
)
def _(d: Inputs) -> DataFrame:
    keyed = features.keyed(d.a_eav)
    ids = d.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey") % 15).alias("id"))
    vectors = features.to_vector(keyed.where("value > 1000"), ids, features.feature_names(keyed))
    return _exploded(vectors, "id", "features")


@check(
    "eav_pivot",
    "select id, " + ", ".join(
        f"round(avg(case when {_KEY} = '{r}_{s}_{n}' then value end), 6) as {r}_{s}_{n}"
        for r in "ANR" for s in "FO" for n in range(100, 800, 100)
    ) + " from a_eav group by 1",
)
def _(d: Inputs) -> DataFrame:
    names = [f"{r}_{s}_{n}" for r in "ANR" for s in "FO" for n in range(100, 800, 100)]
    return rounded(features.pivot_wide(features.keyed(d.a_eav), names), *names)


_NONZERO = "nz as (select feature, importance from a_importance where importance <> 0)"


@check("features_nonzero", f"with {_NONZERO} select * from nz")
def _(d: Inputs) -> DataFrame:
    return features.select_features(d.a_importance)


@check("features_sorted", f"with {_NONZERO} select * from nz order by importance desc, feature")
def _(d: Inputs) -> DataFrame:
    return features.sorted_features(d.a_importance)


@check(
    "features_top_frac",
    f"with {_NONZERO} select feature, importance from (select *, row_number() over "
    "(order by importance desc, feature) as rank from nz) r "
    "where rank <= floor(0.05e0 * (select count(*) from nz))",
)
def _(d: Inputs) -> DataFrame:
    return features.select_features(d.a_importance, "top_frac", frac=0.05)


@check(
    "features_mean_factor",
    f"with {_NONZERO} select * from nz "
    "where importance > 1.8e0 * (select avg(importance) from nz)",
)
def _(d: Inputs) -> DataFrame:
    return features.select_features(d.a_importance, "mean_factor")


@check(
    "nonzero_mean",
    f"with {_NONZERO} select round(avg(importance), 6) as mean from nz",
)
def _(d: Inputs) -> DataFrame:
    kept = features.select_features(d.a_importance)
    return kept.agg(F.round(F.avg("importance"), 6).alias("mean"))


@check(
    "assemble_zero_fill",
    "select station_id, ts, round(coalesce(value, 0), 6) as v0, "
    "epoch(ts)::double as v1 from a_obs_hour",
)
def _(d: Inputs) -> DataFrame:
    timed = d.a_obs_hour.withColumn("unix", F.unix_timestamp("ts").cast("double"))
    assembled = features.assemble(timed, ["value", "unix"]).withColumn(
        "cells", vector_to_array(F.col("features"))
    )
    return assembled.select(
        "station_id", "ts", F.round(F.get("cells", F.lit(0)), 6).alias("v0"),
        F.get("cells", F.lit(1)).alias("v1"),
    )


@check(
    "standard_scale",
    "with e as (select vec_id, unnest(embedding)::double as x, "
    "generate_subscripts(embedding, 1) - 1 as pos from embeddings), "
    "m as (select pos, avg(x) as mean, stddev_samp(x) as sd from e group by 1) "
    "select vec_id, pos, round(case when sd > 0 then (x - mean) / sd else 0 end, 5) as value "
    "from e join m using (pos)",
)
def _(d: Inputs) -> DataFrame:
    wide = d.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    scaled = features.as_scaled_vector(wide, "x")
    cells = scaled.select("vec_id", F.posexplode(vector_to_array("scaled")).alias("pos", "value"))
    return cells.select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value")
    )
