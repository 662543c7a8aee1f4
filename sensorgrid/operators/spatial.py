"""Rings around locations, what lies inside them, and the study region.

Locations are (id, lon, lat). Layers carry `fclass` and
  points    lon, lat
  lines     x0, y0, x1, y1 (one straight piece per row, see `segments`)
  polygons  rings: array<struct<hole: boolean, points: array<struct<x, y>>>>
Circles are exact. Point distances are great-circle; lengths and areas are taken in
a metre plane around the location, which is accurate to well under a per mille at
ring sizes of a few kilometres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.functions import EARTH_RADIUS_M, haversine
from sensorgrid.functions.geo import wkt_lat, wkt_lon, wkt_paths, wkt_rings
from sensorgrid.operators.cells import HALVINGS, SQUARES, CellGrid
from sensorgrid.operators.fold_tiles import cut
from sensorgrid.operators.ring_blocks import DEALT, PACKED, deal, pack
from sensorgrid.operators.ring_sums import ring_values
from sensorgrid.operators.spread import spread

_M_PER_DEGREE = math.radians(1) * EARTH_RADIUS_M
# square metres; the edge sum of a polygon outside a ring is zero up to rounding
_AREA_NOISE = 1e-6
#: Rows or edges of a layer, and locations, that one group may hold, and their product
LAYER_ROWS = 1_000_000
LOT_ROWS = 8_000
GROUP_PAIRS = 3_000_000_000
MEASUREMENTS = {"points": "count", "lines": "length", "polygons": "area"}


def ring_sizes(step: int = 100, max_radius: int = 3000) -> list[int]:
    """Radii of the rings in metres; the last one reaches `max_radius` or just beyond."""
    return list(range(step, max_radius + step, step))


def rings(locations: DataFrame, step: int = 100, max_radius: int = 3000) -> DataFrame:
    """Every location once per ring, with `buffer_size`; the circle stays implicit."""
    sizes = F.array(*[F.lit(r) for r in ring_sizes(step, max_radius)])
    return locations.withColumn("buffer_size", F.explode(sizes))


def in_box(
    df: DataFrame,
    corners: Sequence[Sequence[float]],
    kind: str = "points",
) -> DataFrame:
    """Shapes that touch the box given by two opposite corners, borders included.

    `kind` is points, lines (straight pieces), polygons or paths (whole polylines, so that
    a kept one keeps its parts outside the box; cut it with `segments` afterwards).
    """
    xs = sorted(c[0] for c in corners)
    ys = sorted(c[1] for c in corners)
    if kind == "points":
        return df.where(F.col("lon").between(*xs) & F.col("lat").between(*ys))
    boxed = with_bounds(df, kind)
    overlap = (
        (F.col("min_x") <= xs[1]) & (F.col("max_x") >= xs[0])
        & (F.col("min_y") <= ys[1]) & (F.col("max_y") >= ys[0])
    )
    return boxed.where(overlap).drop("min_x", "max_x", "min_y", "max_y")


def with_bounds(df: DataFrame, kind: str) -> DataFrame:
    """Add min_x, max_x, min_y, max_y."""
    if kind == "lines":
        return (
            df.withColumn("min_x", F.least("x0", "x1")).withColumn("max_x", F.greatest("x0", "x1"))
            .withColumn("min_y", F.least("y0", "y1")).withColumn("max_y", F.greatest("y0", "y1"))
        )
    if kind == "paths":
        corners = F.col("path")
    else:
        corners = F.flatten(F.transform("rings", lambda ring: ring.getField("points")))
    xs = F.transform(corners, lambda p: p.getField("x"))
    ys = F.transform(corners, lambda p: p.getField("y"))
    return (
        df.withColumn("min_x", F.array_min(xs)).withColumn("max_x", F.array_max(xs))
        .withColumn("min_y", F.array_min(ys)).withColumn("max_y", F.array_max(ys))
    )


def segments(lines: DataFrame, path: str = "path") -> DataFrame:
    """Cut polylines (`path`: array<struct<x, y>>) into straight pieces."""
    last = F.size(path) - 1
    pieces = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.struct(
            F.get(F.col(path), i - 1).getField("x").alias("x0"),
            F.get(F.col(path), i - 1).getField("y").alias("y0"),
            F.get(F.col(path), i).getField("x").alias("x1"),
            F.get(F.col(path), i).getField("y").alias("y1"),
        ),
    )
    others = [c for c in lines.columns if c != path]
    return lines.where(last >= 1).select(*others, F.inline(pieces))


def box_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """`rings` value of an axis-parallel box."""
    def corner(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    outline = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))
    return F.array(F.struct(F.lit(False).alias("hole"), outline.alias("points")))


def distances(locations: DataFrame, points: DataFrame, max_radius: float) -> DataFrame:
    """Every (location, point) up to `max_radius` metres apart, with `distance`."""
    grid = CellGrid(max_radius)
    centres = locations.select("id", F.col("lon").alias("loc_lon"), F.col("lat").alias("loc_lat"))
    near = grid.near_points(spread(centres, "id"), points, "loc_lon", "loc_lat")
    apart = haversine(F.col("loc_lon"), F.col("loc_lat"), F.col("lon"), F.col("lat"))
    return near.withColumn("distance", apart).where(F.col("distance") <= max_radius).drop(
        "loc_lon", "loc_lat"
    )


def count_in_rings(
    locations: DataFrame, points: DataFrame, step: int = 100, max_radius: int = 3000
) -> DataFrame:
    """(id, feature_type, buffer_size, value, measurement): points per class and ring.

    Each distance is computed once and counted in the smallest ring that holds it.
    """
    return _in_rings(locations, _boxed_points(points), step, max_radius, "points")


def length_in_rings(
    locations: DataFrame, lines: DataFrame, step: int = 100, max_radius: int = 3000
) -> DataFrame:
    """(id, feature_type, buffer_size, value, measurement): metres of line per class and ring.

    A piece is clipped only by the rings that cut it; from the first ring that holds
    it whole it counts with its full length.
    """
    return _in_rings(locations, _boxed_lines(lines), step, max_radius, "lines")


def area_in_rings(
    locations: DataFrame,
    polygons: DataFrame,
    step: int = 100,
    max_radius: int = 3000,
    unit: str = "m2",
) -> DataFrame:
    """(id, feature_type, buffer_size, value, measurement): polygon area per class and ring.

    `unit` is 'm2' or 'deg2'. From the first ring that holds a polygon whole it counts
    with its area. For the rings that cut it the overlap is the sum over its edges of the
    signed area between centre and edge inside the circle, so edges are rows and only
    sums are shuffled.
    """
    if unit not in ("m2", "deg2"):
        raise ValueError("unit must be 'm2' or 'deg2'")
    return _in_rings(locations, _boxed_polygons(polygons), step, max_radius, "polygons", unit)


def _boxed_points(points: DataFrame) -> DataFrame:
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    return points.where(F.col("fclass").isNotNull()).select(
        "fclass", lon.alias("min_x"), lon.alias("max_x"), lat.alias("min_y"), lat.alias("max_y")
    )


def _boxed_lines(lines: DataFrame) -> DataFrame:
    corners = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    pieces = lines.where(F.col("fclass").isNotNull()).select("fclass", *corners)
    return with_bounds(pieces.dropna(), "lines")


def _boxed_polygons(polygons: DataFrame) -> DataFrame:
    boxed = with_bounds(
        polygons.where(F.col("fclass").isNotNull()).select("fclass", "rings"), "polygons"
    ).withColumn("edges", F.flatten(F.transform("rings", _oriented_edges))).drop("rings")
    return boxed.withColumn("area", _signed_area(F.col("edges")))


_LAYER_MARK = "\u001f"
_SHAPES = {
    "points": ("lon", "lat"), "lines": ("x0", "y0", "x1", "y1"), "polygons": ("rings",),
}
_IN_RINGS = {"points": count_in_rings, "lines": length_in_rings, "polygons": area_in_rings}
_BOXED = {"points": _boxed_points, "lines": _boxed_lines, "polygons": _boxed_polygons}


def layer_features(
    locations: DataFrame, layer: DataFrame, kind: str, name: str,
    step: int = 100, max_radius: int = 3000,
) -> DataFrame:
    """Ring features of one layer with its name as `geo_feature`."""
    built = _IN_RINGS[kind](locations, layer, step, max_radius)
    return built.withColumn("geo_feature", F.lit(name)).select(
        F.col("id").cast("string").alias("id"), "geo_feature", "feature_type",
        F.col("buffer_size").cast("int").alias("buffer_size"), "value", "measurement",
    )


def region_hull(points: DataFrame, lon: str = "lon", lat: str = "lat", fan_in: int = 16) -> DataFrame:
    """One row `hull`: array<struct<x, y>>, the convex hull, counter-clockwise.

    Every task reduces its own rows to a hull; those are merged over `fan_in`
    tasks and then in one, so the last step only sees the corners of `fan_in` hulls.
    """
    corners = points.select(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    local = corners.where("x is not null and y is not null").mapInPandas(
        _hull_of_batches, "x double, y double"
    )
    merged = local.repartition(fan_in, "x", "y").mapInPandas(_hull_of_batches, "x double, y double")
    final = merged.repartition(1).mapInPandas(_numbered_hull, "x double, y double, pos int")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    return final.agg(
        F.transform(
            ordered, lambda p: F.struct(p.getField("x").alias("x"), p.getField("y").alias("y"))
        ).alias("hull")
    )


def inside_hull(
    points: DataFrame, hull: DataFrame, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Points strictly inside the convex `hull` row."""
    left_of = F.forall("_sides", lambda e: _side_of(e, F.col(lon), F.col(lat)) > 0)
    return _with_sides(points, hull).where(left_of).drop("_sides")


def inside_polygon(
    points: DataFrame, outline: DataFrame, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Points inside any simple polygon, given as a one-row array of corners (even-odd rule)."""
    def crossed(count: Column, e: Column) -> Column:
        spans = (e.getField("ay") > F.col(lat)) != (e.getField("by") > F.col(lat))
        at = e.getField("ax") + F.try_divide(
            (F.col(lat) - e.getField("ay")) * (e.getField("bx") - e.getField("ax")),
            e.getField("by") - e.getField("ay"),
        )
        return count + F.when(spans & (F.col(lon) < at), F.lit(1)).otherwise(F.lit(0))

    crossings = F.aggregate("_sides", F.lit(0), crossed)
    return _with_sides(points, outline).where(crossings % 2 == 1).drop("_sides")


def geo_features(
    locations: DataFrame,
    layers: Mapping[str, tuple[str, DataFrame]],
    corners: Sequence[Sequence[float]] | None = None,
    step: int = 100,
    max_radius: int = 3000,
) -> DataFrame:
    """Ring features of all `layers` (name -> (kind, rows)), cut to the box `corners` first.

    Layers of one kind are joined with the locations together. Whole polylines (kind
    'paths') become straight pieces behind the box filter.
    """
    if not layers:
        raise ValueError("no layers given")
    by_kind: dict[str, DataFrame] = {}
    for name, (kind, layer) in layers.items():
        kept = layer if corners is None else in_box(layer, corners, kind)
        if kind == "paths":
            kind, kept = "lines", segments(kept)
        # the layer travels as part of the class and is taken out again below
        shape = [c for c in _SHAPES[kind] if c in kept.columns]
        named = kept.where(F.col("fclass").isNotNull()).select(
            F.concat_ws(_LAYER_MARK, F.lit(name), F.col("fclass").cast("string")).alias("fclass"),
            *shape,
        )
        by_kind[kind] = by_kind[kind].unionByName(named) if kind in by_kind else named
    built = None
    for kind, rows in by_kind.items():
        found = _in_rings(
            locations, _BOXED[kind](rows), step, max_radius, kind, layered=True
        ).withColumn("buffer_size", F.col("buffer_size").cast("int"))
        built = found if built is None else built.unionByName(found)
    return built


#: what the words that WKT shapes begin with become
_KIND_OF = {"POINT": "points", "LINESTRING": "paths", "MULTILINESTRING": "paths",
            "POLYGON": "polygons", "MULTIPOLYGON": "polygons"}


def shape_kind(text: Column) -> Column:
    """Kind of a WKT shape: points, paths or polygons; null when it is none of them."""
    word = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    kinds = F.create_map(*[F.lit(v) for pair in _KIND_OF.items() for v in pair])
    return F.try_element_at(kinds, word)


def layer_kinds(layers: Mapping[str, DataFrame], shape: str = "geometry") -> DataFrame:
    """(layer, kind, n): how many shapes of each kind every layer holds, in one job.

    `layers` have a WKT column `shape`; what is no known shape counts under kind null. The
    summary has a row per layer and kind, whatever the layers hold.
    """
    if not layers:
        raise ValueError("no layers given")
    kinds = [
        rows.select(F.lit(name).alias("layer"), shape_kind(F.col(shape)).alias("kind"))
        for name, rows in layers.items()
    ]
    return reduce(DataFrame.unionByName, kinds).groupBy("layer", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )


def geo_features_of(
    locations: DataFrame,
    layers: Mapping[str, DataFrame],
    shape: str = "geometry",
    corners: Sequence[Sequence[float]] | None = None,
    step: int = 100,
    max_radius: int = 3000,
) -> DataFrame:
    """`geo_features` of layers (fclass, WKT column `shape`) whose kinds the data tells.

    A layer of several kinds gives the features of each; `measurement` tells them apart.
    Lines of a multi-line are separate paths. Rows whose shape is none are left out; with
    no shape at all there are no rows. Counts kinds first, the rest is lazy.
    """
    met = layer_kinds(layers, shape).where(F.col("kind").isNotNull()).collect()
    built = []
    for kind in sorted({r["kind"] for r in met}):
        named = {r["layer"]: (kind, _shapes(layers[r["layer"]], kind, shape))
                 for r in sorted(met) if r["kind"] == kind}
        built.append(geo_features(locations, named, corners, step, max_radius))
    if built:
        return reduce(DataFrame.unionByName, built)
    schema = ("id string, geo_feature string, feature_type string, buffer_size int, "
              "value double, measurement string")
    return locations.sparkSession.createDataFrame([], schema)


def _shapes(layer: DataFrame, kind: str, shape: str) -> DataFrame:
    """(fclass, shape columns) of the rows of one kind."""
    text = F.col(shape)
    rows = layer.where(shape_kind(text) == kind)
    if kind == "points":
        return rows.select("fclass", wkt_lon(text).alias("lon"), wkt_lat(text).alias("lat"))
    if kind == "paths":
        return rows.select("fclass", F.explode(wkt_paths(text)).alias("path"))
    return rows.select("fclass", wkt_rings(text).alias("rings"))


def _in_rings(
    locations: DataFrame, layer: DataFrame, step: int, max_radius: int, kind: str, unit: str = "m2",
    layered: bool = False,
) -> DataFrame:
    """(id, feature_type, buffer_size, value, measurement) of a layer with bounding boxes.

    With `layered` the class also holds the layer, and both are taken apart while there is
    one row per location and class.

    A location meets the layer in its own square of a cell, to which all shapes within reach
    are copied in packed rows, so its sums are whole in one group and no pairs or partial sums
    are shuffled. How often a cell is halved, and whether a square's locations are dealt into
    lots or its shapes into parts, is counted first and written to the shared folder. Only
    locations whose id repeats or whose square has parts are summed once more.
    """
    max_radius = ring_sizes(step, max_radius)[-1]
    n = max_radius // step
    # cells of two reaches: a shape is copied to about four of them
    grid = CellGrid(max_radius, 0.5)
    around = grid.list_around(layer.dropna(subset=["min_x", "max_x", "min_y", "max_y"]))
    # merged, not broadcast: how many are left is not known before they are counted
    repeated = locations.groupBy(F.col("id").alias("_id")).count().where("count > 1").hint("merge")
    home = grid.list_squares(
        locations.select("id", *[F.col(c).cast("double").alias(c) for c in ("lon", "lat")])
        .dropna(subset=["lon", "lat"])
    ).join(repeated, F.col("id").eqNullSafe(F.col("_id")), "left").select(
        "id", "lon", "lat", "_band", "_cell", "_u", "_v", F.col("count").isNotNull().alias("_again")
    )
    cells = cut(_ring_cells(home, around, kind), "ring-cells")
    key = ["_band", "_cell", "_square", "_lot", "_part"]
    id_type = locations.schema["id"].dataType.simpleString()
    class_type = layer.schema["fclass"].dataType.simpleString()
    schema = f"id {id_type}, feature_type {class_type}, values array<double>"
    packed = around.mapInArrow(pack(kind), PACKED.format(fclass=class_type))

    def values(again: bool) -> DataFrame:
        groups = F.filter("_groups", lambda g: g.getField("again" if again else "once"))
        of_cell = cells.select("_band", "_cell", "_level", groups.alias("_groups"))
        across, up = (F.expr(f"shiftright({c}, {HALVINGS} - _level)") for c in ("_u", "_v"))
        own = F.filter("_groups", lambda g: g.getField("square") == across + up * SQUARES)
        # left joins and outer rows: what grows with a table is on the left, never broadcast
        dealt = (
            home.join(of_cell, ["_band", "_cell"], "left")
            .select("id", "lon", "lat", "_band", "_cell", "_again", F.inline_outer(own))
            .where((F.col("_again") | (F.col("parts") > 1)) == F.lit(again))
            .select(
                "id", "lon", "lat", "_band", "_cell", F.col("square").cast("int").alias("_square"),
                F.pmod(F.xxhash64("id", "lon", "lat"), F.col("lots")).cast("int").alias("_lot"),
                F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"),
            )
            .where("_part is not null")
        )
        shapes = packed.join(of_cell, ["_band", "_cell"], "left").mapInArrow(
            deal(kind), DEALT.format(fclass=class_type)
        )
        return (
            spread(dealt, *key).groupBy(*key).cogroup(spread(shapes, *key).groupBy(*key))
            .applyInArrow(ring_values(kind, step, n, unit), schema)
        )

    rings_of = values(again=False)
    if cells.where(F.exists("_groups", lambda g: g.getField("again"))).limit(1).count():
        rings_of = rings_of.unionByName(
            values(again=True).groupBy("id", "feature_type").agg(
                F.array(*[F.sum(F.get("values", F.lit(k))) for k in range(n)]).alias("values")
            )
        )
    noise = _AREA_NOISE if kind == "polygons" else 0.0
    if unit == "deg2":
        noise /= _M_PER_DEGREE**2
    names = ["id", "feature_type"]
    if layered:
        parts_of = F.split("feature_type", _LAYER_MARK, 2)
        rings_of = rings_of.select(
            F.col("id").cast("string").alias("id"), F.get(parts_of, F.lit(0)).alias("geo_feature"),
            F.get(parts_of, F.lit(1)).alias("feature_type"), "values",
        )
        names = ["id", "geo_feature", "feature_type"]
    return rings_of.select(*names, F.posexplode("values").alias("k", "value")).select(
        *names, ((F.col("k") + 1) * step).alias("buffer_size"), "value",
        F.lit(MEASUREMENTS[kind]).alias("measurement"),
    ).where(F.col("value") > noise)


def _ring_cells(home: DataFrame, around: DataFrame, kind: str) -> DataFrame:
    """(_band, _cell, _level, _groups) of the cells in which locations may reach shapes.

    A cell is halved until every square has few enough locations and pairs, at most
    `HALVINGS` times. A group is (square, lots, parts, once, again): whether it has
    locations that are summed in it alone, and others.
    """
    cell = ["_band", "_cell"]
    square = [*cell, "_level", "square"]
    levels = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS)))

    def halved(at: str) -> Column:
        return F.expr(f"shiftright({at}, {HALVINGS} - _level)")

    places = (
        home.groupBy(*cell, "_u", "_v").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("_again").alias("n_again")
        )
        .withColumn("_level", levels)
        .withColumn("square", halved("_u") + halved("_v") * SQUARES)
        .groupBy(*square).agg(F.sum("n").alias("n"), F.sum("n_again").alias("n_again"))
    )
    weight = F.size("edges") + 1 if kind == "polygons" else F.lit(1)
    digits = [f"_squares div {SQUARES**k} % {SQUARES}" for k in range(4)]
    first, last, low, high = (halved(f"cast({d} as int)") for d in digits)
    shapes = (
        around.groupBy(*cell, "_squares").agg(F.sum(weight).alias("rows"))
        .withColumn("_level", levels)
        .withColumn("_x", F.explode(F.sequence(first, last)))
        .withColumn("_y", F.explode(F.sequence(low, high)))
        .withColumn("square", F.col("_x") + F.col("_y") * SQUARES)
        .groupBy(*square).agg(F.sum("rows").alias("rows"))
    )
    rows = F.least(F.col("rows"), F.lit(LAYER_ROWS))
    lots = F.ceil(F.greatest(F.col("n") / LOT_ROWS, F.col("n") * rows / GROUP_PAIRS)).cast("int")
    parts = F.ceil(F.col("rows") / LAYER_ROWS).cast("int")
    met = places.join(shapes.hint("merge"), square).select(
        *square, lots.alias("lots"), parts.alias("parts"),
        ((parts == 1) & (F.col("n") > F.col("n_again"))).alias("once"),
        ((parts > 1) | (F.col("n_again") > 0)).alias("again"),
    )
    # the first level at which no square has lots, else the last
    level = F.when(F.col("most") <= 1, F.col("_level")).otherwise(2 * HALVINGS + 1 - F.col("_level"))
    found = ("_level", "_groups")
    return (
        met.groupBy(*cell, "_level").agg(
            F.max("lots").alias("most"),
            F.collect_list(F.struct("square", "lots", "parts", "once", "again")).alias("_groups"),
        )
        .groupBy(*cell).agg(F.min_by(F.struct(*found), level).alias("_found"))
        .select(*cell, *[F.col(f"_found.{c}").alias(c) for c in found])
    )


def _with_sides(points: DataFrame, outline: DataFrame) -> DataFrame:
    """Add the edges of a one-row outline to every point; the outline is one subquery."""
    corner = outline.columns[0]
    sides = outline.select(_edges_of(F.col(corner)).alias("sides"))
    return points.withColumn("_sides", sides.scalar())


def _edges_of(corners: Column) -> Column:
    """Edges (ax, ay, bx, by) of a closed outline given as corners."""
    n = F.size(corners)
    return F.transform(
        corners,
        lambda p, i: F.struct(
            p.getField("x").alias("ax"), p.getField("y").alias("ay"),
            F.get(corners, F.pmod(i + 1, n)).getField("x").alias("bx"),
            F.get(corners, F.pmod(i + 1, n)).getField("y").alias("by"),
        ),
    )


def _signed_area(edges: Column) -> Column:
    """Area left of a closed outline, taken from its first corner to keep the digits."""
    x0, y0 = F.get(edges, F.lit(0)).getField("ax"), F.get(edges, F.lit(0)).getField("ay")

    def add(total: Column, e: Column) -> Column:
        cross = (e.getField("ax") - x0) * (e.getField("by") - y0) - (e.getField("bx") - x0) * (
            e.getField("ay") - y0
        )
        return total + cross / 2

    return F.aggregate(edges, F.lit(0.0), add)


def _oriented_edges(ring: Column) -> Column:
    """Edges of a polygon ring, outlines counter-clockwise and holes clockwise."""
    edges = _edges_of(ring.getField("points"))
    flip = (_signed_area(edges) < 0) != ring.getField("hole")
    return F.transform(
        edges,
        lambda e: F.when(
            flip,
            F.struct(e.getField("bx").alias("ax"), e.getField("by").alias("ay"),
                     e.getField("ax").alias("bx"), e.getField("ay").alias("by")),
        ).otherwise(e),
    )


def _side_of(e: Column, x: Column, y: Column) -> Column:
    """Positive when (x, y) lies left of the edge."""
    return (e.getField("bx") - e.getField("ax")) * (y - e.getField("ay")) - (
        e.getField("by") - e.getField("ay")
    ) * (x - e.getField("ax"))


def _hull_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept = np.empty((0, 2))
    for batch in batches:
        points = batch[["x", "y"]].to_numpy(float)
        kept = _hull(np.vstack([kept, _outer(points)]))
    if len(kept):
        yield pd.DataFrame({"x": kept[:, 0], "y": kept[:, 1]})


def _numbered_hull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for hull in _hull_of_batches(batches):
        yield hull.assign(pos=np.arange(len(hull), dtype="int32"))


def _outer(points: np.ndarray) -> np.ndarray:
    """Points not strictly inside the polygon of the extremes in eight directions."""
    turn = np.arange(8) * (np.pi / 4)
    ways = np.column_stack([np.cos(turn), np.sin(turn)])
    corners = points[np.argmax(points @ ways.T, axis=0)]
    after = np.roll(corners, -1, axis=0)
    edge = after - corners
    inside = np.full(len(points), edge.any())
    for (cx, cy), (ex, ey) in zip(corners, edge):
        if ex or ey:
            inside &= ex * (points[:, 1] - cy) - ey * (points[:, 0] - cx) > 0
    return points[~inside]


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest x."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq: np.ndarray) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append(p)
        return out

    return np.array(chain(pts)[:-1] + chain(pts[::-1])[:-1])
