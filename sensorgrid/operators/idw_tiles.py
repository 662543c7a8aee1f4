"""Inverse-distance means of held-out stations in tiles.

Stations and times are numbered. What a group gets are packed rows: the readings to predict
of one block of targets in one part of the times, and for each block of sources the weights
of the pairs and the readings of the sources. It lays the weights of a block out as a matrix
and sums them time by time, for the targets and sources of that time only. So a pair crosses
the shuffle in 12 bytes, once per part of the times in which both stations report, a reading
once per target block, and a (time, source, target) term never does.

Where the distances are those of placed stations (`PlacedPairs`), pairs cross no shuffle at
all: a group gets the places and works the weights of a source block out itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.functions import EARTH_RADIUS_M, haversine
from sensorgrid.operators.fold_tiles import cut
from sensorgrid.operators.numbering import number_rows
from sensorgrid.operators.spread import spread

#: stations of a source block, times of a part, and the most stations of a target block
SOURCES, TIMES, TARGETS = 1024, 1024, 4096
_LEAST_TARGETS, _TARGET_BLOCKS = 64, 24
#: the most placed stations of a target block, weights held at once, and worked out at once
_PLACED_TARGETS, _WEIGHTS, _WEIGHTS_AT_ONCE = 32_768, 1 << 22, 1 << 14
#: rows that a task packs at a time, and those of one packed row
_HELD, _PACKED = 400_000, 800
#: bit of a place that tells that the weight or the reading is null
_NULL = 1 << 15
_SLOT = np.dtype([("i", "<u2"), ("t", "<u2")])
_PAIR = np.dtype([("i", "<u2"), ("j", "<u2"), ("weight", "<f8")])
_READING = np.dtype([("j", "<u2"), ("t", "<u2"), ("rows", "<u4"), ("sum", "<f8")])
_KINDS = (_SLOT, _PAIR, _READING)
_PLACE = np.dtype([("i", "<u2"), ("strip", "<i4"), ("lon", "<f8"), ("lat", "<f8")])
_PLACED_KINDS = (_SLOT, _PLACE, _READING)


@dataclass(frozen=True)
class PlacedPairs:
    """The distances of stations (station_id, lon, lat) at different places, pair by pair.

    With `strip`, an expression over those columns, only of stations in the same strip.
    """

    stations: DataFrame
    strip: Column | None = None

    def placed(self) -> DataFrame:
        """(_id, lon, lat, _strip) of the stations that have a place and a strip."""
        strip = F.lit(0) if self.strip is None else self.strip
        columns = [F.col(c).cast("double").alias(c) for c in ("lon", "lat")]
        return self.stations.select(
            F.col("station_id").alias("_id"), *columns, strip.alias("_strip")
        ).where("_id is not null and lon is not null and lat is not null and _strip is not null")

    def repeats(self) -> bool:
        """Whether a station has several places."""
        return bool(self.placed().groupBy("_id").count().where("count > 1").limit(1).count())

    def table(self) -> DataFrame:
        """(id_a, id_b, distance), a row per pair."""
        a, b = ([F.col(c).alias(f"{c}_{side}") for c in ("_id", "lon", "lat", "_strip")] for side in "ab")
        apart = (F.col("lon_a") != F.col("lon_b")) | (F.col("lat_a") != F.col("lat_b"))
        met = (F.col("_strip_a") == F.col("_strip_b")) & (F.col("_id_a") != F.col("_id_b")) & apart
        return spread(self.placed(), "_id").select(*a).join(self.placed().select(*b), met).select(
            F.col("_id_a").alias("id_a"), F.col("_id_b").alias("id_b"),
            haversine(*[F.col(c) for c in ("lon_a", "lat_a", "lon_b", "lat_b")]).alias("distance"),
        )


def held_out_means(
    readings: DataFrame, w: DataFrame, min_sources: int, divisor: str, targets: int | None = None
) -> DataFrame:
    """(_target, _time, prediction) of the stations and times with `min_sources` rows of others.

    `readings` is (_time, _source, _sum, _known, _rows), one row per time and source; `w` is
    (id_a, id_b, weight) without pairs of a station with itself; `divisor` names the rows
    whose weights add to the divisor. A station and time without a source have no row.
    """
    rows, times = _rows_and_times(readings)
    ids = rows.where("_source is not null").select("_source").distinct()
    stations = cut(
        number_rows(ids, ["_source"], F.pmod(F.hash("_source"), F.lit(64)), out="n"),
        "idw-stations",
    )
    n = stations.count()
    if targets is None:
        targets = min(TARGETS, max(_LEAST_TARGETS, -(-n // _TARGET_BLOCKS)))
    numbered = _numbered(rows, times, stations, min_sources, divisor)
    part = F.floor(F.col("t") / TIMES).cast("int")
    # a file, so that its size is known before the pairs are planned
    reporting = cut(
        stations.join(numbered.groupBy("n").agg(F.collect_set(part).alias("parts")), "n")
        .select("_source", F.col("n").cast("int"), "parts"),
        "idw-reporting",
    )
    a = reporting.select(F.col("_source").alias("_a"), F.col("n").alias("a"), F.col("parts").alias("_of_a"))
    b = reporting.select(F.col("_source").alias("_b"), F.col("n").alias("b"), F.col("parts").alias("_of_b"))
    pairs = w.join(a, F.col("id_a") == F.col("_a")).join(b, F.col("id_b") == F.col("_b")).select(
        "a", "b", F.col("weight").cast("double").alias("weight"),
        F.explode(F.array_intersect("_of_a", "_of_b")).alias("part"),
    )
    slots = numbered.where("wanted").select("n", "t")
    last = max(0, -(-n // targets) - 1)
    sources = numbered.select("n", "t", "sum", "rows", "known").mapInArrow(
        _pack(2, targets), _PACKED_ROW
    ).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(last))))
    tiles = slots.mapInArrow(_pack(0, targets), _PACKED_ROW).union(
        pairs.mapInArrow(_pack(1, targets), _PACKED_ROW)
    ).unionByName(sources)
    return _summed_in_tiles(tiles, stations, times, lambda tile, part: _Targets(tile, part, targets))


def held_out_means_placed(
    readings: DataFrame, pairs: PlacedPairs, power: float, min_sources: int, divisor: str,
    targets: int | None = None,
) -> DataFrame:
    """`held_out_means` with inverse distances of placed stations, one place each, as weights.

    Stations are numbered strip by strip, so a block of targets needs few strips of sources.
    """
    rows, times = _rows_and_times(readings)
    ids = rows.where("_source is not null").select("_source").distinct()
    placed = pairs.placed().withColumnRenamed("_id", "_source").join(ids, "_source", "left_semi")
    bucket = F.struct("_strip", F.pmod(F.hash("_source"), F.lit(64)))
    numbered_once = cut(number_rows(placed, ["_source"], bucket, out="n"), "idw-placed")
    n, n_times = numbered_once.count(), times.count()
    if targets is None:
        targets = min(_PLACED_TARGETS, max(_LEAST_TARGETS, -(-n // _TARGET_BLOCKS)))
    # a strip is known by its first number, and met by the tiles from first to last
    ends = numbered_once.groupBy("_strip").agg(F.min("n").alias("_from"), F.max("n").alias("_to"))
    stations = cut(
        numbered_once.join(ends, "_strip").select(
            "_source", "n", "lon", "lat", F.col("_from").cast("int").alias("strip"),
            *[F.floor(F.col(c) / targets).cast("int").alias(tile) for c, tile in
              (("_from", "first"), ("_to", "last"))],
        ),
        "idw-stations",
    )
    numbered = _numbered(rows, times, stations, min_sources, divisor)
    part = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n_times // TIMES) - 1))))
    place = [F.col("n").cast("int").alias("n"), "strip", "lon", "lat"]
    targets_of = stations.select(*place, F.lit(True).alias("target"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    sources_of = stations.select(*place, F.lit(False).alias("target"), "first", "last")
    places = targets_of.unionByName(sources_of).mapInArrow(
        _pack_places(targets), _PACKED_ROW + ", last int"
    ).withColumn("part", part)
    slots = numbered.where("wanted").select("n", "t", F.lit(0).alias("first"), F.lit(0).alias("last"))
    sources = numbered.select("n", "t", "sum", "rows", "known", "first", "last")
    tiles = reduce(DataFrame.unionByName, [
        slots.mapInArrow(_pack(0, targets, ranged=True), _PACKED_ROW + ", last int"),
        places, sources.mapInArrow(_pack(2, targets, ranged=True), _PACKED_ROW + ", last int"),
    ]).withColumn("tile", F.explode(F.sequence("tile", "last"))).drop("last")
    return _summed_in_tiles(
        tiles, stations, times, lambda tile, part: _PlacedTargets(tile, part, targets, power)
    )


_PACKED_ROW = "tile int, part int, block int, kind int, data binary"


def _rows_and_times(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The readings, and their times with a number and how many rows are present."""
    rows = cut(readings, "idw-readings")
    present = rows.where("_time is not null").groupBy("_time").agg(F.sum("_rows").alias("_present"))
    times = cut(
        number_rows(present, ["_time"], F.pmod(F.hash("_time"), F.lit(16)), out="t"), "idw-times"
    )
    return rows, times


def _numbered(
    rows: DataFrame, times: DataFrame, stations: DataFrame, min_sources: int, divisor: str
) -> DataFrame:
    others = [c for c in ("first", "last") if c in stations.columns]
    return rows.join(times, "_time").join(stations, "_source").select(
        F.col("n").cast("int"), F.col("t").cast("int"), F.col("_sum").cast("double").alias("sum"),
        F.col(divisor).cast("long").alias("rows"), (F.col("_known") > 0).alias("known"),
        (F.col("_present") - F.col("_rows") >= min_sources).alias("wanted"), *others,
    )


def _summed_in_tiles(tiles: DataFrame, stations: DataFrame, times: DataFrame, group) -> DataFrame:
    means = (
        spread(tiles, "tile", "part").sortWithinPartitions("tile", "part", "block", "kind")
        .mapInArrow(_means(group), "n int, t int, prediction double")
    )
    return means.join(stations, "n").join(times, "t").select(
        F.col("_source").alias("_target"), "_time", "prediction"
    )


def _pack(kind: int, targets: int, ranged: bool = False):
    """Rows (tile, part, block, kind, data): slots, pairs or readings of a tile, packed.

    With `ranged`, readings are those of the tiles from `first` to `last` and rows say so.
    """

    def records(table: pa.Table) -> tuple[np.ndarray, ...]:
        def column(name: str) -> np.ndarray:
            return table.column(name).to_numpy()

        data = np.empty(table.num_rows, _KINDS[kind])
        if kind == 1:
            weight, null = _filled(table.column("weight"))
            tile, data["i"] = np.divmod(column("a"), targets)
            block, data["j"] = np.divmod(column("b"), SOURCES)
            data["j"][null] |= _NULL
            data["weight"], part = weight, column("part")
        else:
            part, data["t"] = np.divmod(column("t"), TIMES)
            if kind == 0:
                tile, data["i"] = np.divmod(column("n"), targets)
                block = np.full_like(tile, -1)
            else:
                block, data["j"] = np.divmod(column("n"), SOURCES)
                data["j"][~column("known")] |= _NULL
                data["sum"], data["rows"] = _filled(table.column("sum"))[0], column("rows")
                tile = column("first") if ranged else np.zeros_like(block)
        last = column("last") if ranged and kind == 2 else tile
        return tile, last, part, block, data

    return _packing(kind, records, ranged)


def _pack_places(targets: int):
    """Packed places: of the targets of a tile (block -1), or of the sources of tiles."""

    def records(table: pa.Table) -> tuple[np.ndarray, ...]:
        n, target = (table.column(c).to_numpy() for c in ("n", "target"))
        data = np.empty(table.num_rows, _PLACE)
        data["i"] = np.where(target, n % targets, n % SOURCES)
        for c in ("strip", "lon", "lat"):
            data[c] = table.column(c).to_numpy()
        tile = np.where(target, n // targets, table.column("first").to_numpy())
        last = np.where(target, n // targets, table.column("last").to_numpy())
        return tile, last, np.zeros_like(tile), np.where(target, -1, n // SOURCES), data

    return _packing(1, records, ranged=True)


def _packing(kind: int, records, ranged: bool):
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        *keys, data = records(pa.Table.from_batches(held))
        order = np.lexsort(keys[::-1])
        tile, last, part, block = keys = [k[order] for k in keys]
        data = data[order]
        new = np.any([np.diff(k) != 0 for k in keys], axis=0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(data)]
        spans = [
            (at, min(at + _PACKED, end))
            for first, end in zip(edges, edges[1:]) for at in range(first, end, _PACKED)
        ]
        starts = np.array([at for at, _ in spans], dtype=np.int64)
        rows = {
            "tile": pa.array(tile[starts].astype(np.int32)),
            "part": pa.array(part[starts].astype(np.int32)),
            "block": pa.array(block[starts].astype(np.int32)),
            "kind": pa.array(np.full(len(starts), kind, np.int32)),
            "data": pa.array([data[at:end].tobytes() for at, end in spans], pa.binary()),
        }
        if ranged:
            rows["last"] = pa.array(last[starts].astype(np.int32))
        return pa.RecordBatch.from_pydict(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= _HELD:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return run


def _filled(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values with null as zero, and where they are null."""
    return column.fill_null(0.0).to_numpy(), column.is_null().to_numpy()


class _Targets:
    """The sums of the targets of one block in one part of the times."""

    kinds = _KINDS

    def __init__(self, tile: int, part: int, targets: int):
        self.tile, self.part, self.targets, self.block = tile, part, targets, -1
        self.held: tuple[list, list, list] = ([], [], [])

    def finish_block(self) -> None:
        if self.block < 0:
            slots = np.concatenate([np.empty(0, _SLOT), *self.held[0]])
            self.slots = slots[np.lexsort((slots["i"], slots["t"]))]
            self.row = self.slots["i"].astype(np.int64)
            self.at = _places(self.slots["t"])
            self.total, self.divisor = np.zeros((2, len(slots)))
            self.met, self.known = np.zeros((2, len(slots)), bool)
        elif self.at and self.held[1] and self.held[2]:
            self._add(np.concatenate(self.held[1]), np.concatenate(self.held[2]))
        self.held = ([], [], [])

    def _add(self, pairs: np.ndarray, readings: np.ndarray) -> None:
        null = pairs["j"] >= _NULL
        cell = pairs["i"].astype(np.int64) * SOURCES + (pairs["j"] & (_NULL - 1))
        weight = np.bincount(cell, pairs["weight"], self.targets * SOURCES)
        # no weight is zero or null: whoever is paired has a sum of weights
        plain = np.isfinite(pairs["weight"]).all() and not null.any() and (pairs["weight"] > 0).all()
        paired, weighed = None, None
        if not plain or not np.isfinite(readings["sum"]).all():
            paired, weighed = np.zeros((2, self.targets * SOURCES), bool)
            paired[cell], weighed[cell[~null]] = True, True
        j = (readings["j"] & (_NULL - 1)).astype(np.int64)
        self._sum(weight, SOURCES, j, readings, paired, weighed)

    def _sum(self, weight, width: int, j, readings: np.ndarray, paired, weighed) -> None:
        """Add the readings of sources `j` with flat (target, source) weights. Without masks
        all weights and readings are numbers, and a pair is where the weight is positive."""
        order = np.lexsort((j, readings["t"]))
        j, readings = j[order], readings[order]
        known, value, rows = readings["j"] < _NULL, readings["sum"], readings["rows"].astype(float)
        plain = paired is None
        if plain:
            numbers = np.stack([value, rows, known, np.ones(len(rows))], axis=1)
        for t, (first, end) in _places(readings["t"]).items():
            if t not in self.at:
                continue
            own = slice(*self.at[t])
            cells = self.row[own, None] * width + j[None, first:end]
            w = weight.take(cells)
            if plain:
                total, divisor, known_weight, all_weight = (w @ numbers[first:end]).T
                self.total[own] += total
                self.divisor[own] += divisor
                self.met[own] |= all_weight > 0
                self.known[own] |= known_weight > 0
                continue
            # what is no pair must not meet an infinite or missing number
            has = weighed.take(cells)
            summed = has & known[first:end]
            for sums, number, where in (
                (self.total, value, summed), (self.divisor, rows, has),
            ):
                terms = np.multiply(w, number[first:end], where=where, out=np.zeros(w.shape))
                sums[own] += terms.sum(axis=1)
            self.met[own] |= paired.take(cells).any(axis=1)
            self.known[own] |= summed.any(axis=1)

    def means(self) -> Iterator[pa.RecordBatch]:
        self.finish_block()
        null = ~self.known | (self.divisor == 0)
        mean = np.divide(self.total, self.divisor, where=~null, out=np.zeros(len(null)))
        n = self.tile * self.targets + self.slots["i"].astype(np.int32)
        t = self.part * TIMES + self.slots["t"].astype(np.int32)
        found = np.flatnonzero(self.met)
        for first in range(0, len(found), _HELD):
            at = found[first:first + _HELD]
            yield pa.RecordBatch.from_pydict({
                "n": pa.array(n[at], pa.int32()), "t": pa.array(t[at], pa.int32()),
                "prediction": pa.array(mean[at], mask=null[at]),
            })


class _PlacedTargets(_Targets):
    """`_Targets` that get places in place of pairs."""

    kinds = _PLACED_KINDS

    def __init__(self, tile: int, part: int, targets: int, power: float):
        super().__init__(tile, part, targets)
        self.power = power

    def finish_block(self) -> None:
        if self.block < 0:
            self.places = np.zeros(self.targets, _PLACE)
            self.places["strip"] = -1
            for some in self.held[1]:
                self.places[some["i"]] = some
            self.at = {}
        super().finish_block()

    def _add(self, places: np.ndarray, readings: np.ndarray) -> None:
        # only targets with a place and sources with a reading in this part, a few columns at a time
        mine = np.flatnonzero(np.bincount(self.row, minlength=self.targets))
        place_of = np.full(self.targets, -1)
        place_of[mine] = np.arange(len(mine))
        every = np.zeros(SOURCES, _PLACE)
        every["strip"] = -2
        every[places["i"]] = places
        j = (readings["j"] & (_NULL - 1)).astype(np.int64)
        sources = np.unique(j)
        at_once = max(64, _WEIGHTS // max(len(mine), 1))
        row, self.row = self.row, place_of[self.row]
        for first in range(0, len(sources), at_once):
            some = sources[first:first + at_once]
            met = (j >= some[0]) & (j <= some[-1])
            theirs = every[some]
            block_first = self.block * SOURCES - self.tile * self.targets
            weight, zero = self._weights(mine, some + block_first, theirs)
            paired = weighed = None
            if zero is not None or not np.isfinite(readings["sum"][met]).all():
                weighed = weight > 0
                paired = weighed if zero is None else weighed | zero
            self._sum(
                weight, len(some), np.searchsorted(some, j[met]), readings[met], paired, weighed
            )
        self.row = row

    def _weights(self, mine, numbers, theirs) -> tuple[np.ndarray, np.ndarray | None]:
        """Flat inverse distances, 0 where there is no pair, and where a distance is 0, if any."""
        weight, zero = np.empty((len(mine), len(theirs))), None
        step = max(1, _WEIGHTS_AT_ONCE // max(len(theirs), 1))
        for first in range(0, len(mine), step):
            at = mine[first:first + step]
            own = self.places[at]
            pair = own["strip"][:, None] == theirs["strip"]
            pair &= at[:, None] != numbers
            east = theirs["lon"] - own["lon"][:, None]
            north = theirs["lat"] - own["lat"][:, None]
            pair &= (east != 0) | (north != 0)
            cosines = np.cos(np.radians(own["lat"]))[:, None] * np.cos(np.radians(theirs["lat"]))
            apart = _metres(east, north, cosines)
            none = apart == 0
            if (none & pair).any():
                if zero is None:
                    zero = np.zeros(weight.shape, bool)
                zero[first:first + step] = none & pair
            pair &= ~none
            if self.power != 1:
                apart = apart**self.power
            found = weight[first:first + step]
            found[:] = 0.0
            np.divide(1.0, apart, out=found, where=pair)
        return weight.ravel(), None if zero is None else zero.ravel()


def _sine(x: np.ndarray) -> np.ndarray:
    """Sine to the last digits; by its series where all angles are small, which is faster."""
    if not x.size or max(x.max(), -x.min()) > 0.05:
        return np.sin(x)
    y = x * x
    series = y * (1 / 362880)
    for k in (-1 / 5040, 1 / 120, -1 / 6):
        series += k
        series *= y
    series *= x
    series += x
    return series


def _metres(east: np.ndarray, north: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """Great-circle distance by degrees of longitude and latitude and product of cosines."""
    a, b = _sine(np.radians(north) / 2), _sine(np.radians(east) / 2)
    a *= a
    b *= b
    b *= cosines
    a += b
    np.sqrt(a, out=a)
    if a.size and a.max() <= 0.03:
        y = a * a
        series = y * (35 / 1152)
        for k in (15 / 336, 3 / 40, 1 / 6):
            series += k
            series *= y
        series *= a
        a += series
    else:
        a = np.arcsin(np.minimum(a, 1.0, out=a))
    a *= 2 * EARTH_RADIUS_M
    return a


def _places(sorted_times: np.ndarray) -> dict[int, tuple[int, int]]:
    """First place and end of each time."""
    times, first = np.unique(sorted_times, return_index=True)
    ends = [*first[1:].tolist(), len(sorted_times)]
    return dict(zip(times.tolist(), zip(first.tolist(), ends)))


def _means(new_group):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tile", "part", "block", "kind", "data")]
            for tile, part, block, kind, data in zip(*columns):
                if group is None or (group.tile, group.part) != (tile, part):
                    if group is not None:
                        yield from group.means()
                    group = new_group(tile, part)
                    if block >= 0:  # no reading to predict
                        group.finish_block()
                        group.block = block
                if block != group.block:
                    group.finish_block()
                    group.block = block
                if block < 0 or group.at:
                    group.held[kind].append(np.frombuffer(data, group.kinds[kind]))
        if group is not None:
            yield from group.means()

    return run
