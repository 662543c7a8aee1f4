"""Near-duplicates by SimHash: exact tiled comparison of 64-bit fingerprints.

Equal fingerprints are merged first. The others are laid into cells by the population counts
of their four 16-bit quarters; counts of two fingerprints within the radius differ by no more
than the radius in sum, so all other pairs of cells are skipped unseen. A cell of more than
`tile` fingerprints is cut into tiles by a hash. Each tile is compared, as numpy matrices of
exclusive-ors and bit counts, with itself and with the fingerprints of the cells around it,
which stream past it in blocks: a task holds one tile and one block. A fingerprint has at
most 2,080 others within two bits, and a tile passes on a spanning forest of its links only,
so no group is written out as pairs. Components are found by alternating large and small
stars, with a cut after each round.

The table of cell sizes that tasks get has at most 17 ** 4 entries, whatever the input.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from sensorgrid.llm import minhash
from sensorgrid.llm.common import PLACE, cut, located, numbered, text_of

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
TILE = 4096
_BLOCK = 512
_QUARTERS = 4
_SIDE = 64 // _QUARTERS + 1
_HASHES_AT_ONCE = 1 << 16


def fingerprint(data: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a UTF-8 text; 0 if it has no words."""
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    text, width = b" ".join(words), min(shingle, len(words))
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    count, votes = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for first in range(0, count, _HASHES_AT_ONCE):
        last = min(count, first + _HASHES_AT_ONCE)
        hashes = np.array(
            [digest(text[a:b - 1], SEED)
             for a, b in zip(starts[first:last], starts[first + width:last + width])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array(
            [fingerprint(b) for b in batch.column("bytes").to_pylist()], dtype=np.uint64
        )
        columns = {n: batch.column(n) for n in batch.schema.names if n != "bytes"}
        columns["fp"] = pa.array(found.view(np.int64))
        yield pa.RecordBatch.from_pydict(columns)


def with_fingerprints(rows: DataFrame, text: Column) -> DataFrame:
    """`rows` and a column `fp`, the fingerprint of `text` as a signed long."""
    schema = StructType(rows.schema.fields).add("fp", LongType())
    return rows.withColumn("bytes", F.encode(text, "UTF-8")).mapInArrow(_fingerprints, schema)


def cell_of(fps: np.ndarray) -> np.ndarray:
    """Cell of each fingerprint: the population counts of its quarters as digits."""
    cell = np.zeros(len(fps), dtype=np.int64)
    for quarter in range(_QUARTERS):
        part = (fps >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
        cell = cell * _SIDE + np.bitwise_count(part)
    return cell


def near_cells(radius: int) -> np.ndarray:
    """Steps from a cell to half of the cells within `radius`; each pair is met once."""
    reach = range(-radius, radius + 1)
    return np.array([
        step for step in itertools.product(reach, repeat=_QUARTERS)
        if sum(map(abs, step)) <= radius and step > (0,) * _QUARTERS
    ])


def _deal(pieces_of: np.ndarray, radius: int):
    """(tile, visitor, fp): residents to their tile, visitors to the tiles they may match."""
    steps = near_cells(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            fps = signed.view(np.uint64)
            cell = cell_of(fps)
            mixed = (fps ^ (fps >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            own = ((mixed >> np.uint64(33)) % pieces_of[cell].astype(np.uint64)).astype(np.int64)
            out = [(cell << 24 | own, np.zeros(len(fps), bool), signed)]
            # later pieces of the own cell
            rest = pieces_of[cell] - 1 - own
            which = np.repeat(np.arange(len(fps)), rest)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(rest) - rest, rest)
            out.append((cell[which] << 24 | (own[which] + 1 + nth), None, signed[which]))
            digits = np.stack([cell // _SIDE ** (3 - q) % _SIDE for q in range(_QUARTERS)], 1)
            for step in steps:
                to = digits + step
                there = ((to >= 0) & (to < _SIDE)).all(axis=1)
                target = np.where(there, to @ (_SIDE ** np.arange(3, -1, -1)), 0)
                count = np.where(there, pieces_of[target], 0)
                which = np.repeat(np.arange(len(fps)), count)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                out.append((target[which] << 24 | nth, None, signed[which]))
            for tile, visitor, fp in out:
                if len(fp):
                    flags = np.ones(len(fp), bool) if visitor is None else visitor
                    yield pa.RecordBatch.from_pydict(
                        {"tile": pa.array(tile), "visitor": pa.array(flags), "fp": pa.array(fp)}
                    )

    return run


class _Forest:
    """Links of one tile, reduced to a spanning forest."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            ra, rb = self._root(a), self._root(b)
            if ra != rb:
                self.parent[ra] = rb
                self.links.append((a, b))


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within `radius` bits."""
    apart = np.bitwise_count(left[:, None] ^ right[None, :])
    return np.nonzero(apart <= radius)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, residents, forest = None, [], None, _Forest()

        def settle() -> None:
            """Compare a complete tile with itself, block by block."""
            nonlocal residents
            residents = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            for at in range(0, len(residents), _BLOCK):
                block = residents[at:at + _BLOCK]
                i, j = near_pairs(block, residents[at:], radius)
                forest.add(block[i[i < j]], residents[at:][j[i < j]])

        def links() -> pa.RecordBatch:
            a, b = np.array(forest.links, dtype=np.uint64).reshape(-1, 2).view(np.int64).T
            return pa.RecordBatch.from_pydict(
                {"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))}
            )

        for batch in batches:
            tiles = batch.column("tile").to_numpy(zero_copy_only=False)
            flags = batch.column("visitor").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.flatnonzero((tiles[1:] != tiles[:-1]) | (flags[1:] != flags[:-1])) + 1
            for at, end in zip([0, *ends], [*ends, len(tiles)]):
                if at == end:
                    continue
                if tiles[at] != tile:
                    if residents is None and parts:
                        settle()
                    if forest.links:
                        yield links()
                    tile, parts, residents, forest = tiles[at], [], None, _Forest()
                if not flags[at]:
                    parts.append(fps[at:end])
                    continue
                if residents is None:
                    settle()
                if len(residents):
                    for first in range(at, end, _BLOCK):
                        block = fps[first:min(end, first + _BLOCK)]
                        i, j = near_pairs(block, residents, radius)
                        if len(i):
                            forest.add(block[i], residents[j])
        if residents is None and parts:
            settle()
        if forest.links:
            yield links()

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a > b) that connect all of the distinct `fp` within `radius` bits."""
    cell = F.lit(0).cast("long")
    for quarter in range(_QUARTERS):
        part = F.shiftrightunsigned("fp", 16 * quarter).bitwiseAND(F.lit(0xFFFF).cast("long"))
        cell = cell * _SIDE + F.bit_count(part)
    held = fps.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toPandas()
    pieces = np.zeros(_SIDE ** _QUARTERS, dtype=np.int64)
    pieces[held["cell"].to_numpy(dtype=np.int64)] = np.ceil(held["n"].to_numpy() / tile)
    dealt = fps.select("fp").mapInArrow(_deal(pieces, radius), "tile long, visitor boolean, fp long")
    return (
        dealt.repartition("tile").sortWithinPartitions("tile", "visitor")
        .mapInArrow(_compare(radius), "a long, b long").distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every linked node."""
    links, seen = cut(links.select("a", "b").distinct(), "links"), None
    while True:
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lower.select("a", "m")).where("a <> b").distinct()
        )
        links = cut(small, "links")


def fingerprint_groups(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, root) for every distinct `fp` of `rows`."""
    fps = cut(rows.select("fp").distinct(), "fingerprints")
    roots = components(fingerprint_links(fps, radius, tile))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def find_near_copies(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id that links reach).

    A text without words, null too, has fingerprint 0 and links like any other. Null ids
    count only if their component has no other. No documents: no rows.
    """
    rows = cut(
        with_fingerprints(
            docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("whole")),
            F.col("whole"),
        ).drop("whole"),
        "simhash-rows",
    )
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = fingerprint_groups(rows, radius, tile).join(first, "fp")
    names = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(groups.join(names, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def drop_near_copies(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int | None = None
) -> DataFrame:
    """The row of the smallest id of each group, with all its columns.

    Rows are linked from a Jaccard similarity of 0.8 of their five-word shingles (see
    `minhash`), whatever their fingerprints; with `radius` also where their fingerprints
    differ in that many bits or fewer. A null id counts as the largest; of several rows
    with that id the first in the table stays. A scan of files is read again, not written.
    """
    rows = located(docs)
    narrow = rows.select(*PLACE, F.col(f"row.{id_col}").alias("id"), text_of(f"row.{text}").alias("whole"))
    printed = narrow if radius is None else with_fingerprints(narrow, F.col("whole"))
    keyed = cut(numbered(minhash.with_bands(printed, "whole"), "row_no"), "near-rows")
    crowd = cut(minhash.crowds(keyed), "near-crowds")
    wanted = keyed.select("row_no", *PLACE).join(crowd.select("row_no").distinct(), "row_no")
    texts = cut(
        narrow.join(wanted, PLACE).select("row_no", F.encode("whole", "UTF-8").alias("bytes")),
        "near-texts",
    )
    tried = cut(minhash.first_pairs(crowd), "near-pairs")
    roots = components(minhash.confirmed(tried, texts))
    links = minhash.tile_links(minhash.apart_tiles(crowd, roots), texts)
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)
    if radius is not None:
        links = links.union(_fingerprint_rows(keyed, radius))
    roots = components(links)
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no", *PLACE))
    stay = (
        keyed.drop("bands", "fp").join(roots.withColumnRenamed("node", "row_no"), "row_no", "left")
        .groupBy(F.coalesce("root", "row_no").alias("root")).agg(best.alias("best"))
        .select("best.file", "best.pos")
    )
    return rows.join(stay, PLACE, "left_semi").select("row.*")


def _fingerprint_rows(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (a > b) of each row with the first row of its group of fingerprints."""
    first = keyed.groupBy("fp").agg(F.min("row_no").alias("first"))
    groups = fingerprint_groups(keyed, radius).join(first, "fp")
    least = groups.groupBy("root").agg(F.min("first").alias("b"))
    named = cut(groups.join(least, "root").select("fp", "b"), "near-fingerprints")
    return keyed.select("fp", F.col("row_no").alias("a")).join(named, "fp").where("a > b").select(
        "a", "b"
    )
