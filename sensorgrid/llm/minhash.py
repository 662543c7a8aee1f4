"""Near copies by MinHash bands, confirmed by the Jaccard similarity of word shingles.

A text is the set of its runs of five words. Its 120 minimal hashes form 24 bands of five;
texts of one band key are candidates. Two texts of similarity 0.8 share a band with
probability 1 - (1 - 0.8 ** 5) ** 24 = 0.99993, at 0.3 with 0.06, so work follows the rows and
not their square. Every candidate pair is decided by the shingles themselves.

A crowded band is settled in two rounds. First each text meets one pivot of its band, another
in each band; texts that links connect are then one. In the second round what a band leaves
outside its largest group meets the whole band in tiles, by products of shingle matrices; a
tile gives at most one link per text and other group, so pairs are never rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

WORDS = 5
#: least similarity, as a ratio of whole numbers
LEAST = (4, 5)
BANDS, BAND_ROWS = 24, 5
_SEED = 42
_AT_ONCE = 2048
#: Rows on each side of a tile, and shingles that are multiplied at a time.
TILE, _COLUMNS = 512, 8192
_draw = np.random.default_rng(_SEED)
_FACTORS = _draw.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _draw.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(data: bytes, width: int = WORDS) -> set[bytes]:
    """Runs of `width` words of a UTF-8 text; a shorter text is one run, even without words."""
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    return {
        b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))
    }


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity reaches LEAST."""
    up, down = LEAST
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    both = len(a & b)
    return down * both >= up * (len(a) + len(b) - both)


def band_keys(data: bytes) -> list[int]:
    """One signed long per band; equal minimal hashes give equal keys."""
    hashes = np.array([xxhash.xxh64_intdigest(s, _SEED) for s in shingles(data)], dtype=np.uint64)
    least = np.full(len(_FACTORS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), _AT_ONCE):
        mixed = (hashes[at:at + _AT_ONCE, None] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, mixed.min(axis=0))
    raw, size = least.tobytes(), 8 * BAND_ROWS
    keys = [xxhash.xxh64_intdigest(raw[at:at + size], at) for at in range(0, len(raw), size)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [band_keys(b) for b in batch.column("bytes").to_pylist()]
        columns = {n: batch.column(n) for n in batch.schema.names if n != "bytes"}
        columns["bands"] = pa.array(found, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(columns)


def with_bands(rows: DataFrame, text: str) -> DataFrame:
    """`rows` without `text` and with `bands`, its band keys."""
    kept = rows.withColumn("bytes", F.encode(text, "UTF-8")).drop(text)
    schema = StructType([f for f in kept.schema.fields if f.name != "bytes"])
    return kept.mapInArrow(_keys, schema.add("bands", ArrayType(LongType())))


def crowds(keyed: DataFrame) -> DataFrame:
    """(row_no, band, key, pivot) of every row that shares the key of a band."""
    members = keyed.select("row_no", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min_by("row_no", F.xxhash64("row_no", "band")).alias("pivot")
    ).where("n > 1").drop("n")
    return members.join(shared, ["band", "key"])


def _pair(left: str, right: str) -> list:
    return [F.greatest(left, right).alias("a"), F.least(left, right).alias("b")]


def first_pairs(crowd: DataFrame) -> DataFrame:
    """Pairs (a > b) of each row with the pivots of its bands."""
    return crowd.where("row_no <> pivot").select(*_pair("row_no", "pivot")).distinct()


def apart_tiles(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """What is left to compare, as tiles of bands whose rows the links behind `roots` leave apart.

    Rows (band, key, rest_tile, tile, member, row_no, root, main): per band the rows outside its
    largest group, `member` 0, meet all its rows, `member` 1, in tiles of at most about
    TILE * TILE. A row is sent once per tile of the other side, so rows follow
    n * ceil(rest / TILE), not the pairs.
    """
    bucket = ["band", "key"]
    known = crowd.join(roots.withColumnRenamed("node", "row_no"), "row_no", "left").select(
        *bucket, "row_no", F.coalesce("root", "row_no").alias("root")
    )
    apart = (
        known.groupBy(*bucket, "root").agg(F.count("*").alias("n"))
        .groupBy(*bucket).agg(
            F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("groups"),
            F.max_by("root", F.struct("n", "root")).alias("main"),
        )
        .where("groups > 1")
    )
    sides = known.join(apart, bucket).select(
        *bucket, "row_no", "root", "main",
        F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("rest_tiles"),
        F.ceil(F.col("all") / TILE).cast("int").alias("tiles"),
    )

    def dealt(count: str):
        return F.pmod(F.xxhash64("row_no"), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    kept = [*bucket, "row_no", "root", "main"]
    rest = sides.where("root <> main").select(
        *kept, dealt("rest_tiles").alias("rest_tile"), each("tiles").alias("tile"),
        F.lit(0).alias("member"),
    )
    members = sides.select(
        *kept, each("rest_tiles").alias("rest_tile"), dealt("tiles").alias("tile"),
        F.lit(1).alias("member"),
    )
    return rest.union(members)


def hashed_shingles(data: bytes) -> np.ndarray:
    """Sorted XXH64 of the shingles of a text."""
    found = [xxhash.xxh64_intdigest(s, _SEED) for s in shingles(data)]
    return np.unique(np.array(found, dtype=np.uint64))


def similar_rows(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of which hashed sets reach LEAST, from one product per block of shingles."""
    words = np.unique(np.concatenate(left))
    both = np.zeros((len(left), len(right)), dtype=np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[at] == flat
        return row[hit], at[hit]

    (rows, at), (columns, with_at) = places(left), places(right)
    for low in range(0, len(words), _COLUMNS):
        dense = []
        for row, place, count in ((rows, at, len(left)), (columns, with_at, len(right))):
            own = (place >= low) & (place < low + _COLUMNS)
            block = np.zeros((count, min(_COLUMNS, len(words) - low)), dtype=np.float32)
            block[row[own], place[own] - low] = 1
            dense.append(block)
        both += dense[0] @ dense[1].T
    up, down = LEAST
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    return down * both >= up * (sizes - both)


class _Tile:
    """The rows outside the main group of one tile; others stream by."""

    def __init__(self, key: tuple):
        self.key, self.row_no, self.root, self.sets = key, [], [], []
        self.linked: set[tuple[int, int]] = set()

    def links(self, row_no: list, root: list, main: list, texts: list) -> Iterator[tuple]:
        """One link (a > b) per row of the tile and other group that reaches it."""
        if not self.sets or not texts:
            return
        own, other = np.array(self.root), np.array(root)
        apart = own[:, None] != other[None, :]
        apart &= (other == np.array(main))[None, :] | (
            np.array(self.row_no)[:, None] < np.array(row_no)[None, :]
        )
        near = similar_rows(self.sets, [hashed_shingles(t) for t in texts]) & apart
        for i, j in zip(*(a.tolist() for a in np.nonzero(near))):
            if (self.row_no[i], root[j]) not in self.linked:
                self.linked.add((self.row_no[i], root[j]))
                yield max(self.row_no[i], row_no[j]), min(self.row_no[i], row_no[j])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of tiles that come one after another, the rows outside the main group first."""
    tile, found = _Tile(()), []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in (
            "band", "key", "rest_tile", "tile", "member", "row_no", "root", "main", "bytes"
        )]
        for key, rows in itertools.groupby(zip(*columns, strict=True), lambda r: r[:5]):
            if key[:4] != tile.key:
                tile = _Tile(key[:4])
            row_no, root, main, texts = map(list, zip(*(r[5:] for r in rows)))
            if key[4]:
                for at in range(0, len(texts), TILE):
                    part = slice(at, at + TILE)
                    found += tile.links(row_no[part], root[part], main[part], texts[part])
            else:
                tile.row_no += row_no
                tile.root += root
                tile.sets += [hashed_shingles(t) for t in texts]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            found = []


def tile_links(tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a > b) between rows of one tile in different groups whose texts are similar."""
    tile = ["band", "key", "rest_tile", "tile"]
    return (
        tiles.join(texts, "row_no").repartition(*tile).sortWithinPartitions(*tile, "member")
        .select(*tile, "member", "row_no", "root", "main", "bytes")
        .mapInArrow(_compare, "a long, b long")
    )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, set()
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        rows = zip(a, b, batch.column("bytes_a"), batch.column("bytes_b"), strict=True)
        kept = []
        for i, (_, right, bytes_a, bytes_b) in enumerate(rows):
            if right != last:
                last, held = right, shingles(bytes_b.as_py())
            if similar(shingles(bytes_a.as_py()), held):
                kept.append(i)
        yield pa.RecordBatch.from_pydict({
            "a": pa.array([a[i] for i in kept], pa.int64()),
            "b": pa.array([b[i] for i in kept], pa.int64()),
        })


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts are similar; `texts` has row_no and bytes."""
    for side in ("a", "b"):
        pairs = pairs.join(
            texts.select(F.col("row_no").alias(side), F.col("bytes").alias(f"bytes_{side}")), side
        )
    return pairs.select("a", "b", "bytes_a", "bytes_b").mapInArrow(_confirm, "a long, b long")
