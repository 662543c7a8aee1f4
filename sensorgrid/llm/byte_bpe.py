"""Byte-level BPE by a global shuffle of distinct words, and decoding by a join.

Encoding: texts are split into pre-tokens where they stand. Each block of documents explodes
into its distinct pre-tokens, numbered by falling frequency, and its documents become runs of
those numbers, position by position. The distinct pre-tokens travel by a hash, packed by
bucket, so that each distinct one of the whole table is encoded once; the ids go back to the
block that asked, and the documents are put together by position. A pre-token is sent at most
once per block, however often it occurs, so a frequent word is no hot key.

Decoding: each batch explodes into its distinct ids, which join the table of token bytes (its
size is that of the vocabulary, so it is broadcast); the rows that hold the positions follow
in the same stream, and the bytes are put together in order.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StructField, StructType,
)

from sensorgrid.llm.common import text_of

#: A block of documents ends behind the document that brings it to so many pre-tokens, or to
#: so many distinct ones.
BLOCK_TOKENS, BLOCK_WORDS = 6_000_000, 500_000
#: A block packs so many documents together that they hold a share of this of its tokens.
_CHUNKS = 20
#: Buckets of distinct pre-tokens per shuffle partition.
_BUCKETS = 4
_CODEC = "zstd"
#: Width of packed numbers: one plane per byte.
_PLANES = 3


class _Numbers(dict):
    """Number of each pre-token, in order of appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def squeeze(raw: bytes) -> bytes:
    """Compressed bytes behind their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def spread(packed: bytes) -> bytes:
    """The bytes behind `squeeze`."""
    return pa.decompress(
        packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec=_CODEC,
        asbytes=True,
    )


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 24 as compressed byte planes."""
    planes = np.asarray(numbers).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :_PLANES].T
    return squeeze(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    """The numbers behind `pack`."""
    raw = np.frombuffer(spread(packed), dtype=np.uint8).reshape(_PLANES, -1)
    planes = np.zeros((raw.shape[1], 4), dtype=np.uint8)
    planes[:, :_PLANES] = raw.T
    return planes.view("<u4").reshape(-1).astype(np.int64)


def _gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray, which: np.ndarray):
    """Pieces `which` of `flat` one after another, and their lengths."""
    lengths = count[which]
    ends = np.cumsum(lengths)
    places = np.repeat(first[which] - ends + lengths, lengths)
    places += np.arange(len(places))
    return flat[places], lengths


class _Block:
    """Documents between two cuts: their pre-tokens by number, and their kept columns."""

    def __init__(self, kept: pa.DataType):
        self.words, self.runs, self.rows, self.kept, self.tokens = _Numbers(), [], [], kept, 0

    def add(self, found: list[str], row: dict) -> None:
        self.runs.append(np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found)))
        self.rows.append(row)
        self.tokens += len(found)

    def full(self, limit: int) -> bool:
        return self.tokens >= limit or len(self.words) >= BLOCK_WORDS

    def batches(self, number: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """One row per bucket of distinct pre-tokens, then one per chunk of documents."""
        lengths = [len(run) for run in self.runs]
        numbers, self.runs = np.concatenate(self.runs), []
        words, self.words = list(map(str.encode, self.words)), None
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        numbers = rank[numbers]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        by_bucket = np.lexsort([rank, bucket])
        firsts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
        for own in np.split(by_bucket, firsts[1:]) if len(firsts) else []:
            asked = [words[i] for i in own.tolist()]
            yield self._row(
                number, bucket=int(bucket[own[0]]), ranks=pack(np.diff(rank[own], prepend=0)),
                sizes=pack([len(word) for word in asked]), body=squeeze(b"".join(asked)),
            )
        words.clear()
        start, chunk, low, limit = 0, 0, 0, self.tokens // _CHUNKS
        while start < len(lengths):
            end, held = start + 1, lengths[start]
            while end < len(lengths) and held + lengths[end] <= limit:
                held += lengths[end]
                end += 1
            yield self._row(
                number, at=chunk, body=pack(numbers[low:low + held]),
                docs=self.rows[start:end], lengths=lengths[start:end],
            )
            start, chunk, low = end, chunk + 1, low + held
        pa.default_memory_pool().release_unused()

    def _row(
        self, block, bucket=None, at=None, ranks=None, sizes=None, body=None, docs=None,
        lengths=None,
    ) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.array([bucket], pa.int32()),
                pa.array([at], pa.int32()), pa.array([ranks], pa.binary()),
                pa.array([sizes], pa.binary()), pa.array([body], pa.binary()),
                pa.array([docs], pa.list_(self.kept)), pa.array([lengths], pa.list_(pa.int32())),
            ],
            names=_COLUMNS,
        )


_COLUMNS = ["block", "bucket", "at", "ranks", "sizes", "body", "docs", "lengths"]


def _explode(pattern: str, block_tokens: int, buckets: int):
    """Blocks of the documents of a task: distinct pre-tokens, and documents as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block, number = None, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, texts = batch.column("kept"), batch.column("whole")
            for row, text in zip(rows, texts, strict=True):
                block = block or _Block(rows.type)
                block.add(find(text.as_py()), row.as_py())
                if block.full(block_tokens):
                    yield from block.batches(number, buckets)
                    block, number = None, number + 1
        if block:
            yield from block.batches(number, buckets)

    return run


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as lines:
        return {
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)
        }


_encoders: dict = {}


def _encoder(path: str, pattern: str):
    import tiktoken

    if (path, pattern) not in _encoders:  # a reused worker keeps it
        _encoders[path, pattern] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}
        )
    return _encoders[path, pattern]


def _encode_words(path: str, pattern: str):
    """Ids for each list of pre-tokens; the lists of a bucket follow each other.

    The ids of a bucket's distinct pre-tokens are kept until it ends. Documents pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        last, known = None, {}
        for batch in batches:
            out = {"sizes": [], "body": []}
            rows = [batch.column(n).to_pylist() for n in ("bucket", "sizes", "body")]
            for bucket, sizes, body in zip(*rows, strict=True):
                if bucket is not None:
                    if bucket != last:
                        last, known = bucket, {}
                    found, raw, start = [], spread(body), 0
                    for size in unpack(sizes).tolist():
                        word = raw[start:start + size]
                        start += size
                        if (ids := known.get(word)) is None:
                            ids = known[word] = encode(word.decode())
                        found.append(ids)
                    sizes = pack([len(ids) for ids in found])
                    body = pack([i for ids in found for i in ids])
                out["sizes"].append(sizes)
                out["body"].append(body)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {n: pa.array(v, pa.binary()) for n, v in out.items()}
            yield pa.RecordBatch.from_pydict(columns)

    return run


class _Ids:
    """Ids of the pre-tokens of one block, by number."""

    def __init__(self):
        self.ranks, self.sizes, self.bodies, self.first = [], [], [], None

    def add(self, ranks: bytes, sizes: bytes, body: bytes) -> None:
        self.ranks.append(np.cumsum(unpack(ranks)))
        self.sizes.append(unpack(sizes))
        self.bodies.append(unpack(body).astype(np.int32))

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens `which` one after another, and how many each has."""
        if self.first is None:
            ranks, sizes = (np.concatenate(a or [which[:0]]) for a in (self.ranks, self.sizes))
            self.flat = np.concatenate(self.bodies or [which[:0].astype(np.int32)])
            self.first, self.count = np.empty_like(sizes), np.empty_like(sizes)
            self.first[ranks], self.count[ranks] = np.cumsum(sizes) - sizes, sizes
        return _gather(self.flat, self.first, self.count, which)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block; the ids of its pre-tokens come first."""
    block, known = None, _Ids()
    for batch in batches:
        rows = [batch.column(n).to_pylist() for n in ("block", "ranks", "sizes", "body", "lengths")]
        for i, (number, ranks, sizes, body, lengths) in enumerate(zip(*rows, strict=True)):
            if number != block:
                block, known = number, _Ids()
            if lengths is None:
                known.add(ranks, sizes, body)
                continue
            found, counts = known.of(unpack(body))
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *lengths])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("docs")[i].values,
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found)),
                ],
                names=["kept", "ids"],
            )


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    out: str = "ids",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The columns `keep` of every document and its token ids as array<int> `out`.

    `ranks` is the path of a rank file that every worker can read, `pattern` splits texts into
    pre-tokens, each of which is encoded by itself; there are no special tokens. A null or
    empty text has no ids. Repeated rows are encoded each for themselves and may come back in
    any order; columns not in `keep` play no part, `out` must not be in it. No documents: no
    rows. Memory of a task: one block of pre-tokens, and one document beyond it.
    """
    kept = StructType([docs.schema[name] for name in keep])
    rows = docs.select(F.struct(*keep).alias("kept"), text_of(text).alias("whole"))
    carried = StructType([
        StructField("block", LongType()), StructField("bucket", IntegerType()),
        StructField("at", IntegerType()), StructField("ranks", BinaryType()),
        StructField("sizes", BinaryType()), StructField("body", BinaryType()),
        StructField("docs", ArrayType(kept)), StructField("lengths", ArrayType(IntegerType())),
    ])
    # a set number, as small partitions hold much work here
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = rows.mapInArrow(_explode(pattern, block_tokens, parts * _BUCKETS), carried)
    place = F.coalesce(F.col("bucket").cast("long"), F.xxhash64("block", "at"))
    encoded = exploded.repartition(parts, place).sortWithinPartitions("bucket").mapInArrow(
        _encode_words(ranks, pattern), carried
    )
    ordered = encoded.repartition(parts, "block").sortWithinPartitions(
        "block", F.col("lengths").isNotNull(), "at"
    )
    done = ordered.mapInArrow(_reassemble, StructType([
        StructField("kept", kept), StructField("ids", ArrayType(IntegerType())),
    ]))
    return done.select("kept.*", F.col("ids").alias(out))


def token_table(spark: SparkSession, ranks: str) -> DataFrame:
    """Rows (id, piece) of a rank file: as many as its vocabulary."""
    found = read_ranks(ranks)
    return spark.createDataFrame(
        pa.table({
            "id": pa.array(list(found.values()), pa.int32()),
            "piece": pa.array(list(found), pa.binary()),
        })
    )


def _explode_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch one row per distinct id, then its rows."""
    for number, batch in enumerate(batches):
        kept, ids = batch.column("row"), batch.column("ids")
        distinct = pc.unique(ids.flatten()).drop_null()
        blank = len(distinct)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number] * blank, pa.int64()), distinct.cast(pa.int32()),
                pa.nulls(blank, kept.type), pa.nulls(blank, ids.type),
            ],
            names=["batch", "id", "row", "ids"],
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number] * len(kept), pa.int64()), pa.nulls(len(kept), pa.int32()),
                kept, ids,
            ],
            names=["batch", "id", "row", "ids"],
        )


class _Pieces:
    """Bytes of the distinct ids of one batch."""

    def __init__(self):
        self.ids, self.bytes, self.sorted = [], [], None

    def add(self, rows: pa.RecordBatch) -> None:
        if self.sorted is not None:
            raise ValueError("a piece came behind the rows that use it")
        self.ids += rows.column("id").to_pylist()
        self.bytes += [piece or b"" for piece in rows.column("piece").to_pylist()]

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of `ids` one after another."""
        if not len(ids):
            return b""
        if self.sorted is None:
            order = np.argsort(self.ids)
            pieces = [self.bytes[i] for i in order.tolist()]
            self.sorted = np.array(self.ids, dtype=np.int32)[order]
            self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            self.count = np.array([len(piece) for piece in pieces], dtype=np.int32)
            self.first = np.cumsum(self.count, dtype=np.int32) - self.count
        place = np.searchsorted(self.sorted, ids)
        return _gather(self.flat, self.first, self.count, place)[0].tobytes()


def _reassemble_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each row; the pieces of its batch come before it."""
    number, known = None, _Pieces()
    for batch in batches:
        own = batch.column("batch").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            if own[low] != number:
                number, known = own[low], _Pieces()
            is_piece = part.column("id").is_valid()
            pieces, rows = part.filter(is_piece), part.filter(pc.invert(is_piece))
            if pieces.num_rows:
                known.add(pieces)
            if not rows.num_rows:
                continue
            done = [
                known.join(own.values.drop_null().to_numpy()) if own.is_valid else b""
                for own in rows.column("ids")
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), pa.array(done, pa.binary())], names=["kept", "bytes"]
            )


def decode(
    encoded: DataFrame, table: DataFrame, ids: str = "ids", out: str = "bytes"
) -> DataFrame:
    """All columns of `encoded` but the int array `ids`, and the bytes of its ids as `out`.

    `table` has the rows (id, piece) of a vocabulary. A null or empty array has no bytes; a
    null id, or one that the table lacks, adds none. Repeated rows stay apart. The join keeps
    the order of the stream as its small side is broadcast; the task that puts the bytes
    together checks it. No rows: no rows. `encoded` must have a column besides `ids`.
    """
    kept = StructType([field for field in encoded.schema if field.name != ids])
    row = StructField("row", kept)
    pieces = F.broadcast(table.select("id", "piece"))
    exploded = encoded.select(
        F.struct(*[F.col(f"`{name}`") for name in kept.names]).alias("row"),
        F.col(ids).alias("ids"),
    ).mapInArrow(_explode_ids, StructType([
        StructField("batch", LongType()), StructField("id", IntegerType()), row,
        StructField("ids", ArrayType(IntegerType())),
    ]))
    return (
        exploded.join(pieces, "id", "left")
        .mapInArrow(
            _reassemble_bytes,
            StructType([StructField("kept", kept), StructField("bytes", BinaryType())]),
        )
        .select("kept.*", F.col("bytes").alias(out))
    )
