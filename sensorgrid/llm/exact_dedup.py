"""Exact de-duplication with an extendible-hash index in shared files.

The key of a text is its SHA-256, the directory is addressed by the key's leading bits.
Starting from one bucket, the directory doubles and splits every bucket that holds more
than `capacity` bytes, until no bucket is overfull, holds a single address, or is
`max_depth` bits deep. Each bucket is a key range with one owner task. Copies are combined
within each batch before they move, so a huge group reaches its owner as a few entries.
The owner sorts its entries by key, chains entries of one key and compares their bytes, and
writes its bucket file. Memory: one batch and one chain per task; the directory has at most
2 ** max_depth addresses, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sensorgrid.llm.common import cut, text_of

_ENTRY_BYTES = 64


def sha256_key(text: Column) -> Column:
    """SHA-256 of a text in hex."""
    return F.sha2(text, 256)


def split_directory(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket number of every address, in key order.

    `sizes` holds the bytes per address (a power of two of them). A bucket of more than
    `capacity` bytes is halved while at least two of its addresses hold anything.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    used = np.concatenate([[0], np.cumsum(sizes > 0)])
    bucket = np.zeros(len(sizes), dtype=np.int32)
    found, waiting = 0, [(0, len(sizes))]
    while waiting:
        low, high = waiting.pop()
        if total[high] - total[low] > capacity and used[high] - used[low] > 1:
            middle = (low + high) // 2
            waiting += [(middle, high), (low, middle)]
        else:
            bucket[low:high] = found
            found += 1
    return bucket


def _combine(bucket_of: np.ndarray):
    """Entries of each batch: one per distinct text, with its copies and its best row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple, list[int]] = {}
            ids = batch.column("keep_id").to_pylist()
            pairs = zip(
                batch.column("key").to_pylist(), batch.column("bytes").to_pylist(), strict=True
            )
            for i, pair in enumerate(pairs):
                seen = best.get(pair)
                if seen is None:
                    best[pair] = [i, 1]
                    continue
                seen[1] += 1
                old = ids[seen[0]]
                if ids[i] is not None and (old is None or ids[i] > old):
                    seen[0] = i
            kept = batch.take(pa.array([i for i, _ in best.values()], pa.int64()))
            columns = {name: kept.column(name) for name in kept.schema.names}
            slots = columns.pop("slot").to_numpy(zero_copy_only=False)
            columns["bucket"] = pa.array(bucket_of[slots], pa.int32())
            columns["copies"] = pa.array([n for _, n in best.values()], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of one owner: entries come sorted by key, the best row of a key first.

    The chain of a key holds one link per distinct text; links are told apart by bytes.
    """
    open_key, chain = None, []  # chain: [bytes, copies, one-row batch]

    def closed(links: list) -> pa.RecordBatch | None:
        if not links:
            return None
        rows = pa.Table.from_batches([row for *_, row in links]).combine_chunks().to_batches()[0]
        columns = {n: rows.column(n) for n in rows.schema.names if n != "copies"}
        chains: dict = {}
        for key in columns["key"].to_pylist():
            chains[key] = chains.get(key, 0) + 1
        place: dict = {}
        links_no = []
        for key in columns["key"].to_pylist():
            links_no.append(place.get(key, 0))
            place[key] = links_no[-1] + 1
        of_key = [chains[key] for key in columns["key"].to_pylist()]
        columns["bytes"] = pa.array(
            [b if n > 1 else None for (b, *_), n in zip(links, of_key, strict=True)], pa.binary()
        )
        columns["link"] = pa.array(links_no, pa.int32())
        columns["links"] = pa.array(of_key, pa.int32())
        columns["copies"] = pa.array([n for _, n, _ in links], pa.int64())
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        done: list = []
        keys, texts = batch.column("key").to_pylist(), batch.column("bytes").to_pylist()
        copies = batch.column("copies").to_pylist()
        for i, key in enumerate(keys):
            if key != open_key:
                done += chain
                open_key, chain = key, []
            for link in chain:
                if link[0] == texts[i]:
                    link[1] += copies[i]
                    break
            else:
                chain.append([texts[i], copies[i], batch.slice(i, 1)])
        if (out := closed(done)) is not None:
            yield out
    if (out := closed(chain)) is not None:
        yield out


def build_index(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    carry_rows: bool = False,
    capacity: int = 32 << 20,
    max_depth: int = 16,
    key: Callable[[Column], Column] = sha256_key,
) -> DataFrame:
    """Index of the distinct texts, as a table in the shared folder.

    Columns: key, bucket, link and links (place in the chain of the key and its length),
    copies (rows with this text), keep_id (the largest id of them), bytes (the text in
    UTF-8, only where several texts share the key) and, if `carry_rows`, `row` (the whole
    row of keep_id; of several rows with that id one). A null text is the empty text; a null
    id is smaller than any other. No documents: no rows.
    """
    keyed = docs.select(
        key(text_of(text)).alias("key"),
        F.encode(text_of(text), "UTF-8").alias("bytes"),
        F.col(id_col).cast("long").alias("keep_id"),
        *([F.struct("*").alias("row")] if carry_rows else []),
    ).withColumn(
        "slot", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - max_depth)
        .cast("int"),
    )
    held = (
        keyed.groupBy("slot")
        .agg(F.sum(F.length("bytes") + F.lit(_ENTRY_BYTES)).alias("held"))
        .toPandas()
    )
    sizes = np.zeros(1 << max_depth, dtype=np.int64)
    sizes[held["slot"].to_numpy(dtype=np.int64)] = held["held"].to_numpy(dtype=np.int64)
    bucket_of = split_directory(sizes, capacity)

    fields = [f for f in keyed.schema.fields if f.name != "slot"]
    entries = keyed.mapInArrow(
        _combine(bucket_of),
        _ddl(fields, "bucket int, copies long"),
    )
    owned = entries.repartitionById(int(bucket_of[-1]) + 1, F.col("bucket")).sortWithinPartitions(
        "key", F.desc_nulls_last("keep_id")
    )
    index = owned.mapInArrow(_chain, _ddl(fields, "bucket int, link int, links int, copies long"))
    return cut(index, "exact-index")


def _ddl(fields: list[StructField], more: str) -> StructType:
    schema = StructType(list(fields))
    for column in more.split(","):
        name, kind = column.split()
        schema = schema.add(name, {"int": IntegerType(), "long": LongType()}[kind])
    return schema


def find_copies(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", **index_options
) -> DataFrame:
    """One row per document: id, key, keep_id, group_size, kept.

    Of equal texts the row with the largest id stays; of repeated rows with that id one.
    """
    index = build_index(docs, text, id_col, **index_options)
    key = index_options.get("key", sha256_key)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        key(text_of(text)).alias("key"),
        text_of(text).alias("whole"),
    )
    plain = _with_group(rows.drop("whole"), index.where("links = 1").drop("bytes"), ["key"])
    shared = index.where("links > 1")
    if shared.isEmpty():
        return plain
    # keys that several texts share: the group is found by the text itself
    texts = shared.withColumn("whole", F.decode("bytes", "UTF-8")).drop("bytes")
    return plain.unionByName(_with_group(rows, texts, ["key", "whole"]))


def _with_group(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their group; equal rows are counted before they move."""
    counted = rows.groupBy("doc_id", *on).agg(F.count("*").alias("repeats"))
    return (
        counted.join(groups.select(*on, "keep_id", "copies"), on)
        .withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
        .select(
            "doc_id", "key", "keep_id", F.col("copies").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"),
        )
    )


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with all their columns, straight from the index."""
    return build_index(docs, text, id_col, carry_rows=True).select("row.*")
