"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A document's key is its text, so equal texts meet the ring at one point and share a shard
as long as it has room. The ring has 2 ** 16 points. Each shard owns `vnodes` of them; the
keys up to such a point belong to its shard.

What is dealt are items, larger ones first: each goes whole to its own shard or, where that
lacks room, to the next one clockwise that has it, so no shard passes (1 + slack) times the
mean. An item is a ring point or, where a point holds more than `slack` of a shard, one of
its parts by a second hash of the rows. An item of at most that size always finds room, as
the room left over all shards is at least `slack` of the whole. A larger one is a part with
a document of that size in it; it comes early, and goes to the emptiest shard if all are
short. The walk needs the bytes of at most 65,536 points and of at most
(4 + 1) * shards / slack parts, whatever the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.llm.common import cut, numbered, part_of, place_of, text_of

_POINT_BITS = 16
#: a point that is cut has this many parts per `slack` of a shard
_PARTS = 4


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the virtual nodes in ring order, and the shard of each."""
    nodes = sorted(
        (
            int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=2).digest(), "big"),
            s,
        )
        for s in range(shards)
        for v in range(vnodes)
    )
    return np.array([p for p, _ in nodes]), np.array([s for _, s in nodes])


def walk(point: np.ndarray, size: np.ndarray, shards: int, vnodes: int, slack: float) -> np.ndarray:
    """Shard of every item, given its ring point and its bytes. Ties go by place in the arrays."""
    points, owner = ring(shards, vnodes)
    # shards in the order in which a walk from each node first meets them
    clockwise = np.array([
        owner[np.roll(np.arange(len(owner)), -node)][
            np.sort(np.unique(np.roll(owner, -node), return_index=True)[1])]
        for node in range(len(owner))
    ])
    node = np.searchsorted(points, point) % len(points)
    room = np.full(shards, int(np.ceil(size.sum() * (1 + slack) / shards)), dtype=np.int64)
    out = np.empty(len(point), dtype=np.int64)
    for item in np.argsort(-size, kind="stable"):
        order = clockwise[node[item]]
        fits = room[order] >= size[item]
        shard = order[np.argmax(fits if fits.any() else room[order])]
        room[shard] -= size[item]
        out[item] = shard
    return out


def assign_shards(
    docs: DataFrame,
    shards: int = 16,
    vnodes: int = 64,
    slack: float = 0.002,
    text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    A size is the UTF-8 bytes of the text plus 1; a null text is empty. Slots count from 0
    in each shard, in the order in which the rows are read. Repeated rows and null ids are
    rows like any other. No documents: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text_of(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text_of(text), "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text_of(text)), 64 - _POINT_BITS).cast("int").alias("point"),
    )
    rows = cut(numbered(rows, "row_no"), "shard-rows")
    held = rows.groupBy("point").agg(F.sum("size").alias("held")).toPandas().sort_values("point")
    unit = max(1.0, float(held["held"].sum()) * slack / shards)
    held["parts"] = np.where(
        held["held"] > unit, np.ceil(held["held"].astype(float) * _PARTS / unit), 1
    ).astype(np.int64)
    cut_points = held[held["parts"] > 1]
    parts_of = spark.createDataFrame(
        cut_points[["point", "parts"]].astype("int32"), "point int, parts int"
    )

    # tables of items have the bounds stated above, so they are broadcast
    rows = rows.join(F.broadcast(parts_of), "point", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("doc_id", "row_no"), F.col("parts")), F.lit(-1))
    )
    inside = (
        rows.where("parts is not null").groupBy("point", "piece")
        .agg(F.sum("size").alias("held")).toPandas().sort_values(["point", "piece"])
    )
    items = pd.concat([
        held[held["parts"] == 1][["point", "held"]].assign(piece=-1),
        inside[["point", "held", "piece"]],
    ], ignore_index=True).astype(np.int64)
    items["shard"] = walk(
        items["point"].to_numpy(), items["held"].to_numpy(), shards, vnodes, slack
    )
    shard_of = spark.createDataFrame(
        items[["point", "piece", "shard"]], "point long, piece long, shard long"
    ).select(F.col("point").cast("int"), "piece", F.col("shard").cast("int"))
    placed = rows.join(F.broadcast(shard_of), ["point", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard",
        part_of("row_no").alias("part"), place_of("row_no").alias("place"),
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    order = Window.partitionBy("shard", "part").orderBy("place")
    return (
        placed.withColumn("nth", F.row_number().over(order) - 1)
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", "shard",
            (F.col("offset") + F.col("nth")).cast("long").alias("slot"),
        )
    )
