"""Removal of long repeated byte strings with run-compressed suffix indexes.

A byte goes if a string of `length` bytes that covers it starts anywhere else too.

1. Every window of `length` bytes has an anchor: the least hash of its 32-byte strings, the
   leftmost of equals. Equal windows have equal anchors at equal places, so windows need only
   be compared among those of one anchor. The windows of an anchor are consecutive starts;
   the bytes they cover are its context.
2. Contexts that occur twice or more, by a 128-bit digest, are repeats as a whole. This
   settles nearly everything, and the counts combine before they are shuffled.
3. What is left are contexts that occur once, beside others of the same anchor. Their bytes
   are gathered by anchor into shards of about a megabyte. For each shard a suffix order
   gives a Burrows-Wheeler transform, of which only the run ends are kept, with their text
   positions. At a run end the match with the neighbouring suffix can not be extended to the
   left; matching statistics stream on from there, one less at each step. So the matches at
   run ends of at least `length` bytes mark all repeated windows of the shard.
4. An anchor with more than `crowd` different contexts (a short passage inside very many
   documents) is split by the bytes that all windows of 16, then of one start have in common.
   No anchor is too frequent, and no group is written out as pairs.

Texts are handled in pieces of about a megabyte, shards hold about as much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import cut, text_of

LENGTH = 400
CROWD = 1000
_PIECE = 1 << 20
_SEED = 32
_WIDTHS = (16, 1)
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64
)
_OCCURRENCE = "h long, digest binary, tid binary, low int, high int, anchor int, n long"
_MARK = "tid binary, low int, high int"


def text_id(data: Column) -> Column:
    """128 bits that stand for a text."""
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position."""
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    n = len(data) - _SEED + 1
    total = words[:n] * _FACTORS[0]
    for i in range(1, 4):
        total ^= total >> np.uint64(31)
        total += words[8 * i:8 * i + n]
        total *= _FACTORS[i]
    total ^= total >> np.uint64(29)
    total *= _FACTORS[0]
    total ^= total >> np.uint64(32)
    return total


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of the window from each start, and the hashes of all positions."""
    hashes = seed_hashes(data)
    least = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    width, have = length - _SEED + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64), hashes


def _pieces(tids: list, texts: list, length: int) -> Iterator[list[tuple]]:
    """Lists of (tid, base, bytes) of about a piece; pieces of a text share no window."""
    found, held = [], 0
    for tid, text in zip(tids, texts, strict=True):
        for base in range(0, max(1, len(text) - length + 1), _PIECE):
            part = text[base:base + _PIECE + length - 1]
            if len(part) < length:
                continue
            if found and held + len(part) > _PIECE:
                yield found
                found, held = [], 0
            found.append((tid, base, part))
            held += len(part)
    if found:
        yield found


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _as_rows(columns: dict[str, list], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(v, kinds[n]) for n, v in columns.items()})


_KINDS = {
    "h": pa.int64(), "digest": pa.binary(), "tid": pa.binary(), "low": pa.int32(),
    "high": pa.int32(), "anchor": pa.int32(), "n": pa.int64(), "context": pa.binary(),
}


def _occurrences(length: int):
    """Anchors of each text with the range of their windows and the digest of their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies: dict[bytes, list] = {}
            pairs = zip(
                batch.column("tid").to_pylist(), batch.column("bytes").to_pylist(), strict=True
            )
            for tid, data in pairs:
                copies.setdefault(tid, [data, 0])[1] += 1
            long = {t: c for t, c in copies.items() if len(c[0]) >= length}
            for group in _pieces(list(long), [c[0] for c in long.values()], length):
                data = b"".join(part for *_, part in group)
                anchor, hashes = anchors(np.frombuffer(data, np.uint8), length)
                sizes = np.array([len(part) for *_, part in group])
                firsts = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(len(group)), sizes)[:len(anchor)]
                inside = np.arange(len(anchor)) + length <= (firsts + sizes)[owner]
                change = np.ones(len(anchor), bool)
                change[1:] = (
                    (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                    | (inside[1:] != inside[:-1])
                )
                low = np.flatnonzero(change)
                high = np.append(low[1:], len(anchor)) - 1
                low, high = low[inside[low]], high[inside[low]]
                own, view = owner[low], memoryview(data)
                base = np.array([b for _, b, _ in group])[own] - firsts[own]
                names = [group[i][0] for i in own.tolist()]
                yield _as_rows({
                    "h": hashes[anchor[low]].view(np.int64),
                    "digest": [
                        _digest(view[a:b + length])
                        for a, b in zip(low.tolist(), high.tolist(), strict=True)
                    ],
                    "tid": names, "low": (low + base).astype(np.int32),
                    "high": (high + base).astype(np.int32),
                    "anchor": (anchor[low] + base).astype(np.int32),
                    "n": [copies[t][1] for t in names],
                }, _KINDS)

    return run


def _refine(length: int, width: int):
    """Occurrences of crowded anchors, cut into ranges of `width` starts by what these share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _KINDS if n != "context"}
            for row in batch.to_pylist():
                data, low, high, anchor = row["bytes"], row["low"], row["high"], row["anchor"]
                # ranges are aligned to the anchor, so that equal windows share them
                for step in range((anchor - high) // width, (anchor - low) // width + 1):
                    first = max(low, anchor - step * width - width + 1)
                    last = min(high, anchor - step * width)
                    if first > last:
                        continue
                    at = anchor - step * width
                    core = data[at:at - width + 1 + length]
                    key = _digest(row["h"].to_bytes(8, "big", signed=True) + bytes([step & 255])
                                  + (step >> 8).to_bytes(4, "big", signed=True) + core)
                    out["h"].append(int.from_bytes(key[:8], "big", signed=True))
                    out["digest"].append(_digest(data[first:last + length]))
                    out["tid"].append(row["tid"])
                    out["low"].append(first)
                    out["high"].append(last)
                    out["anchor"].append(anchor)
                    out["n"].append(row["n"])
            yield _as_rows(out, _KINDS)

    return run


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(
                batch.column("bytes").to_pylist(), batch.column("low").to_pylist(),
                batch.column("high").to_pylist(), strict=True,
            )
            columns = {n: batch.column(n) for n in ("h", "tid", "low")}
            columns["context"] = pa.array(
                [data[low:high + length] for data, low, high in rows], pa.binary()
            )
            yield pa.RecordBatch.from_pydict(columns)

    return run


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of symbols in which every 0 is an end of its own, sorted by place."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(7):  # seven symbols of nine bits
        here = padded[i:i + n]
        key = (key << 9) | np.where(alive, here, 0)
        alive &= here > 0
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | ~alive[order[1:]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    same = np.append(~new[1:], False) | ~new  # in a group of more than one
    place = np.flatnonzero(same)
    reach = 7
    while len(place):
        here = order[place]
        group = rank[here]
        after = np.minimum(here + reach, n - 1)
        key = group * (n + 1) + np.where(here + reach < n, rank[after] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        here, key, group = here[by_key], key[by_key], group[by_key]
        order[place] = here
        new = np.ones(len(place), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        rank[here] = place[start]
        same = np.append(~new[1:], False) | ~new
        place = place[same]
        reach *= 2
    return order


def run_ends(symbols: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text positions at the two sides of every border between runs of the transform."""
    before = np.where(order > 0, symbols[order - 1], 0)
    border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0))
    return order[border], order[border + 1]


def match_lengths(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bytes that agree from `left` and from `right` on; `data` ends in eight zeros."""
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    found = np.zeros(len(left), np.int64)
    open_ = np.arange(len(left))
    while len(open_):
        a, b = left[open_] + found[open_], right[open_] + found[open_]
        fits = np.maximum(a, b) < len(words)
        open_, a, b = open_[fits], a[fits], b[fits]
        apart = words[a] ^ words[b]
        lowest = apart & (~apart + np.uint64(1))
        equal = np.where(apart == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3)
        found[open_] += equal
        open_ = open_[apart == 0]
    return found


def repeated_ranges(contexts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(context, low, high): starts of windows that occur elsewhere in the contexts too."""
    data = np.frombuffer(b"\x00".join(contexts) + bytes(9), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes) - 1
    n = int(ends[-1]) + 1
    symbols = data[:n].astype(np.int64) + 1
    symbols[ends] = 0
    left, right = run_ends(symbols, suffix_order(symbols))
    owner = np.repeat(np.arange(len(contexts)), sizes)
    equal = match_lengths(data, left, right)
    room = np.minimum(ends[owner[left]] - left, ends[owner[right]] - right)
    equal = np.minimum(equal, room)
    hit = equal >= length
    out = []
    for side in (left[hit], right[hit]):
        own = owner[side]
        low = side - (ends[own] - sizes[own] + 1)
        out += zip(own.tolist(), low.tolist(), (low + equal[hit] - length).tolist(), strict=True)
    return out


def _index_shards(length: int):
    """Marks of the repeated windows of each shard; contexts come sorted by anchor."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_ranges([context for *_, context in rows], length)
        return _as_rows({
            "tid": [rows[i][0] for i, *_ in found],
            "low": [rows[i][1] + low for i, low, _ in found],
            "high": [rows[i][1] + high for i, _, high in found],
        }, _KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, last = [], 0, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("h", "tid", "low", "context")]
            for h, tid, low, context in zip(*columns, strict=True):
                if h != last and held > _PIECE:
                    yield marks(shard)
                    shard, held = [], 0
                shard.append((tid, low, context))
                held += len(context)
                last = h
        if shard:
            yield marks(shard)

    return run


def _settle(found: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks of contexts that occur again, and the contexts that are left, by anchor."""
    counted = found.groupBy("h", "digest").agg(
        F.sum("n").alias("n"), F.min(F.struct("tid", "low", "high", "anchor")).alias("one")
    )
    by_anchor = counted.groupBy("h").agg(
        F.count("*").alias("contexts"), F.count(F.when(F.col("n") == 1, 1)).alias("single"),
        F.sum("n").alias("total"),
    ).where("total > 1")
    kinds = cut(counted.join(by_anchor, "h"), "repeat-contexts")
    again = kinds.where("n > 1").select("h", "digest")
    marks = found.join(again, ["h", "digest"]).select("tid", "low", "high")
    left = kinds.where("contexts > 1 and single > 0").select("h", "n", "contexts", "one.*")
    return (
        marks, left.where(F.col("contexts") <= crowd).drop("contexts"),
        left.where(F.col("contexts") > crowd).drop("contexts"),
    )


def find_repeats(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(tid, low, high): ranges of window starts to remove. `rows` has tid and bytes."""
    texts = rows.select("tid", "bytes").where(F.length("bytes") >= length)
    found = cut(texts.mapInArrow(_occurrences(length), _OCCURRENCE), "repeat-anchors")
    marks, left, crowded = _settle(found, crowd)

    def with_bytes(wanted: DataFrame) -> DataFrame:
        """The wanted contexts with the bytes of their text."""
        by_text = wanted.groupBy("tid").agg(
            F.collect_list(F.struct("h", "low", "high", "anchor", "n")).alias("w")
        )
        once = texts.groupBy("tid").agg(F.first("bytes").alias("bytes"))
        return once.join(by_text, "tid").select(
            "tid", "bytes", F.explode("w").alias("w")
        ).select("tid", "bytes", "w.*")

    for width in _WIDTHS:
        if crowded.isEmpty():
            break
        finer = cut(
            with_bytes(crowded).mapInArrow(_refine(length, width), _OCCURRENCE),
            "repeat-anchors",
        )
        more, some, crowded = _settle(finer, crowd)
        marks, left = marks.unionByName(more), left.unionByName(some)
    contexts = with_bytes(left).mapInArrow(
        _contexts(length), "h long, tid binary, low int, context binary"
    )
    indexed = contexts.repartition("h").sortWithinPartitions("h", "tid", "low").mapInArrow(
        _index_shards(length), _MARK
    )
    return marks.unionByName(indexed)


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": []}
            pairs = zip(
                batch.column("bytes").to_pylist(), batch.column("marks").to_pylist(), strict=True
            )
            for data, marks in pairs:
                kept, at, removed, spans = [], 0, 0, 0
                end = -1
                for low, high in sorted((m["low"], m["high"] + length) for m in marks or ()):
                    if low > end:
                        kept.append(data[at:low])
                        spans += 1
                        removed += high - low
                        at = end = high
                    elif high > end:
                        removed += high - end
                        at = end = high
                kept.append(data[at:])
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                out["kept"].append(b"".join(kept))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "n_spans": pa.array(out["n_spans"], pa.int64()),
                "kept": pa.array(out["kept"], pa.binary()),
            })

    return run


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    length: int = LENGTH,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A null text is empty; texts shorter than `length` stay whole; repeated rows are each
    other's repeats. `length` is at least 32. No documents: no rows.
    """
    data = F.encode(text_of(text), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("bytes")).select(
        "doc_id", "bytes", text_id(F.col("bytes")).alias("tid")
    )
    spans = find_repeats(rows, length, crowd).groupBy("tid").agg(
        F.collect_set(F.struct("low", "high")).alias("marks")
    )
    return rows.join(spans, "tid", "left").select(
        "doc_id", F.length("bytes").cast("long").alias("n_bytes"), "bytes", "marks"
    ).mapInArrow(
        _removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
