"""Mean and median of time frames that slide over sorted readings.

Both ends of a frame only move forward, so each reading is added once and dropped once. The
median comes from a tree of counts over the ranks of the distinct values, in logarithmic time
per change; the sum from two stacks, which only ever add, so that a huge reading leaves no
rounding behind. Time follows the readings, not readings times frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class RankCounts:
    """Counts by rank, with the rank of the k-th reading: a binary indexed tree."""

    def __init__(self, ranks: int):
        self.size, self.total = ranks, 0
        self.top = 1 << max(ranks.bit_length() - 1, 0)
        self.tree = [0] * (ranks + 1)

    def add(self, rank: int, count: int) -> None:
        """Add `count` readings of a rank; a negative count drops them."""
        self.total += count
        tree, size, at = self.tree, self.size, rank + 1
        while at <= size:
            tree[at] += count
            at += at & -at

    def kth(self, k: int) -> int:
        """Rank of reading number `k`, from 0."""
        tree, size, at, step = self.tree, self.size, 0, self.top
        while step:
            ahead = at + step
            if ahead <= size and tree[ahead] <= k:
                k -= tree[ahead]
                at = ahead
            step >>= 1
        return at


class SlidingSum:
    """Sum of a queue: sums from each place to the turn, and one from the turn on."""

    def __init__(self, terms: list[float]):
        self.terms, self.low, self.turn, self.high = terms, 0, 0, 0
        self.front: list[float] = []  # sums from low.. to turn, the last one first
        self.back = 0.0

    def push(self) -> None:
        """Take in the next term."""
        self.back += self.terms[self.high]
        self.high += 1

    def drop(self) -> None:
        """Leave out the oldest term."""
        if self.low == self.turn:
            total, self.front = 0.0, []
            for at in range(self.high - 1, self.low - 1, -1):
                total += self.terms[at]
                self.front.append(total)
            self.turn, self.back = self.high, 0.0
        self.front.pop()
        self.low += 1

    def value(self) -> float:
        return (self.front[-1] if self.front else 0.0) + self.back


def frame_statistics(
    times: np.ndarray, values: np.ndarray, counts: np.ndarray, asked: np.ndarray,
    back: int, ahead: int,
) -> tuple[list[float | None], list[float | None]]:
    """Mean and median of the readings from `back` before to `ahead` behind each time asked.

    `times` are sorted; a value stands for `counts` readings. A frame without a reading has
    none of both. NaN counts as the largest value, as in Spark.
    """
    moments, place = np.unique(asked, return_inverse=True)
    lows = np.searchsorted(times, moments - back, "left").tolist()
    highs = np.searchsorted(times, moments + ahead, "right").tolist()
    ordered, ranks = np.unique(values, return_inverse=True)
    tree, total = RankCounts(len(ordered)), SlidingSum((values * counts).tolist())
    ordered, ranks, counts = ordered.tolist(), ranks.tolist(), counts.tolist()
    low = high = 0
    means: list[float | None] = []
    medians: list[float | None] = []
    for first, last in zip(lows, highs, strict=True):
        while high < last:
            tree.add(ranks[high], counts[high])
            total.push()
            high += 1
        while low < first:
            tree.add(ranks[low], -counts[low])
            total.drop()
            low += 1
        n = tree.total
        if not n:
            means.append(None)
            medians.append(None)
            continue
        means.append(total.value() / n)
        one, other = ordered[tree.kth((n - 1) // 2)], ordered[tree.kth(n // 2)]
        medians.append(one if one == other else 0.5 * one + 0.5 * other)
    return [means[i] for i in place.tolist()], [medians[i] for i in place.tolist()]


def _own_rows(rows: pa.Table, back: int, ahead: int) -> list[pa.RecordBatch]:
    """The own rows of whole pieces, each sorted by time, with their mean and median.

    The pieces are laid out on one time line, too far apart for a frame to reach over.
    """
    piece = rows["_piece"].to_numpy()
    starts = np.flatnonzero(np.diff(piece, prepend=piece[0] ^ 1))
    number = np.repeat(np.arange(len(starts)), np.diff([*starts, len(piece)]))
    # rows without a time have a piece of their own, in which they are each other's frame
    times = rows["unix_time"].fill_null(0).to_numpy()
    times = times - times[starts][number]
    times = times + number * (times.max() + back + ahead + 1)
    own = np.flatnonzero(rows["_is_own"].to_numpy())
    known = rows["_value"].is_valid().to_numpy()
    mean, median = frame_statistics(
        times[known], rows["_value"].to_numpy()[known].astype(float),
        rows["_c"].to_numpy()[known], times[own], back, ahead,
    )
    kept = rows.take(pa.array(own)).drop_columns(["_is_own", "_value", "_piece"])
    kept = kept.append_column("mean", pa.array(mean, pa.float64()))
    kept = kept.append_column("median", pa.array(median, pa.float64()))
    return kept.combine_chunks().to_batches()


def chunk_statistics(back: int, ahead: int):
    """For `mapInArrow`: rows of pieces one after another, told apart by `_piece`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last piece, which may go on
        for batch in batches:
            piece = batch.column("_piece").to_numpy()
            if not len(piece):
                continue
            last = len(piece) - int(np.argmax(piece[::-1] != piece[-1]))
            if (piece == piece[-1]).all():
                last = 0
            if last or (held and held[-1].column("_piece")[-1].as_py() != piece[-1]):
                held.append(batch.slice(0, last))
                yield from _own_rows(pa.Table.from_batches(held), back, ahead)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from _own_rows(pa.Table.from_batches(held), back, ahead)

    return run
