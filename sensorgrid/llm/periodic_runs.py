"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a maximal stretch of words with smallest period q whose length is at least
max(min_length, min_exponent * q). Inside a text, a sieve first keeps the stretches in which
every three words in a row occur three times or more, as they do inside every run of four
periods; each stretch is sieved again by itself until nothing goes. What is left is indexed:

* The suffix automaton of the stretch gives the tree of suffix links; the path from the state
  of a prefix to the root holds the suffixes of that prefix by falling length.
* A link-cut forest over that tree keeps, per preferred path, the word at which its suffixes
  ended last. Each appended word is one access: the path to the root is walked in segments of
  one last end, then recoloured as a whole. With i the new end, j the previous one and L the
  longest suffix of the segment, words i-L+1..i equal words j-L+1..j, so the stretch from
  j-L+1 to i has period i-j, a square where L >= i-j. Where the next word breaks the period,
  the stretch is a whole run, and it shows at no other place.

Everything happens where the text stands; nothing is shuffled. Memory of a task: the words of
one batch, and the automaton of one stretch, linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from sensorgrid.llm.common import text_of

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words in a row that the sieve counts, and how often a run of four periods repeats them.
_GRAM, _TIMES = 3, 3


class SuffixAutomaton:
    """States of all substrings: longest length, suffix link, and the state of each prefix."""

    def __init__(self, words: Sequence[int]):
        self.length, self.link, self.prefix = [0], [-1], []
        steps: list[dict[int, int]] = [{}]
        last = 0
        for word in words:
            state = self._new(self.length[last] + 1)
            steps.append({})
            at = last
            while at >= 0 and word not in steps[at]:
                steps[at][word] = state
                at = self.link[at]
            if at < 0:
                self.link[state] = 0
            else:
                found = steps[at][word]
                if self.length[found] == self.length[at] + 1:
                    self.link[state] = found
                else:
                    copy = self._new(self.length[at] + 1)
                    steps.append(dict(steps[found]))
                    self.link[copy] = self.link[found]
                    while at >= 0 and steps[at].get(word) == found:
                        steps[at][word] = copy
                        at = self.link[at]
                    self.link[found] = self.link[state] = copy
            self.prefix.append(state)
            last = state

    def _new(self, length: int) -> int:
        self.length.append(length)
        self.link.append(-1)
        return len(self.length) - 1


class LinkCutForest:
    """Preferred paths of a rooted tree as splay trees ordered by depth.

    `above` is the parent inside a splay tree, or at its root the tree node over the path.
    `ends` is the last end of a node's path; it holds at the root of a splay tree, and `access`
    hands it down where a path is cut in two.
    """

    def __init__(self, parents: Sequence[int]):
        self.above = list(parents)
        self.low = [-1] * len(self.above)  # towards the root of the tree
        self.deep = [-1] * len(self.above)
        self.ends = [-1] * len(self.above)

    def _splay(self, node: int) -> None:
        """Make `node` the root of its splay tree."""
        above, low, deep = self.above, self.low, self.deep
        while True:
            parent = above[node]
            if parent < 0:
                return
            if low[parent] == node:
                left = True
            elif deep[parent] == node:
                left = False
            else:  # the node over the path
                return
            upper = above[parent]
            inner = upper >= 0 and (low[upper] == parent or deep[upper] == parent)
            if inner and (low[upper] == parent) == left:
                self._turn(parent, upper)
                self._turn(node, parent)
            else:
                self._turn(node, parent)

    def _turn(self, node: int, parent: int) -> None:
        """Rotate `node` over its splay parent; the path's end goes with the root."""
        above, low, deep = self.above, self.low, self.deep
        upper = above[parent]
        if low[parent] == node:
            child = low[parent] = deep[node]
            deep[node] = parent
        else:
            child = deep[parent] = low[node]
            low[node] = parent
        if child >= 0:
            above[child] = parent
        above[parent], above[node] = node, upper
        if upper >= 0 and low[upper] == parent:
            low[upper] = node
        elif upper >= 0 and deep[upper] == parent:
            deep[upper] = node
        else:
            self.ends[node] = self.ends[parent]

    def access(self, node: int, end: int) -> list[tuple[int, int]]:
        """(deepest node, last end) of each segment from `node` to the root; then all end here.

        Segments that never ended before are not listed.
        """
        above, deep, ends = self.above, self.deep, self.ends
        segments, below, at = [], -1, node
        while at >= 0:
            self._splay(at)
            if ends[at] >= 0:
                segments.append((at, ends[at]))
            if deep[at] >= 0:  # the part below stays a path of its own
                ends[deep[at]] = ends[at]
            deep[at] = below
            below, at = at, above[at]
        ends[below] = end
        self._splay(node)
        ends[node] = end
        return segments


def runs_of(
    words: Sequence[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of word numbers, `min_exponent` >= 2."""
    automaton = SuffixAutomaton(words)
    forest, length = LinkCutForest(automaton.link), automaton.length
    found = []
    for end, state in enumerate(automaton.prefix):
        for deepest, before in forest.access(state, end):
            period = end - before
            whole = length[deepest] + period
            if whole >= min_length and whole >= min_exponent * period and (
                end + 1 == len(words) or words[end + 1] != words[end + 1 - period]
            ):
                found.append((end + 1 - whole, whole, period))
    return found


def sieve(numbers: np.ndarray, parts: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Stretches [low, high) in which each three words in a row occur three times or more.

    `parts` numbers the texts one after another; a stretch lies in one text. Stretches are
    counted by themselves until none shrinks; those below `shortest` words go.
    """
    places = np.arange(len(numbers))
    while True:
        if len(places) < shortest:
            return []
        starts = places[:-_GRAM + 1]
        whole = (places[_GRAM - 1:] - starts == _GRAM - 1) & (
            parts[_GRAM - 1:] == parts[:-_GRAM + 1]
        )
        starts, own = starts[whole], parts[:-_GRAM + 1][whole]
        gram = numbers[starts]
        for step in range(1, _GRAM):
            gram = np.unique(gram, return_inverse=True)[1] * (numbers.max() + 1)
            gram = gram + numbers[starts + step]
        gram = np.unique(gram, return_inverse=True)[1]
        key = own * (gram.max(initial=0) + 1) + gram
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        kept = times[which] >= _TIMES
        starts, own = starts[kept], own[kept]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (np.diff(own) != 0)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(starts))) + _GRAM - 1
        first, sizes = first[sizes >= shortest], sizes[sizes >= shortest]
        lows = starts[first]
        if sizes.sum() == len(places):
            return list(zip(lows.tolist(), (lows + sizes).tolist()))
        ends = np.cumsum(sizes)
        places = np.repeat(lows - ends + sizes, sizes) + np.arange(sizes.sum())
        parts = np.repeat(np.arange(len(sizes)), sizes)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_FOUND = """n_words long, runs array<struct<start:long, length:long, period:long>>,
    kept_words binary"""


def _find(min_length: int, min_exponent: int):
    kinds = to_arrow_type(_parse_datatype_string(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = _Numbers()
            words = [text.split() for text in batch.column("whole").to_pylist()]
            sizes = np.array([len(own) for own in words], dtype=np.int64)
            ends = np.cumsum(sizes)
            numbers = np.fromiter(
                (index[word] for own in words for word in own), np.int64, int(sizes.sum())
            )
            parts = np.repeat(np.arange(len(words)), sizes)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
            dropped: dict[int, np.ndarray] = {}
            for low, high in sieve(numbers, parts, min_length):
                row = int(parts[low])
                offset = low - int(ends[row] - sizes[row])
                for start, length, period in runs_of(
                    numbers[low:high].tolist(), min_length, min_exponent
                ):
                    runs[row].append((start + offset, length, period))
                    if row not in dropped:
                        dropped[row] = np.zeros(sizes[row], bool)
                    dropped[row][start + offset + period:start + offset + length] = True
            left = [
                b" ".join(
                    own if row not in dropped
                    else [own[i] for i in np.flatnonzero(~dropped[row]).tolist()]
                )
                for row, own in enumerate(words)
            ]
            listed = [
                [{"start": s, "length": n, "period": q} for s, n, q in sorted(
                    own, key=lambda r: (r[0], r[2])
                )]
                for own in runs
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kept"), pa.array(sizes),
                    pa.array(listed, kinds.field("runs").type), pa.array(left, pa.binary()),
                ],
                names=["kept", "n_words", "runs", "kept_words"],
            )

    return run


def find_runs(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """The columns `keep`, n_words, `runs` (start, length, period) and `kept_words`.

    Runs come by start, then period. `kept_words` is the text without the words that lie in a
    run after its first period, joined by single spaces. Words are what lies between the ASCII
    white space; a null or empty text has none, no runs, and the empty text left. Overlapping
    runs of different periods are all listed; a run belongs to one text, and repeated rows are
    searched each for themselves. Columns not in `keep` play no part; `keep` must not hold the
    three names that are added. `min_exponent` below 4 or `min_length` below 6 is refused, as
    the sieve would lose runs. No documents: no rows.
    """
    if min_exponent < MIN_EXPONENT or min_length < MIN_LENGTH:
        raise ValueError("runs need four periods and six words at least")
    kept = StructType([docs.schema[name] for name in keep])
    found = _parse_datatype_string(_FOUND)
    rows = docs.select(
        F.struct(*keep).alias("kept"), text_of(text).cast("binary").alias("whole")
    ).mapInArrow(
        _find(min_length, min_exponent), StructType([StructField("kept", kept), *found])
    )
    return rows.select(
        "kept.*", "n_words", "runs", F.col("kept_words").cast("string").alias("kept_words")
    )


def best_run() -> Column:
    """Of the array `runs` the one of greatest length / period; ties: start, then period."""
    def better(best, run):
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | ahead, run).otherwise(best)

    empty = F.lit(None).cast("struct<start:long, length:long, period:long>")
    return F.aggregate("runs", empty, better)
