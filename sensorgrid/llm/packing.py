"""Packing of tokenised documents into windows: best-fit decreasing on a segment tree.

Documents are tokenised and cut into full windows where they stand; only narrow rows, one
per piece, move on. Pieces are dealt by a hash of their place, sorted by falling length in
each partition and packed as they stream by: a segment tree over the remaining capacities
finds the tightest window that is open and has room. Memory of a task: its open windows.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import give_back, text_of

WINDOW = 4096
END_ID = 2
#: Characters of words whose ids a worker keeps; beyond it starts again.
_CACHED_CHARS = 8_000_000
#: Characters that are split into words at a time.
_BLOCK_CHARS = 2_000_000

#: A character that is one token by itself, and how many words are tokenised together.
_MARK = "\x01"
_BETWEEN, _TOGETHER = f" {_MARK} ", 500
#: Marks that often end a word; each is one token.
_ENDS = (",", ".")


def blocks(text: str, limit: int = _BLOCK_CHARS) -> Iterator[str]:
    """`text` in parts of about `limit` characters, cut at blanks or line feeds."""
    start = 0
    while len(text) - start > limit:
        end = max(text.rfind(" ", start, start + limit), text.rfind("\n", start, start + limit))
        if end <= start:  # one word longer than a block
            later = [p for p in (text.find(" ", start + limit), text.find("\n", start + limit))
                     if p >= 0]
            if not later:
                break
            end = min(later)
        yield text[start:end]
        start = end + 1
    yield text[start:]


def lowered(text: str) -> str:
    """`text` lowered where that is sure to leave its ids alone, else as it is.

    The tokenizer looks for its added tokens, composes, then lowers. Lowering first would
    make added tokens of their capitals, and letters that compose only when small; a final
    sigma is lowered by its place in the word.
    """
    lower = text.lower()
    if lower == text or not ("<|" in text or "\u03a3" in text) and all(
        map(partial(unicodedata.is_normalized, "NFC"), (text, lower))
    ):
        return lower
    return text


class _Index(dict):
    """Number of each word; an unknown word gets the next number and is listed in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTokens:
    """Token ids of texts, tokenising each distinct word once.

    The tokenizer lowers letters and splits at white space, and between a letter and a mark,
    before it merges. So the ids of a text are those of its lowered words between blanks and
    line feeds, and a word that ends in a comma or full stop is tokenised without it.
    """

    def __init__(self, path: str):
        # a task is one core; threads of its own would each keep memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.index, self.chars = _Index(), 0
        self.flat = np.empty(0, dtype=np.uint32)  # ids of all words
        self.first = np.empty(0, dtype=np.int64)  # place of a word's ids, and their number
        self.count = np.empty(0, dtype=np.int64)

    def _learn(self) -> None:
        """Find the ids of the words that are new in the index."""
        new, index, known = self.index.new, self.index, len(self.first)
        ended = [
            (index[w], index[w[:-1]], index[w[-1]])
            for w in new  # grows by the stems and marks
            if w[-1:] in _ENDS and w[-2:-1].lower().isalpha()
        ]
        index.new = []
        self.chars += sum(map(len, new))
        whole = np.ones(len(new), bool)
        word, stem, mark = np.array(ended, dtype=np.int64).reshape(-1, 3).T
        whole[word - known] = False
        lengths, flat = self._tokenise([w for w, is_whole in zip(new, whole.tolist()) if is_whole])
        first, count = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        count[whole] = lengths
        first[whole] = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.concatenate([self.first, first])
        self.count = np.concatenate([self.count, count])
        if len(word):  # the ids of the stem, and the one of the mark
            lengths = self.count[stem]
            ends = np.cumsum(lengths)
            flat = np.insert(self._ids(stem), ends, self.flat[self.first[mark]])
            self.count[word] = lengths + 1
            self.first[word] = len(self.flat) + ends - lengths + np.arange(len(word))
            self.flat = np.concatenate([self.flat, flat])

    def _tokenise(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids; many words at a time, with a mark between."""
        alone = [w for w in words if _MARK in w]
        if alone:
            found = [
                self.tokenizer.encode(w, add_special_tokens=False).ids for w in words
            ]
            return (
                np.array(list(map(len, found)), dtype=np.int64),
                np.array([i for ids in found for i in ids], dtype=np.uint32),
            )
        lengths, flat = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        lines = [
            _BETWEEN.join(words[at:at + _TOGETHER]) for at in range(0, len(words), _TOGETHER)
        ]
        for line in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(line.ids, dtype=np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            lengths.append(np.diff(np.append(marks, len(ids)), prepend=-1) - 1)
            flat.append(np.delete(ids, marks))
        return np.concatenate(lengths), np.concatenate(flat)

    def _ids(self, words: np.ndarray) -> np.ndarray:
        """The ids of words, given by number, one after another."""
        count = self.count[words]
        ends = np.cumsum(count)
        shift = np.repeat(self.first[words] - ends + count, count)
        shift += np.arange(len(shift))
        return self.flat[shift]

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        if self.chars > _CACHED_CHARS:
            self._clear()
        number, found = self.index.__getitem__, []
        for text in texts:
            words = lowered(text).replace("\n", " ").split(" ")
            found.append(np.fromiter(map(number, words), dtype=np.int64, count=len(words)))
        self._learn()
        return [self._ids(words) for words in found]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        waiting, held = [], 0
        for text in texts:
            if held + len(text) > _BLOCK_CHARS:
                yield from self._some(waiting)
                waiting, held = [], 0
            if len(text) > _BLOCK_CHARS:
                yield np.concatenate([self._some([part])[0] for part in blocks(text)])
            else:
                waiting.append(text)
                held += len(text)
        yield from self._some(waiting)


_workers: dict[str, WordTokens] = {}


def _pieces(path: str, window: int, end_id: int):
    """Rows of the pieces of each document: full windows, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:  # a reused worker keeps its words
            give_back()
            _workers[path] = WordTokens(path)
        tokens, task, row_no = _workers[path], TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("whole").to_pylist()
            out: dict[str, list] = {
                n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_no")
            }
            for doc_id, found in zip(ids, tokens.encode(texts), strict=True):
                own = np.append(found, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(own), window):
                    piece = own[start:start + window]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(len(piece))
                    out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    out["doc_tokens"].append(len(own))
                    out["row_no"].append(task << 40 | row_no)
                row_no += 1
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)  # open windows below each node
        self.by_room: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += change
            node >>= 1

    def put(self, room: int, number: int, pieces: int) -> None:
        """Keep a window of `room` left; a full one is closed."""
        if room:
            self.by_room[room].append((number, pieces))
            self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Take the window with the least room of at least `length`: room, number, pieces."""
        node = length + self.leaves
        while not self.tree[node]:
            while node & 1:  # a right child: go up
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        number, pieces = self.by_room[room].pop()
        self._add(room, -1)
        return room, number, pieces


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first, used = OpenWindows(window), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            numbers, places = [], []
            for length in batch.column("length").to_pylist():
                if (hit := windows.tightest(length)) is None:
                    hit = (window, first + used, 0)
                    used += 1
                room, number, pieces = hit
                numbers.append(number)
                places.append(window - room)
                windows.put(room - length, number, pieces + 1)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "row_no"}
            columns["sequence_id"] = pa.array(numbers, pa.int64())
            columns["offset"] = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a tokenizer file that every worker can read. A null or empty
    text is its end id alone. `offset` is the first place of the piece in its sequence, and
    the pieces of a sequence leave no gap before its end. Repeated rows are packed each for
    themselves. No documents: no rows.
    """
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("whole")
    ).mapInArrow(_pieces(tokenizer, window, end_id), f"{kinds}, row_no long")
    dealt = pieces.repartition(F.xxhash64("row_no", "start")).sortWithinPartitions(
        F.desc("length"), "doc_id", "start", "row_no"
    )
    return dealt.mapInArrow(_pack(window), f"{kinds}, sequence_id long, offset long")
