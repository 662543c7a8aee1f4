"""Secret scans: fixed patterns, and a character network over every other candidate.

Base patterns always stand. Every further token of 16 characters or more is scored by a small
convolutional network in numpy: one-hot characters, one convolution, the maximum and mean over
the window, one logistic unit. Overlapping windows cover the whole token, each with what stands
before and behind it; the highest score counts, so that a key at the end of a path is seen.
The network is trained once per run on labelled findings, `TRAINING_ROWS` of them, made from
the public formats of keys and of things that look like keys, alone and inside paths. Scores
are calibrated on findings that the training did not see; of the thresholds that find `RECALL`
of the held-out secrets, the one of best precision is taken, of equal ones the lowest. Weights
are a few thousand numbers and travel with the task. Equal scores make no difference, as each
token is judged by itself.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import text_of

# The base patterns and their shortest matches
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_LEAST, _ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "network")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TRAINING_ROWS = 6000
RECALL = 0.99
#: Characters of a window before, inside and behind its part of a token; parts overlap by half.
_BEFORE, _INSIDE, _BEHIND = 20, 44, 20
_STEP = _INSIDE // 2
_WIDTH = _BEFORE + _INSIDE + _BEHIND
#: Characters of a secret in a window that make it one in training.
_SEEN = 16
_KERNEL, _FILTERS = 5, 24
_SEED = 20

_ALPHABET = string.ascii_lowercase + string.digits + "+/_=-.:\"' @"
#: channel of each ASCII character; letters fold, an extra channel marks capitals
_CHANNEL = np.full(128, len(_ALPHABET), dtype=np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CHANNEL[ord(_c)] = _i
    _CHANNEL[ord(_c.upper())] = _i
_CHANNELS = len(_ALPHABET) + 3  # other, capital, inside


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "api_key", "apikey")):
        found += [
            (m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text)
            if len(m[2]) >= _ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [
            (m.start(), "access", m.end()) for m in _ACCESS.finditer(text)
            if len(m[0]) >= _ACCESS_LEAST
        ]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def candidates(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Tokens that no base span touches and that are not one number."""
    found = []
    for m in _CANDIDATE.finditer(text):
        if not m[0].isdigit() and not any(s < m.end() and m.start() < e for s, _, e in taken):
            found.append((m.start(), m.end()))
    return found


def parts_of(start: int, end: int) -> list[tuple[int, int]]:
    """Parts of at most 44 characters that cover a candidate, overlapping by half."""
    last = max(start, end - _INSIDE)
    starts = [*range(start, last, _STEP), last]
    return [(at, min(end, at + _INSIDE)) for at in starts]


def window_of(text: str, start: int, end: int, part: tuple[int, int]) -> tuple[str, int, int]:
    """The characters around and in a part of a candidate, padded, and what of them is in it."""
    low, high = part
    before = text[max(0, low - _BEFORE):low].rjust(_BEFORE, "\x00")
    behind = text[high:high + _WIDTH - _BEFORE - (high - low)]
    window = (before + text[low:high] + behind).ljust(_WIDTH, "\x00")
    return window, max(0, _BEFORE - (low - start)), min(_WIDTH, _BEFORE + end - low)


Window = tuple[str, int, int]


def encode(windows: list[Window]) -> np.ndarray:
    """One-hot windows: (rows, width, channels)."""
    codes = np.array([[ord(c) for c in w] for w, *_ in windows], dtype=np.int64)
    codes = codes.reshape(-1, _WIDTH)
    ascii_codes = np.where(codes < 128, codes, 127)
    out = np.zeros((*codes.shape, _CHANNELS), dtype=np.float32)
    rows, columns = np.indices(codes.shape)
    out[rows, columns, _CHANNEL[ascii_codes]] = 1
    out[..., -2] = (codes >= 65) & (codes <= 90)
    low, high = (np.array([w[k] for w in windows]).reshape(-1, 1) for k in (1, 2))
    out[..., -1] = (columns >= low) & (columns < high)
    out[codes == 0] = 0
    return out


@dataclass
class Network:
    """Weights of the network, its calibration and its threshold."""

    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def _forward(self, x: np.ndarray):
        n = _WIDTH - _KERNEL + 1
        patches = np.lib.stride_tricks.sliding_window_view(x, _KERNEL, axis=1)
        patches = patches.transpose(0, 1, 3, 2).reshape(len(x), n, -1)
        hidden = np.maximum(patches @ self.kernel + self.bias, 0)
        pooled = np.concatenate([hidden.max(axis=1), hidden.mean(axis=1)], axis=1)
        return patches, hidden, pooled, pooled @ self.out + self.shift

    def raw(self, windows: list[Window]) -> np.ndarray:
        """Uncalibrated scores."""
        parts = [self._forward(encode(windows[i:i + 256]))[3] for i in range(0, len(windows), 256)]
        return np.concatenate(parts) if parts else np.empty(0)

    def highest(self, findings: list[tuple[str, int, int]]) -> np.ndarray:
        """Highest uncalibrated score of the windows of each candidate (text, start, end)."""
        parts = [parts_of(start, end) for _, start, end in findings]
        windows = (
            window_of(text, start, end, part)
            for (text, start, end), own in zip(findings, parts, strict=True) for part in own
        )
        scores = []
        while some := list(itertools.islice(windows, 4096)):
            scores.append(self.raw(some))
        if not scores:
            return np.empty(0)
        first = np.cumsum([0, *map(len, parts[:-1])])
        return np.maximum.reduceat(np.concatenate(scores), first)

    def probability(self, findings: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities that candidates are, or hold, secrets."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.highest(findings) + self.offset, -40, 40)))


@dataclass
class Finding:
    """A candidate text[start:end], and where the secret in it lies, if any."""

    text: str
    start: int
    end: int
    label: int
    secret: tuple[int, int] = (0, 0)

    @property
    def place(self) -> tuple[str, int, int]:
        return self.text, self.start, self.end

    def windows(self) -> Iterator[tuple[Window, int]]:
        """Windows, each with whether it shows the secret."""
        for part in parts_of(self.start, self.end):
            shown = min(part[1], self.secret[1]) - max(part[0], self.secret[0])
            yield window_of(*self.place, part), int(self.label and shown >= _SEEN)


def labelled_findings(n: int = TRAINING_ROWS, seed: int = _SEED) -> list[Finding]:
    """Findings made from public formats, half of them secrets."""
    draw = random.Random(seed)
    filler = (
        "the value of this page was set and then read by for with new old line deploy use "
        "please find in our vault server key and user data from code to be sent"
    ).split()
    letters, base64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(draw.choices(alphabet, k=draw.randint(low, high)))

    def made_words(k: int, join: str) -> str:
        return join.join(some("aeioulnrst", 3, 8) for _ in range(k))

    secret = [
        lambda: some(letters, 24, 48),
        lambda: some(string.ascii_letters, 28, 48),
        lambda: some(base64, 32, 64) + draw.choice(["", "=", "=="]),
        lambda: draw.choice(["ghp_", "gho_", "ghs_"]) + some(letters, 36, 36),
        lambda: draw.choice(["sk_live_", "rk_live_", "sk_test_"]) + some(letters, 24, 32),
        lambda: "xoxb-" + some(string.digits, 10, 12) + "-" + some(letters, 24, 24),
        lambda: "eyJ" + some(letters + "_-", 30, 60),
        lambda: "AIza" + some(letters + "_-", 35, 35),
        lambda: some("0123456789ABCDEF", 32, 64),
        lambda: "glpat-" + some(letters + "_-", 20, 20),
        lambda: draw.choice(["ghp_", "key-", "tok_", ""]) + some("0123456789abcdefABCDEF", 32, 40),
        lambda: draw.choice(["ghp_", "npm_", "key_", ""]) + some(letters + string.digits * 4, 30, 40),
    ]
    plain = [
        lambda: made_words(3, "-") + "-" + some(string.digits, 1, 4),
        lambda: made_words(3, "_") + some(string.digits, 1, 3),
        lambda: made_words(2, "/") + "/" + some(string.digits, 4, 8) + "/" + made_words(1, ""),
        lambda: "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: made_words(3, "") + some(string.digits, 1, 4),
        lambda: made_words(2, "").title() + made_words(2, "").title() + some(string.digits, 1, 2),
        lambda: some(string.digits, 4, 4) + "-" + some(string.digits, 2, 2) + "-" + some(string.digits, 8, 12),
        lambda: "-" * draw.randint(10, 20) + some(string.digits, 1, 3) + "-" * draw.randint(4, 9),
        lambda: "+".join(made_words(1, "") for _ in range(3)) + "=" + some(string.digits, 2, 3),
        lambda: draw.choice(["isbn", "order", "page", "img"]) + "_" + some(string.digits, 12, 20),
        lambda: made_words(draw.randint(3, 6), "").lower()[:40],
        lambda: "".join(w.title() for w in made_words(draw.randint(3, 7), " ").split()),
        lambda: made_words(draw.randint(3, 9), draw.choice("-_/")),
        lambda: made_words(draw.randint(3, 6), "/") + "/" + some(string.digits, 1, 6),
        lambda: made_words(draw.randint(2, 4), "_").upper(),
        lambda: draw.choice("=-_") * draw.randint(16, 60),
        lambda: "/".join(made_words(1, "") for _ in range(3)) + "/" + "-".join(
            made_words(1, "") for _ in range(4)),
    ]
    rows = []
    for i in range(n):
        label = i % 2
        token = draw.choice(secret if label else plain)()
        before = " ".join(draw.choices(filler, k=draw.randint(0, 6)))
        if draw.random() < 0.3:
            before += draw.choice([" key:", " auth", " bearer", ' "', " id=", " see"])
        before += draw.choice([" ", "\n", "'", '"']) if before else ""
        lead = ""
        if label and draw.random() < 0.25:  # at the end, or in the middle, of a path or query
            lead = draw.choice("/-_=").join(made_words(1, "") for _ in range(draw.randint(2, 9)))
            lead += draw.choice("/=_")
        tail = "/" + made_words(2, "/") if lead and draw.random() < 0.3 else ""
        first = len(before) + len(lead)
        rows.append(Finding(
            before + lead + token + tail + " " + draw.choice(filler), len(before),
            first + len(token) + len(tail), label, (first, first + len(token)),
        ))
    return rows


@cache
def trained(n: int = TRAINING_ROWS, seed: int = _SEED, recall: float = RECALL) -> Network:
    """The network, trained on two thirds of the findings and calibrated on the others."""
    rows = [
        (f, int(hashlib.blake2b(f.text.encode()).hexdigest(), 16) % 3)
        for f in labelled_findings(n, seed)
    ]
    fit = [window for f, part in rows if part for window in f.windows()]
    held = [f for f, part in rows if not part]
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (_KERNEL * _CHANNELS, _FILTERS)).astype(np.float32),
        np.zeros(_FILTERS, np.float32),
        rng.normal(0, 0.3, 2 * _FILTERS).astype(np.float32), 0.0,
    )
    x, y = encode([w for w, _ in fit]), np.array([label for _, label in fit], np.float32)
    names, step = ("kernel", "bias", "out", "shift"), 0
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    for _ in range(12):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows_ = order[at:at + 64]
            patches, hidden, pooled, score = net._forward(x[rows_])
            error = ((1 / (1 + np.exp(-score)) - y[rows_]) / len(rows_)).astype(np.float32)
            d_pool = error[:, None] * net.out
            d_hidden = np.repeat(d_pool[:, None, _FILTERS:] / hidden.shape[1], hidden.shape[1], 1)
            top = hidden.argmax(axis=1)
            i, j = np.indices(top.shape)
            d_hidden[i, top, j] += d_pool[:, :_FILTERS]
            d_hidden *= hidden > 0
            grads = {
                "kernel": patches.reshape(-1, patches.shape[2]).T @ d_hidden.reshape(-1, _FILTERS),
                "bias": d_hidden.sum(axis=(0, 1)),
                "out": pooled.T @ error, "shift": error.sum(),
            }
            step += 1
            for name in names:  # Adam
                g = grads[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = (first[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, name, np.float32(getattr(net, name) - 0.005 * move))
    raw = net.highest([f.place for f in held])
    truth = np.array([f.label for f in held], float)
    for _ in range(200):  # logistic calibration of the held-out scores
        p = 1 / (1 + np.exp(-np.clip(net.scale * raw + net.offset, -40, 40)))
        net.scale -= 0.05 * float(((p - truth) * raw).mean())
        net.offset -= 0.05 * float((p - truth).mean())
    score = net.probability([f.place for f in held])
    order = np.argsort(-score)
    right = np.cumsum(truth[order])
    able = np.flatnonzero(right >= recall * truth.sum())
    precision = right[able] / (able + 1)
    last = able[np.flatnonzero(precision == precision.max())[-1]]
    net.threshold = float(score[order[last]])
    return net


def joined(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _scan(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("whole").to_pylist()
            base = [base_spans(text) for text in texts]
            tokens = [
                (i, start, end) for i, text in enumerate(texts)
                for start, end in candidates(text, base[i])
            ]
            scores = net.probability([(texts[i], s, e) for i, s, e in tokens])
            spans = [list(own) for own in base]
            for (i, start, end), score in zip(tokens, scores, strict=True):
                if score >= net.threshold:
                    spans[i].append((start, "network", end))
            out = {"doc_id": batch.column("doc_id")}
            for kind in KINDS[:3]:
                out[f"n_{kind}"] = pa.array([sum(s[1] == kind for s in own) for own in base], pa.int64())
            out["base_sha256"] = pa.array(
                [hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string())
            out["spans"] = pa.array(
                [joined(sorted(own, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))
                 for own in spans], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, counts and digest of the base spans, all spans.

    Positions are code points, ends exclusive. A null or empty text has no spans; repeated
    rows and null ids are rows like any other. No documents: no rows.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("whole")
    ).mapInArrow(
        _scan(trained()),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
