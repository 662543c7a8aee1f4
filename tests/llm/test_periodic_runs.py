"""Periodic runs against a plain search, the sieve, and the whole query by brute force."""

import hashlib
import random
import zlib

import pytest

from sensorgrid.llm import periodic_runs, queries


def plain_runs(words, min_length=6, min_exponent=4):
    """All maximal stretches per period; a multiple of a smaller period is left out."""
    found, n = [], len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(min_length, min_exponent * q) and not any(
                s <= start and start + length <= s + n_ and q % p == 0 for s, n_, p in found
            ):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def made_texts(seed, n):
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        words = []
        for _ in range(draw.randint(1, 6)):
            part = [draw.choice("abcd"[:draw.randint(1, 4)]) for _ in range(draw.randint(1, 9))]
            words += part * draw.randint(1, 9) + part[:draw.randint(0, 3)]
        texts.append(words)
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_a_plain_search(seed):
    for words in made_texts(seed, 120):
        numbers = [ord(w) for w in words]
        found = periodic_runs.runs_of(numbers)
        assert sorted(found, key=lambda r: (r[0], r[2])) == plain_runs(words), words
        assert len(found) == len(set(found))


def test_squares_too():
    for words in made_texts(9, 100):
        found = periodic_runs.runs_of([ord(w) for w in words], 2, 2)
        assert sorted(found, key=lambda r: (r[0], r[2])) == plain_runs(words, 2, 2), words


def test_long_stretches_take_linear_steps():
    n = 60_000
    assert periodic_runs.runs_of([7] * n) == [(0, n, 1)]
    assert periodic_runs.runs_of(list(range(1000)) * 60) == [(0, n, 1000)]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_equals_brute_force(spark, tmp_path, docs):
    draw = random.Random(2)
    rows = [
        (5000 + i, draw.choice([" ", "\n\t", "\x0b  "]).join(words))
        for i, words in enumerate(made_texts(4, 300))
    ]
    few = docs.select("doc_id", "text").where("length(text) < 5000 or text is null")
    table = few.union(spark.createDataFrame(rows, "doc_id long, text string"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    expected = [plain_row(*row) for row in table.collect()]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert sum(row[1] for row in expected) > 200


def test_given_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows if len(r["text"] or "") < 9000}
    found = [r for r in queries.op12_periodic_runs(spark, sf).collect() if r["doc_id"] in short]
    expected = [plain_row(*row) for row in short.items()]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_no_documents_and_refused_settings(spark, docs, no_docs):
    assert periodic_runs.find_runs(no_docs, ("doc_id", "row")).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, min_exponent=2)
