"""Near copies by the similarity of five-word shingles."""

import random

from sensorgrid.llm import minhash, simhash
from tests.llm.test_quality_simhash_secrets import brute_fingerprint

COLUMNS = "doc_id long, text string, source string"


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute_survivors(rows):
    """Smallest id of each group that five-word Jaccard similarities of 0.8 connect."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [sets_of(r[1]) for r in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return set(least.values())


def edited_texts(seed=21):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows = []
    for _ in range(25):
        base = draw.choices(words, k=draw.randint(100, 260))
        for edits in (0, 1, 2, 3, 4, 6, 9):
            text = list(base)
            for _ in range(edits):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((draw.randrange(10**9), " ".join(text), f"s{len(rows) % 3}"))
    rows += [(-1, None, "s0"), (-2, "", "s0"), (-3, "Ab c", "s1"), (-4, "ab  C", "s1")]
    return rows


def test_near_copies_are_those_of_similarity(spark):
    rows = edited_texts()
    left = simhash.drop_near_copies(spark.createDataFrame(rows, COLUMNS).repartition(3))
    want = brute_survivors(rows)
    assert {r.doc_id for r in left.collect()} == want
    # most lie beyond the two bits of the fingerprint query
    fps = [brute_fingerprint(t) for _, t, _ in rows[:7]]
    assert max((fps[0] ^ fp).bit_count() for fp in fps) > 2 and len(want) < 0.6 * len(rows)


def test_crowded_band_in_two_rounds(spark):
    """A chain of texts, each similar to the next only, is one group."""
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(400)]
    rows = [(i, " ".join(words[6 * i:6 * i + 120]), "s") for i in range(40)]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, COLUMNS))
    assert {r.doc_id for r in left.collect()} == brute_survivors(rows)


def test_shingles_and_similarity():
    assert minhash.shingles(b" ") == {b""} and minhash.shingles(b"A  b") == {b"a b"}
    a = {bytes([i]) for i in range(9)}
    assert minhash.similar(a, a | {b"x"}) and not minhash.similar(a, {*list(a)[:7], b"x"})


def test_product_of_shingle_matrices_equals_sets(monkeypatch):
    monkeypatch.setattr(minhash, "_COLUMNS", 50)
    texts = [(t or "").encode() for _, t, _ in edited_texts()[:60]] + [b"", b"x y"]
    hashed = [minhash.hashed_shingles(t) for t in texts]
    found = minhash.similar_rows(hashed[:40], hashed)
    for i in range(40):
        for j, text in enumerate(texts):
            assert found[i, j] == minhash.similar(
                minhash.shingles(texts[i]), minhash.shingles(text)
            )


def test_a_large_group_is_compared_in_tiles(spark):
    """Texts around one base, many beyond reach of the pivots, over several tiles."""
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(2000)]
    base = draw.choices(words, k=80)
    rows = []
    for i in range(1500):
        text = list(base)
        for _ in range(draw.choice([1, 2, 2, 3])):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((i, " ".join(text), "s"))
    left = simhash.drop_near_copies(spark.createDataFrame(rows, COLUMNS).repartition(3))
    found, want = {r.doc_id for r in left.collect()}, brute_survivors(rows)
    assert want <= found and len(found - want) <= 2 and len(want) > 5
