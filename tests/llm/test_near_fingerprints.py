"""The near-copy stage links by fingerprints, too."""

import random

import corpus_pipeline
from sensorgrid.llm import simhash
from tests.llm.test_near_similarity import COLUMNS, brute_survivors
from tests.llm.test_quality_simhash_secrets import brute_fingerprint


def near_by_bits_only(want=3, seed=5):
    """Pairs of texts within two bits whose five-word similarity is below 0.8."""
    draw, found = random.Random(seed), []
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3000)]
    while len(found) < want:
        base = draw.choices(words, k=120)
        other = list(base)
        for at in (10, 30, 50, 70, 90):
            other[at] = draw.choice(words)
        pair = [" ".join(base), " ".join(other)]
        bits = (brute_fingerprint(pair[0]) ^ brute_fingerprint(pair[1])).bit_count()
        if bits <= simhash.RADIUS:
            found.append(pair)
    return found


def test_near_stage_links_fingerprints(spark):
    pairs = near_by_bits_only()
    rows = [(10 * i + j, text, "s") for i, pair in enumerate(pairs) for j, text in enumerate(pair)]
    assert len(brute_survivors(rows)) == len(rows)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(2)
    left = corpus_pipeline.near_copies(spark, docs, "")
    assert {r.doc_id for r in left.collect()} == {10 * i for i in range(len(pairs))}
    # similarity goes on linking beyond two bits, by way of fingerprints too
    assert simhash.drop_near_copies(docs).count() == len(rows)
