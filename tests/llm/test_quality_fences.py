"""Fences that the data set, and that move smoothly with the rows of a source."""

import random

import numpy as np

from sensorgrid.llm import quality
from tests.llm.conftest import SCHEMA

WORDS = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(400)]


def text(draw, mark="", caps=0.0, same=0):
    lines = [" ".join(
        (w.upper() if draw.random() < caps else w) + mark for w in draw.choices(WORDS, k=6)
    ) for _ in range(12)]
    return "\n".join(lines[:12 - same] + lines[:1] * same)


def kept_of(spark, texts):
    rows = [(i, t, "en", source, 0, 0, "") for i, (source, t) in enumerate(texts)]
    found = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    return np.array([r.kept for r in sorted(found, key=lambda r: r.doc_id)])


def test_junk_below_the_old_constants(spark):
    draw = random.Random(1)
    clean = [("prose", text(draw)) for _ in range(200)]
    junk = [("prose", text(draw, caps=0.2)) for _ in range(15)]
    junk += [("prose", text(draw, same=3)) for _ in range(15)]  # a quarter of the lines
    kept = kept_of(spark, clean + junk)
    assert kept[:200].all() and not kept[200:].any()


def test_an_even_tail_is_kept(spark):
    draw = random.Random(2)
    texts = [("prose", text(draw, caps=0.3 * i / 300)) for i in range(300)]
    assert kept_of(spark, texts).mean() > 0.99


def test_no_step_in_the_rows_of_a_source(spark):
    high = []
    for n in (60, 99, 100):
        draw = random.Random(3)
        texts = [("prose", text(draw)) for _ in range(400)]
        texts += [("tables", text(draw, mark="|" if i % 3 else "||")) for i in range(n)]
        assert kept_of(spark, texts)[400:].all()
        rows = [(i, t, "en", source, 0, 0, "") for i, (source, t) in enumerate(texts)]
        measured = quality.measure(
            spark.createDataFrame(rows, SCHEMA), "text", "doc_id", "lang", "source", False)
        bounds = quality.fences(quality.quantile_sketches(measured)).collect()
        high += [b.high_symbol_share for b in bounds if b.source_key == "=tables"]
    assert abs(high[2] - high[1]) < 0.01 * high[1] and min(high) > 0.2
