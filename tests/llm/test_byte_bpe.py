"""Byte-level BPE against the plain library, and round trips."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sensorgrid.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding(
        "plain", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )


def _round_trip(spark, docs, keep=("doc_id",)):
    encoded = byte_bpe.encode(docs, RANKS, PATTERN, keep)
    decoded = byte_bpe.decode(
        encoded.withColumn("copy", F.col("ids")), byte_bpe.token_table(spark, RANKS)
    )
    return decoded.collect()


def test_equals_the_library(spark, docs, plain):
    texts = {}
    for row in docs.collect():
        texts.setdefault(row["doc_id"], []).append(row["text"] or "")
    found = _round_trip(spark, docs, ("doc_id", "lang"))
    assert len(found) == docs.count()
    for row in found:
        text = texts[row["doc_id"]][0]
        assert row["copy"] == plain.encode_ordinary(text)
        assert bytes(row["bytes"]) == text.encode()


def test_rare_characters_and_white_space(spark, plain):
    draw = random.Random(5)
    odd = "\x1c\x1d\x1f\x85\xa0  ​﻿　̀ั\U0001f600\U000e0001'"
    texts = [
        "".join(
            draw.choice([draw.choice(odd), draw.choice(" \n\t'sT12"), chr(draw.randrange(0xD000)),
                         chr(draw.randrange(0xE000, 0x110000))])
            for _ in range(200)
        )
        for _ in range(200)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in _round_trip(spark, docs):
        assert row["copy"] == plain.encode_ordinary(texts[row["doc_id"]])
        assert bytes(row["bytes"]) == texts[row["doc_id"]].encode()


@pytest.mark.parametrize("block_tokens", [1, 50, 3000])
def test_small_blocks_give_the_same_rows(spark, docs, plain, block_tokens):
    texts = {row["doc_id"]: row["text"] or "" for row in docs.collect()}
    found = byte_bpe.encode(docs, RANKS, PATTERN, block_tokens=block_tokens).collect()
    assert len(found) == docs.count()
    for row in found:
        assert row["ids"] == plain.encode_ordinary(texts[row["doc_id"]])


def test_packed_numbers_come_back():
    numbers = byte_bpe.np.random.default_rng(1).integers(0, 1 << 24, 5000)
    assert (byte_bpe.unpack(byte_bpe.pack(numbers)) == numbers).all()
    assert byte_bpe.unpack(byte_bpe.pack(numbers[:0])).tolist() == []


def test_unknown_ids_empty_arrays_and_no_rows(spark, no_docs):
    table = byte_bpe.token_table(spark, RANKS)
    rows = [(1, [3, None, 60_000, 4]), (2, []), (3, None), (4, [5] * 5000), (5, [-7, 3])]
    pieces = {v: k for k, v in byte_bpe.read_ranks(RANKS).items()}
    found = {
        r["doc_id"]: bytes(r["bytes"])
        for r in byte_bpe.decode(
            spark.createDataFrame(rows, "doc_id long, ids array<int>"), table
        ).collect()
    }
    assert found == {1: pieces[3] + pieces[4], 2: b"", 3: b"", 4: pieces[5] * 5000, 5: pieces[3]}
    assert _round_trip(spark, no_docs) == []
