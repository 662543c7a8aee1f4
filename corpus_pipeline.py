"""Quality rules, exact and near de-duplication, mixing and packing over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows it gets and returns a DataFrame;
between two stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorgrid import ship_package
from sensorgrid.llm import exact_dedup, mixing, packing, quality, simhash
from sensorgrid.llm.common import cut, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    _ready(spark)
    return quality.drop_low_quality(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    _ready(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by fingerprint or similarity, the row with the smallest doc_id."""
    _ready(spark)
    return simhash.drop_near_copies(docs, radius=simhash.RADIUS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    _ready(spark)
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into windows of tokens."""
    _ready(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has neither the hash of the fingerprints nor the tokenizer; see tests/llm.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    prepare(spark)
    ship_package(spark)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
