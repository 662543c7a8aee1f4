"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid import ship_package
from sensorgrid.llm import (
    byte_bpe, exact_dedup, html_text, mixing, packing, periodic_runs, pii, quality, repeats, secret_scan, sharding, simhash,
    whitening,
)
from sensorgrid.llm.common import prepare, text_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of near-duplicates."""
    return simhash.find_near_copies(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without their repeated strings of 400 bytes."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and adaptive verdict of all documents."""
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id of each stays."""
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("key").alias("text_sha256")
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mix of all sources."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return packing.pack_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first four whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of all documents; where crc32(doc_id) % 10 = 0 the words from a on
    repeat the p words from a. A null doc_id has no such hash; its text stays."""
    words = F.filter(F.split(text_of("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    listed = marked.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    placed = listed.withColumn("n", F.size("words")).withColumn(
        "a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    ).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    changed = F.slice(
        F.concat(
            F.slice("words", F.lit(1), F.col("a")),
            F.flatten(F.array_repeat(
                period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
            )),
        ),
        F.lit(1), F.col("n"),
    )
    return placed.select(
        "doc_id",
        F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text"))
        .alias("text"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, and what is left without the repeats."""
    docs = _with_planted_runs(_table(spark, sf_dir, "documents"))
    found = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.best_run())
    lines = F.transform("runs", lambda r: F.concat_ws(
        "", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")
    ))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
        .alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept_words", 256).alias("collapsed_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the bytes that they decode to."""
    docs = _table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
    )
    return byte_bpe.decode(encoded, byte_bpe.token_table(spark, ranks)).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256")
    )


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_repeats": op2_repeats,
    "op3_secret_scan": op3_secret_scan,
    "op4_sharding": op4_sharding,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES = {
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
            row_number() over (partition by coalesce(text, '') order by doc_id desc) = 1 as kept,
            sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
}
