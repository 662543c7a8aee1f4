"""Mixing sources to target weights by random keys and distributed prefix sums.

Every document gets a hash-random key. Within each source the keys are cut into ranges;
sums per range give the offset of a range, a window inside the range the rest, so a source
with a third of all rows is spread over its ranges and no task sees a whole source. A source
is taken in full as many times as its target holds it, then in key order up to the exact
word of its target. Targets are filled like water: one common level, and each source at its
weight times the level or at its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.llm.common import (
    PLACE, SPACE, cut, located, numbered, part_of, place_of, text_of,
)

WEIGHTS = (5, 2, 1)
_RANGE_BITS = 10


def word_count(text: Column) -> Column:
    """Number of words in a text."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, f"[{SPACE}]+"))
    ).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3
) -> DataFrame:
    """One row per source: no_source, name, source_size, target.

    `sized` has no_source (true for the null source), name and size. Sources are ranked by
    code point, null last, and take the weights in turn. Only single sums reach the driver.
    """
    sources = sized.groupBy("no_source", "name").agg(F.sum("size").alias("source_size"))
    ordered = sources.repartitionByRange("no_source", "name").sortWithinPartitions(
        "no_source", "name"
    )
    ordered = cut(numbered(ordered, "row_no"), "mix-sources").select(
        "*", part_of("row_no").alias("part"), place_of("row_no").alias("place")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    rank = F.pmod(F.col("offset") + F.col("place"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank.cast("int") + 1)
    ranked = cut(
        ordered.join(offsets, "part").select(
            "no_source", "name", "source_size", weight.alias("weight"),
            (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
        ),
        "mix-ranked",
    )
    total, weight_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / (weight_sum or 1), -1
    while True:
        capped = F.col("weight") * F.lit(level) > F.col("cap")
        n, held, free = ranked.agg(
            F.count(F.when(capped, 1)), F.sum(F.when(capped, F.col("cap"))),
            F.sum(F.when(~capped, F.col("weight"))),
        ).first()
        if n == full or not free:
            break
        full, level = n, (total - (held or 0)) / free
    target = F.least(F.col("weight") * F.lit(float(level)), F.col("cap"))
    return ranked.select("no_source", "name", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    source: str = "source",
    seed: int = 9,
    whole_documents: bool = False,
    place: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken and times.

    `taken` is the number of words the mix takes of the document, repeats counted; at a
    source's budget a document may be taken in part. `times` is how often the whole document
    is taken when the budget is rounded to the nearer document. With `whole_documents`,
    taken is times * size. Keys depend on content only, so another layout of the input gives
    the same mix; equal rows share their key and follow each other. A null text has no
    words, a null source is a source of its own. No documents: no rows. Columns of `place`
    tell rows apart and are kept; they order equal rows and do not enter the keys.
    """
    rows = docs.select(
        *place,
        F.col(id_col).alias("doc_id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
        word_count(text_of(text)).alias("size"),
    )
    groups = cut(
        rows.groupBy(*place, "doc_id", "no_source", "name", "size").agg(F.count("*").alias("repeats")),
        "mix-rows",
    ).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "name", "size"))
    groups = groups.withColumn("range", F.shiftrightunsigned("key", 64 - _RANGE_BITS))
    words = F.col("size") * F.col("repeats")
    targets = source_targets(groups.withColumn("size", words))

    of_source = ["no_source", "name"]
    sums = groups.groupBy(*of_source, "range").agg(F.sum(words).alias("held"))
    ranges = Window.partitionBy(*of_source).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select(
        *of_source, "range", F.coalesce(F.sum("held").over(ranges), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(*of_source, "range").orderBy("key", "doc_id", "size", *place).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = (
        groups.withColumn("inner", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(offsets, [*of_source, "range"])
        .join(targets, of_source)
        .withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
    )
    start = F.col("offset") + F.col("inner") + F.col("repeat") * F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    placed = (
        placed.withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size") - start)
    )
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("rest"), F.col("size")))
    nearer = ((F.col("rest") > 0) & (F.col("rest") * 2 >= F.col("size"))).cast("long")
    times = F.col("epochs") + nearer
    taken = times * F.col("size") if whole_documents else F.col("epochs") * F.col("size") + part
    return placed.select(
        *place, "doc_id", "size", "source_size", "target", taken.alias("taken"), times.alias("times")
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, whole documents only.

    A scan of files is read twice, not written (see `located`).
    """
    rows = located(docs)
    plan = mix_sources(
        rows.select(
            *PLACE, F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"),
            F.col("row.source").alias("source"),
        ),
        place=tuple(PLACE), **options,
    ).where("times > 0").select(*PLACE, "times")
    return rows.join(plan, PLACE).select(
        "row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_time")
    ).drop("_time")
