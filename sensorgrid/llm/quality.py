"""Quality rules with thresholds that adapt to each language and source.

One pass measures every text. Fixed base rules come first; what passes them is held against
fences taken from quantile sketches of its own (language, source). A sketch counts values in
buckets of constant relative width (1 %), so sketches merge by adding counts, in any order,
with the same result: they are plain grouped counts that combine before the shuffle, and a
source with a third of all rows is a few hundred counts per task.

A fence lies `spread` half-spreads (median to quartile) and a small floor beyond the quartile.
It moves on to the next quantile of UPPER as long as that quantile lies within the fence: a
tail that goes on evenly is the habit of the group, a tail behind a gap is not. The fence of
a (language, source) is averaged with its language's, and that with the fence of all, by
weights rows : `prior` that change smoothly with the rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorgrid.llm.common import cut, text_of

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_WINDOW = 8
MIN_WORDS = 20
#: metric: (floor of the distance from quantile to fence, fence below too)
METRICS = {
    "word_length": (0.5, True),
    "symbol_share": (0.03, False),
    "dup_line_share": (0.1, False),
    "stutter_share": (0.05, False),
    "upper_share": (0.05, False),
    "mark_share": (0.05, False),
}
SPREAD = 4.0
#: further quantiles above the third quartile; below the first they are mirrored
UPPER = (0.9, 0.95, 0.98, 0.99)
#: rows for which the own fence and the wider one count the same
PRIOR = 20
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_GAMMA = 1.01 / 0.99
_SMALL = 1e-6


def repeated_words(words: list[str], window: int = _WINDOW) -> int:
    """Words inside windows of `window` (a power of two) words that occur more than once."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[str, int] = {}
    code = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    width = 1
    while width < window:  # equal codes: equal runs of `width` words
        code = np.unique(code[:-width] * n + code[width:], return_inverse=True)[1]
        width *= 2
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(np.bincount(code)[code] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure_text(text: str) -> tuple:
    """The five counts of the base rules and the six metrics, in the order of METRICS."""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = Counter(line for line in text.split("\n") if line.strip(_SPACES))
    n_lines = sum(lines.values())
    dup = n_lines - len(lines)
    repeats = repeated_words(words)
    stutter = sum(map(str.__eq__, words, words[1:]))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    marks = text.count("!") + text.count("?")
    n_or_1 = max(n, 1)
    return (
        n, chars, symbols, dup, repeats,
        chars / n_or_1, symbols / max(chars, 1), dup / max(n_lines, 1),
        stutter / n_or_1, upper / n_or_1, marks / n_or_1,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(zip(*map(measure_text, batch.column("whole").to_pylist()), strict=True))
        columns = {n: batch.column(n) for n in batch.schema.names if n != "whole"}
        for i, name in enumerate([*_COUNTS, *METRICS]):
            kind = pa.int64() if i < len(_COUNTS) else pa.float64()
            columns[name] = pa.array(found[i] if found else [], kind)
        yield pa.RecordBatch.from_pydict(columns)


def _key(name: str) -> Column:
    """A key that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def measure(
    docs: DataFrame, text: str, id_col: str, lang: str, source: str, carry_rows: bool
) -> DataFrame:
    """Counts, metrics and `base_failed` of every document."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), _key(lang).alias("lang_key"),
        _key(source).alias("source_key"), text_of(text).alias("whole"),
        *([F.struct("*").alias("row")] if carry_rows else []),
    )
    schema = StructType([f for f in rows.schema.fields if f.name != "whole"])
    for name in _COUNTS:
        schema = schema.add(name, "long")
    for name in METRICS:
        schema = schema.add(name, "double")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 30 * F.col("n_words")
    )
    return rows.mapInArrow(_measure, schema).withColumn("base_failed", failed)


def quantile_sketches(measured: DataFrame) -> DataFrame:
    """Counts per (language, source, metric, bucket) of what passes the base rules."""
    values = measured.where(~F.col("base_failed")).select(
        "lang_key", "source_key",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in METRICS
        ])).alias("m"),
    )
    bucket = F.when(F.col("m.value") <= _SMALL, F.lit(None)).otherwise(
        F.ceil(F.log(F.col("m.value")) / F.lit(float(np.log(_GAMMA))))
    )
    return values.select("lang_key", "source_key", "m.metric", bucket.alias("bucket")).groupBy(
        "lang_key", "source_key", "metric", "bucket"
    ).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows, quartiles and outer quantiles per group and metric, merging finer sketches."""
    merged = sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    up_to = group.orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    counted = merged.select(
        "*", F.sum("n").over(up_to).alias("up_to"), F.sum("n").over(group).alias("rows")
    )
    middle = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(
        2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (1 + _GAMMA)
    )

    def at(share: float) -> Column:
        return F.min(F.when(F.col("up_to") >= share * F.col("rows"), middle))

    return counted.groupBy(*by, "metric").agg(
        F.first("rows").alias("rows"), at(0.25).alias("q1"), at(0.5).alias("q2"),
        at(0.75).alias("q3"),
        *[at(u).alias(f"above_{i}") for i, u in enumerate(UPPER)],
        *[at(1 - u).alias(f"below_{i}") for i, u in enumerate(UPPER)],
    )


def _own_fences(found: DataFrame, by: list[str], spread: float) -> DataFrame:
    """rows, high and low per group and metric, from its own quantiles."""
    floor = F.lit(0.0)
    for metric, (least, _) in METRICS.items():
        floor = F.when(F.col("metric") == metric, F.lit(least)).otherwise(floor)
    up = F.lit(spread) * (F.col("q3") - F.col("q2")) + floor
    down = F.lit(spread) * (F.col("q2") - F.col("q1")) + floor
    high, low = F.col("q3") + up, F.col("q1") - down
    for i in range(len(UPPER)):
        above, below = F.col(f"above_{i}"), F.col(f"below_{i}")
        high = F.when(above <= high, above + up).otherwise(high)
        low = F.when(below >= low, below - down).otherwise(low)
    return found.select(*by, "metric", "rows", high.alias("high"), low.alias("low"))


def fences(sketches: DataFrame, spread: float = SPREAD, prior: float = PRIOR) -> DataFrame:
    """One row per (language, source) with `high_` and `low_` and the metric's name."""
    def of(*by: str) -> DataFrame:
        return _own_fences(quantiles(sketches, list(by)), list(by), spread)

    wide = of("lang_key").select(
        "lang_key", "metric", *[F.col(c).alias(f"lang_{c}") for c in ("rows", "high", "low")]
    )
    every = {r["metric"]: r for r in of().collect()}  # one row per metric

    def blend(name: str) -> Column:
        fence = F.lit(0.0)
        for metric, row in every.items():
            fence = F.when(F.col("metric") == metric, F.lit(row[name])).otherwise(fence)
        for level in ("lang_", ""):
            own = F.col(f"{level}rows") / (F.col(f"{level}rows") + F.lit(float(prior)))
            fence = own * F.col(f"{level}{name}") + (1 - own) * fence
        return fence

    picked = of("lang_key", "source_key").join(wide, ["lang_key", "metric"]).select(
        "lang_key", "source_key", "metric", blend("high").alias("high"), blend("low").alias("low")
    )
    return picked.groupBy("lang_key", "source_key").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("high"))).alias(f"high_{m}") for m in METRICS],
        *[F.max(F.when(F.col("metric") == m, F.col("low"))).alias(f"low_{m}")
          for m, (_, below) in METRICS.items() if below],
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    carry_rows: bool = False,
) -> DataFrame:
    """One row per document: doc_id, counts, metrics, base_failed, kept and broken (the
    metrics beyond their fence); `row` too, if `carry_rows`.

    A null text has no words and fails; a null language or source is a group of its own;
    repeated rows are judged each for themselves. No documents: no rows.
    """
    measured = measure(docs, text, id_col, lang, source, carry_rows)
    if carry_rows:  # measured twice rather than written with the whole rows
        sketched = measure(docs, text, id_col, lang, source, False)
    else:
        sketched = measured = cut(measured, "quality")
    bounds = fences(cut(quantile_sketches(sketched), "quality-sketches"))
    broken = F.array_compact(F.array(*[
        F.when(
            (F.col(m) > F.col(f"high_{m}"))
            | ((F.col(m) < F.col(f"low_{m}")) if below else F.lit(False)),
            F.lit(m),
        )
        for m, (_, below) in METRICS.items()
    ]))
    judged = measured.join(bounds, ["lang_key", "source_key"], "left").withColumn(
        "broken", broken
    )
    fine = ~F.col("base_failed") & (F.size("broken") == 0)
    return judged.select(
        "doc_id", *_COUNTS, *METRICS, "base_failed", fine.alias("kept"), "broken",
        *(["row"] if carry_rows else []),
    )


def drop_low_quality(docs: DataFrame, **columns) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    return judge(docs, carry_rows=True, **columns).where("kept").select("row.*")
