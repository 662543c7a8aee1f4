"""Personal data: fixed patterns, and boosted trees over every other proposed span.

Everything is Spark SQL functions. Base patterns always stand. Further generators propose
spans with high recall, also overlapping ones; each proposal has features of its format and
its context, is scored by gradient-boosted trees, and is redacted if its score reaches the
calibrated threshold of its kind, it touches no base span and no better proposal overlaps it.
The trees are fitted by Spark ML on `TRAINING_ROWS` labelled rows made from public formats,
calibrated on rows that the fit did not see, and written out as nested conditions, so that
scoring stays inside the one pass over the documents; nothing is shuffled.

Positions come from the lengths of matches and of the gaps between them. Patterns repeat
single character classes only: the separators that count (a dot between labels, a blank or
hyphen between digits) are first replaced, one for one, by a private-use character, so that
the matcher needs no stack for long texts, and no run of characters is tried from each of
its characters.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.llm.common import cut, text_of

TRAINING_ROWS = 3000
PRECISION = 0.98
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("mail_words", "number", "iban", "ipv6")

_DIGIT_SEP, _LABEL_SEP = "", ""
_LOCAL, _LABEL = f"A-Za-z0-9._%+{_LABEL_SEP}-", "A-Za-z0-9-"
_EMAIL = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{_LABEL_SEP}[{_LABEL}{_LABEL_SEP}]*+"
)
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_DIGIT_SEP}]{{15,}}"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_MORE = {
    "mail_words": (
        r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}"
        r"\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}"
    ),
    "number": r"(?<![0-9A-Za-z+.])[(]?[0-9][0-9()\x20./-]{6,24}[0-9](?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])",
}
_SPAN = "array<struct<kind:string,start:int,end:int>>"
_CONTEXTS = {
    "near_phone": r"phone|tel|call|mobile|fax|mobil|ruf|appel",
    "near_person": r"ssn|social|tax|passport|born|birth|insurance|steuer",
    "near_account": r"iban|account|konto|bank|compte|cuenta",
    "near_neutral": r"order|page|isbn|part|ref|invoice|version|year|items|range|serial",
}
_FEATURES = [
    "kind_no", "n_chars", "n_digits", "n_letters", "n_seps", "n_groups", "distinct",
    "joined_before", "joined_after", *_CONTEXTS,
]


def located(text: Column, pattern: str, kind: str) -> Column:
    """(kind, start, end) of the matches of `pattern` in `text`, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.filter(
        F.zip_with(
            F.split(text, pattern, -1), hits,
            lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")),
        ),
        lambda step: step["hit"].isNotNull(),
    )

    def add(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        end = start + step["hit"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    return F.aggregate(steps, nothing, add)["spans"]


def _value(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _in_byte(part: Column) -> Column:
    return F.coalesce(part.try_cast("int"), F.lit(256)) <= 255


def base_spans(text: Column) -> Column:
    """Spans of the base patterns that hold, by kind as listed, then start."""
    clean = F.translate(text, _DIGIT_SEP + _LABEL_SEP, "??")
    labels = F.regexp_replace(clean, rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", _LABEL_SEP)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", _DIGIT_SEP)
    empty = F.array().cast(_SPAN)
    number = text.rlike("[0-9]")

    def when(condition: Column, spans: Column) -> Column:
        return F.when(condition, spans).otherwise(empty)

    return F.concat(
        when(F.contains(text, F.lit("@")), located(labels, _EMAIL, "email")),
        when(number, F.filter(
            located(clean, _IP, "ip"),
            lambda s: F.forall(F.split(_value(text, s), r"\."), _in_byte),
        )),
        when(number, F.filter(
            located(joined, _CARD, "card"),
            lambda s: F.length(_digits(_value(text, s))).between(16, 19)
            & _luhn(_digits(_value(text, s))),
        )),
        when(F.contains(text, F.lit("+")), F.filter(
            located(text, _PHONE, "phone"),
            lambda s: F.length(_digits(_value(text, s))).between(8, 15),
        )),
    )


def proposals(text: Column) -> Column:
    """Spans of the further generators; they may overlap."""
    empty = F.array().cast(_SPAN)
    return F.when(
        text.rlike("[0-9]|[\\[(]at[\\])]"),
        F.concat(*[located(text, pattern, kind) for kind, pattern in _MORE.items()]),
    ).otherwise(empty)


def features(text: Column, span: Column) -> list[Column]:
    """Format and context of a proposal, as doubles in the order of _FEATURES."""
    value = _value(text, span)
    before = F.lower(
        F.substring(text, F.greatest(F.lit(1), span["start"] - 29), F.least(span["start"], F.lit(30)))
    )
    digits = _digits(value)
    kind_no = F.array_position(F.array(*[F.lit(k) for k in MORE_KINDS]), span["kind"])
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    found = [
        kind_no, F.length(value), F.length(digits), letters,
        F.length(value) - F.length(digits) - letters,
        F.size(F.split(value, "[^0-9A-Za-z]+")),
        F.size(F.array_distinct(F.split(digits, ""))),
        F.substring(text, span["start"], F.when(span["start"] > 0, 1).otherwise(0)).rlike("[\\w.$€#-]"),
        F.substring(text, span["end"] + 1, F.lit(1)).rlike("[\\w%$€°]"),
        *[before.rlike(pattern) for pattern in _CONTEXTS.values()],
    ]
    return [c.cast("double").alias(name) for c, name in zip(found, _FEATURES, strict=True)]


# Labelled rows: (shape, 1 if personal). # is a digit, ~ a capital, ^ a hex digit.
_SHAPES = [
    ("(###) ###-####", 1), ("0### ### ####", 1), ("0##-########", 1), ("##/########", 1),
    ("###-##-####", 1), ("~~## #### ####", 0), ("~~##~~~~##############", 1),
    ("~~####################", 1), ("jo.do## (at) mail# (dot) org", 1),
    ("a## [at] host [dot] com", 1), ("^^^^:^^^^:^^^^:^^^^:^^^^:^^^^", 1),
    ("#### #### #### ####", 0), ("19## - 20##", 0), ("####.##.## ##", 0), ("##/##/####", 0),
    ("### ### ###", 0), ("1.###.###.### ", 0), ("################", 0), ("####-####-#", 0),
    ("##:##:##:##", 0), ("~~##~~~~~~~~~~~~", 0), ("############", 0), ("20##-##-## ##", 0),
]
_LEADS = {
    1: ["phone", "call me", "tel", "ssn", "iban", "my account", "write to", "mobile", "and the"],
    0: ["order", "page", "isbn", "part", "in the range", "serial", "items", "and the", "version"],
}


def labelled_rows(spark: SparkSession, n: int = TRAINING_ROWS) -> DataFrame:
    """(id, text, label), from the shapes and leading words, the same at every call."""
    shape = F.pmod("id", F.lit(len(_SHAPES))).cast("int") + 1
    marks = F.sha2(F.col("id").cast("string"), 256)
    digits = F.translate(marks, "abcdef", "013579")

    def fill(char: Column, i: Column) -> Column:
        place = F.pmod(i * 7, F.lit(64)) + 1
        digit = F.substring(digits, place, F.lit(1))
        return (
            F.when(char == "#", digit)
            .when(char == "~", F.translate(digit, "0123456789", "ABCDEFGHKL"))
            .when(char == "^", F.substring(marks, place, F.lit(1))).otherwise(char)
        )

    def lead(label: int) -> Column:
        words = F.array(*[F.lit(w) for w in _LEADS[label]])
        return F.element_at(words, F.pmod(F.xxhash64("id"), F.lit(len(_LEADS[label]))).cast("int") + 1)

    return (
        spark.range(0, n, 1, 2)
        .withColumn("shape", F.element_at(F.array(*[F.lit(s) for s, _ in _SHAPES]), shape))
        .withColumn("label", F.element_at(F.array(*[F.lit(float(y)) for _, y in _SHAPES]), shape))
        .withColumn("value", F.array_join(F.transform(F.split("shape", ""), fill), ""))
        .withColumn("lead", F.when(F.col("label") == 1, lead(1)).otherwise(lead(0)))
        .select("id", F.concat_ws(" ", F.lit("so"), "lead", "value", F.lit("is it")).alias("text"), "label")
    )


class SpanModel:
    """Boosted trees as a column expression, and the threshold of each kind."""

    def __init__(self, spark: SparkSession, n: int = TRAINING_ROWS, precision: float = PRECISION):
        rows = cut(labelled_rows(spark, n), "pii-labelled")
        rows = rows.withColumn("span", F.explode(proposals(F.col("text"))))
        rows = cut(
            rows.select("id", "label", "span.kind", *features(F.col("text"), F.col("span"))),
            "pii-features",
        )
        held = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0
        fit = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(rows.where(~held))
        model = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.4, seed=8, maxBins=32).fit(fit)
        self.trees = [
            (weight, tree._java_obj.rootNode())
            for weight, tree in zip(model.treeWeights, model.trees, strict=True)
        ]
        scored = rows.where(held).select("kind", "label", self.score(lambda name: F.col(name)).alias("p"))
        self.thresholds = _thresholds(scored.collect(), precision)  # at most n rows

    def score(self, feature) -> Column:
        """Probability that a proposal is personal; `feature` gives a column by name."""

        def walk(node) -> Column:
            if node.numDescendants() == 0:
                return F.lit(float(node.prediction()))
            split = node.split()
            value = feature(_FEATURES[split.featureIndex()])
            return F.when(value <= float(split.threshold()), walk(node.leftChild())).otherwise(
                walk(node.rightChild())
            )

        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(float(weight)) * walk(root)
        return 1 / (1 + F.exp(-2 * total))


def _thresholds(scored: list, precision: float) -> dict[str, float]:
    """Per kind the lowest score from which held-out proposals reach `precision`."""
    found = {}
    for kind in MORE_KINDS:
        own = sorted(((r["p"], r["label"]) for r in scored if r["kind"] == kind), reverse=True)
        right, best = 0.0, 2.0
        for i, (p, label) in enumerate(own, 1):
            right += label
            tie = i < len(own) and own[i][0] == p
            if not tie and right / i >= precision:
                best = p
        found[kind] = max(best, 0.5)
    return found


def select_spans(text: Column, base: Column, model: SpanModel) -> Column:
    """Proposals to redact: above threshold, off the base spans, best where they overlap.

    Spans are swept in order of their starts, so the work follows their number. Of touching
    proposals the better stays, in the order of their starts; on equal scores the earlier one.
    """
    proposed = F.transform(
        F.transform(
            proposals(text),
            lambda s: F.struct(s.alias("span"), F.struct(*features(text, s)).alias("f")),
        ),
        lambda c: _entry(c["span"], 1, model.score(lambda name: c["f"][name])),
    )

    def reached(c: Column) -> Column:
        limit = F.lit(2.0)
        for kind, threshold in model.thresholds.items():
            limit = F.when(c["kind"] == kind, F.lit(threshold)).otherwise(limit)
        return c["p"] >= limit

    fixed = F.transform(base, lambda s: _entry(s, 0, F.lit(1.0)))
    every = F.array_sort(F.concat(fixed, F.filter(proposed, reached)))
    return F.transform(_best(F.filter(clear_of_base(every), lambda c: c["more"] == 1)), _span)


def clear_of_base(spans: Column) -> Column:
    """Of sorted entries the base spans, and the others that touch none; swept both ways."""
    behind = _sweep(
        spans, F.lit(0), lambda edge, c: F.greatest(edge, c["end"]),
        lambda edge, c: c["start"] >= edge,
    )
    before = _sweep(
        F.reverse(behind), F.lit(2**31 - 1), lambda edge, c: F.least(edge, c["start"]),
        lambda edge, c: c["end"] <= edge,
    )
    return F.reverse(before)


_ENTRY = "struct<start:int,more:int,kind:string,end:int,p:double>"


def _entry(span: Column, more: int, p: Column) -> Column:
    """A span as it is sorted: by start, base spans first."""
    return F.struct(
        span["start"].alias("start"), F.lit(more).alias("more"), span["kind"].alias("kind"),
        span["end"].alias("end"), p.alias("p"),
    ).cast(_ENTRY)


def _span(c: Column) -> Column:
    return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))


def _sweep(spans: Column, edge: Column, move, clear) -> Column:
    """All base spans, and the others that are `clear` of the edge that base spans `move`."""
    def step(done: Column, c: Column) -> Column:
        is_base = c["more"] == 0
        stays = is_base | clear(done["edge"], c)
        return F.struct(
            F.when(is_base, move(done["edge"], c)).otherwise(done["edge"]).alias("edge"),
            F.when(stays, F.concat(done["spans"], F.array(c))).otherwise(done["spans"])
            .alias("spans"),
        )

    start = F.struct(edge.alias("edge"), F.array().cast(f"array<{_ENTRY}>").alias("spans"))
    return F.aggregate(spans, start, step)["spans"]


def _best(spans: Column) -> Column:
    """Of spans in order of their starts one of each two that touch: the one of higher score."""
    def step(done: Column, c: Column) -> Column:
        last = done["last"]
        apart = last.isNull() | (c["start"] >= last["end"])
        return F.struct(
            F.when(apart & last.isNotNull(), F.concat(done["spans"], F.array(last)))
            .otherwise(done["spans"]).alias("spans"),
            F.when(apart | (c["p"] > last["p"]), c).otherwise(last).alias("last"),
        )

    start = F.struct(
        F.array().cast(f"array<{_ENTRY}>").alias("spans"), F.lit(None).cast(_ENTRY).alias("last")
    )
    return F.aggregate(
        spans, start, step,
        lambda done: F.when(done["last"].isNull(), done["spans"])
        .otherwise(F.concat(done["spans"], F.array(done["last"]))),
    )


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda span: span["kind"] == kind)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, counts and digest of the base spans, all spans.

    Positions are code points, ends exclusive; `spans` holds the base spans, then the others
    by kind and start. A null or empty text has no spans; repeated rows and null ids are rows
    like any other. No documents: no rows.
    """
    model = SpanModel(docs.sparkSession)
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("whole")
    ).withColumn("base", base_spans(F.col("whole")))
    found = found.withColumn("more", select_spans(F.col("whole"), F.col("base"), model))
    count = {kind: F.size(_of_kind("base", kind)) for kind in BASE_KINDS}
    more = F.concat(*[_of_kind("more", kind) for kind in MORE_KINDS])
    return found.select(
        "doc_id", *[c.cast("long").alias(f"n_{kind}") for kind, c in count.items()],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", more)).alias("spans"),
    )
