"""Repeated strings, page text and personal data against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sensorgrid.llm import html_text, pii, repeats
from tests.llm.conftest import SCHEMA


def brute_removal(texts, length):
    starts = defaultdict(list)
    for i, data in enumerate(texts):
        for p in range(len(data) - length + 1):
            starts[data[p:p + length]].append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for at in starts.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p:p + length] = b"\x01" * length
    out = []
    for data, mask in zip(texts, gone, strict=True):
        spans = len(re.findall(b"\x01+", bytes(mask)))
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        out.append((len(data), sum(mask), spans, kept))
    return out


def repetitive_texts(seed, length):
    draw = random.Random(seed)

    def some(low, high):
        return "".join(draw.choices("abcdefghé \n", k=draw.randint(low, high)))

    shared = [some(length - 20, length + 60) for _ in range(6)]
    short = some(length - 12, length - 8)  # inside many documents, never a repeat by itself
    base = some(6 * length, 8 * length)
    texts = []
    for _ in range(30):  # near copies
        text = list(base)
        for _ in range(draw.randint(0, 6)):
            text[draw.randrange(len(text))] = "X"
        texts.append("".join(text))
    texts += [some(0, length) + draw.choice(shared) + some(0, length) for _ in range(40)]
    texts += [some(5, 60) + short + some(5, 60) for _ in range(60)]
    texts += ["a" * 3 * length, "ab" * 2 * length, "a" * (length + 1), base, base, "", None]
    texts += [some(50, 3 * length) for _ in range(20)]
    return texts


@pytest.mark.parametrize(("seed", "length", "crowd"), [(1, 64, 1000), (2, 64, 8), (3, 400, 5)])
def test_repeats(spark, seed, length, crowd):
    texts = repetitive_texts(seed, length)
    rows = [(i, t, "en", "s", 0, 0, "") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = repeats.remove_repeats(docs, length=length, crowd=crowd).collect()
    want = brute_removal([(t or "").encode() for t in texts], length)
    assert len(found) == len(texts)
    for r in found:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, removed, spans), r.doc_id
        assert bytes(r.kept) == kept


@pytest.mark.parametrize("seed", range(5))
def test_index_of_a_shard(seed):
    draw = random.Random(seed)
    core = bytes(draw.choices(range(256), k=300))
    contexts = []
    for _ in range(12):
        data = bytearray(core[draw.randint(0, 100):draw.randint(150, 300)])
        data[draw.randrange(len(data))] ^= 1
        contexts.append(bytes(data))
    length = 40
    marked = set()
    for i, low, high in repeats.repeated_ranges(contexts, length):
        marked |= {(i, p) for p in range(low, high + 1)}
    windows = defaultdict(list)
    for i, data in enumerate(contexts):
        for p in range(len(data) - length + 1):
            windows[data[p:p + length]].append((i, p))
    assert marked == {x for at in windows.values() if len(at) > 1 for x in at}


def test_suffix_order():
    draw = random.Random(4)
    parts = [bytes(draw.choices(b"ab", k=draw.randint(1, 40))) for _ in range(20)]
    symbols = []
    for part in parts:
        symbols += [b + 1 for b in part] + [0]
    import numpy as np

    ends = [i for i, s in enumerate(symbols) if s == 0]
    ranks = {p: i for i, p in enumerate(ends)}
    plain = [s + 100 if s else ranks[i] for i, s in enumerate(symbols)]
    want = sorted(range(len(plain)), key=lambda i: plain[i:])
    assert repeats.suffix_order(np.array(symbols)).tolist() == want


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 500)
    draw = random.Random(6)
    data = bytes(draw.choices(b"abcdefgh", k=3000))
    data += data[700:1400] + b"-" + data[:90]
    batches = list(repeats._pieces([b"t"], [data], 64))
    starts = [b + i for group in batches for _, b, part in group for i in range(len(part) - 63)]
    assert sorted(starts) == list(range(len(data) - 63))


def test_odd_rows(docs, no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0
    found = repeats.remove_repeats(docs, length=32)
    assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in docs.collect())
    assert pii.find_personal_data(docs).count() == docs.count()
    assert pii.find_personal_data(no_docs).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script>
</head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now!</div>
<article><h1>A &amp; B</h1><p>First   line<br>goes
on &eacute;&#233;.<p><b>Second<i> one</b>.</p><ul><li>one<li>two</ul><aside>no</aside>
<form><input><button>send</button></form><p>x</article>
<section id="comments"><p>I disagree with all of this, at length and in detail.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == (
        "A & B\n\nFirst line goes on éé.\n\nSecond one.\n\none\n\ntwo\n\nx")


def test_page_without_article():
    text = "A paragraph of some length that tells a story about something. " * 4
    page = (
        "<body><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(12)) + "</ul>"
        + "<div class='sidebar'><p>" + text + "</p></div>"
        + "".join(f"<p>{i} {text}</p>" for i in range(5)) + "<div><a href=/>Imprint</a></div></body>"
    )
    assert html_text.main_text(page) == "\n\n".join(f"{i} {text}".strip() for i in range(5))


def test_pages(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (None, "u", "", 1), (3, "u", "<p>a<b", 1),
            (3, "u", "<p>a<b", 1), (4, "u", "plain & text", 1), (5, "u", "<![bad <!-- x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = html_text.extract_text(pages).collect()
    assert Counter(r.page_id for r in found) == Counter(r[0] for r in rows)
    assert all(len(r.text) == r.n_chars for r in found)
    texts = {r.page_id: r.text for r in found}
    assert texts[2] == texts[None] == "" and texts[4] == "plain & text" and texts[3] == "a<b"
    assert html_text.extract_text(pages.limit(0)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits), 1):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_personal(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def personal_texts():
    draw = random.Random(2)
    parts = ["a@b.c", "@", ".", "..", "x_y", "-", "é", "1.2.3.4", "256.1.1.1", "01.002.3.4", "0", " ",
             "4111 1111 1111 1111", "4111-1111 1111-1112", "4111111111111111", "+1 (372) 555-2774",
             "+", "(", ")", "12", "\n", "b-c", "%", "", "", "😀", "mail.x", "  "]
    return ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(800)] + [
        None, "", "1" * 40_000, "a" * 40_000 + "@b.c", "a." * 20_000 + "a@b.c", "1 " * 20_000,
        "+" + "1-" * 20_000, "1." * 20_000 + "x",
    ]


def test_personal_data(spark):
    texts = personal_texts()
    rows = spark.createDataFrame([(i, t, "en", "s", 0, 0, "") for i, t in enumerate(texts)], SCHEMA)
    for r in pii.find_personal_data(rows).collect():
        want = brute_personal(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s.startswith(k + ":") for s in want) for k in PATTERNS)
        base = [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS]
        assert base == want


def test_many_candidates_take_time_in_proportion(spark):
    """A page of thousands of numbers; nested re-evaluation took 23 s for 300 of them."""
    numbers = [f"call (555) {100 + i % 900:03d}-{i % 10_000:04d}" for i in range(4000)]
    rows = spark.createDataFrame(
        [(1, "\n".join(numbers), "en", "s", 0, 0, ""), (2, numbers[0], "en", "s", 0, 0, "")], SCHEMA)
    started = time.time()
    found = {r.doc_id: r for r in pii.find_personal_data(rows).collect()}
    assert time.time() - started < 60
    assert found[1].spans.count("number:") == 4000 and found[2].spans.count("number:") == 1


def test_overlapping_spans(spark):
    draw, columns = random.Random(3), ("kind string, start int, end int, p double, more int")
    for _ in range(30):
        spans = []
        for _ in range(draw.randint(0, 12)):
            start = draw.randint(0, 40)
            spans.append(("k", start, start + draw.randint(1, 9), draw.random(), draw.randint(0, 1)))
        base = [s for s in spans if not s[4]]
        free = sorted(s for s in spans if s[4] and not any(
            s[1] < b[2] and b[1] < s[2] for b in base))
        want = []
        for s in free:
            if not want or s[1] >= want[-1][2]:
                want.append(s)
            elif s[3] > want[-1][3]:
                want[-1] = s
        row = spark.createDataFrame([(spans,)], f"spans array<struct<{columns.replace(' ', ':')
            .replace(',:', ',')}>>")
        entries = F.array_sort(F.transform("spans", lambda c: F.struct(
            c["start"].alias("start"), c["more"].alias("more"), c["kind"].alias("kind"),
            c["end"].alias("end"), c["p"].alias("p"))))
        found = row.select(pii._best(F.filter(pii.clear_of_base(entries), lambda c: c["more"] == 1)))
        assert [(r.start, r.end) for r in found.first()[0]] == [s[1:3] for s in want]


def test_span_model_on_rows_it_has_not_seen(spark):
    model = pii.SpanModel(spark)
    rows = pii.labelled_rows(spark, 4600).where(f"id >= {pii.TRAINING_ROWS}").withColumn(
        "base", pii.base_spans(F.col("text")))
    rows = rows.withColumn("more", pii.select_spans(F.col("text"), F.col("base"), model))
    found = rows.select("label", (F.size("more") > 0).alias("hit")).collect()
    positive = [r.hit for r in found if r.label == 1]
    negative = [r.hit for r in found if r.label == 0]
    assert sum(positive) / len(positive) > 0.85
    assert sum(negative) / len(negative) < 0.05
