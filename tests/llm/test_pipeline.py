"""The corpus pipeline, stage by stage, against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import made_documents
from tests.llm.test_quality_simhash_secrets import brute_fingerprint, brute_groups, brute_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents table with near copies and an extra column."""
    rows = [(i, t, lang, s, n, row) for i, t, lang, s, n, _, row in made_documents(seed=11, n=150)]
    longest = max((r for r in rows if r[1]), key=lambda r: len(r[1].split()))
    for i in range(4):
        rows.append((5000 + i, longest[1] + " tail" * (i % 2), *longest[2:]))
    path = str(tmp_path_factory.mktemp("pipeline"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows before the first and after each stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{i}"
        stage(spark, found[-1], folder).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_stages_keep_the_columns(stages):
    for frame in stages[1:-1]:
        assert frame.columns == [*COLUMNS, "row"]


def test_quality_stage(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    assert not after - before
    fine = Counter({r: n for r, n in before.items() if not brute_quality(r[1])[-1]})
    assert not after - fine
    clean = [r for r in fine if r[1].isascii() and len(set(r[1].split())) > 15]
    assert sum(r in after for r in clean) >= 0.9 * len(clean)


def test_exact_stage(stages):
    best = {}
    for doc_id, text, *_ in stages[1].collect():
        key = text or ""
        best[key] = max(best.get(key, -1), -1 if doc_id is None else doc_id)
    got = Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in stages[2].collect())
    assert got == Counter(best.items())


def test_near_stage(stages):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in stages[2].collect()]
    root = brute_groups([fp for _, fp in rows])
    least = {}
    for doc_id, fp in rows:
        least[root[fp]] = min(doc_id, least.get(root[fp], doc_id))
    assert Counter(r.doc_id for r in stages[3].collect()) == Counter(least.values())


def test_mix_stage(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert set(after) <= set(before) and max(after.values()) <= 3
    size = {r: len((r[1] or "").split()) for r in before}
    total = sum(size.values())
    taken = sum(size[r] * n for r, n in after.items())
    assert abs(taken - total) <= len({r[3] for r in before}) * max(size.values())


def test_pack_stage(stages):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            piece = ids[start:start + 4096]
            want[r.doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    found = stages[5].collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        ends = np.cumsum([0, *(n for _, n in sorted(own))])
        assert [o for o, _ in sorted(own)] == ends[:-1].tolist() and ends[-1] <= 4096


def test_run_is_the_chain(spark, folder, stages):
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows_of(corpus_pipeline.run(spark, folder).select(*kept)) == rows_of(
        stages[5].select(*kept))
