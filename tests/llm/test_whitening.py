"""Whitening against numpy in one piece, and its edge cases."""

import math

import numpy as np
import pytest

from sensorgrid.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, x int"


def plain(rows, width, parts=4):
    """(rows of (id, deviation, whitened...), explained) of [(id, floats)]."""
    x = np.array([
        [math.floor(256.0 * float(np.float32(c))) for c in v] + [0] * (width - len(v))
        for _, v in rows
    ])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:parts], axes[:, ::-1][:, :parts]
    z = (x - sums / n) @ axes / np.sqrt(values)
    explained = values / np.trace(centred.T @ centred / n)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return n, deviation, z, explained


def check(found, rows, width):
    n, deviation, z, explained = plain(rows, width)
    ids = [i for i, _ in rows]
    assert len(found) == len(rows) * z.shape[1]
    got = np.full(z.shape, np.nan)
    for row in found:
        at, c = ids.index(row["vec_id"]), row["component"] - 1
        assert row["n"] == n and row["deviation"] == deviation[at]
        assert abs(row["explained"] / explained[c] - 1) < 1e-9
        assert row["identity_error"] < 1e-9
        got[at, c] = row["whitened"]
    for c in range(z.shape[1]):
        assert min(np.abs(got[:, c] - z[:, c]).max(), np.abs(got[:, c] + z[:, c]).max()) < 1e-8


def test_equals_one_piece_with_copies_and_unusable_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(size=6)]) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(1500)]
    bad = [(9000, None), (9001, [1.0, None] * 3), (9002, [float("nan")] * 6),
           (9003, [float("-inf")] + [0.0] * 5)]
    table = spark.createDataFrame(
        [(i, v, 1, "c", 2) for i, v in rows + bad], SCHEMA
    ).repartition(5)
    check(whitening.whiten(table).collect(), rows, 6)


def test_given_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    rows = [
        (r["vec_id"], r["embedding"])
        for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ]
    check(queries.op11_whitening(spark, sf).collect(), rows, len(rows[0][1]))


def test_short_vectors_count_as_zero(spark):
    rows = [(1, [0.5, 0.25, 1.0]), (2, [1.0]), (3, []), (4, [0.0, 2.0]), (5, [3.0, 1.0, -1.0])]
    table = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA)
    found = whitening.whiten(table, components=3).collect()
    n, deviation, z, _ = plain(rows, 3, 3)
    assert len(found) == 15
    for row in found:
        assert row["deviation"] == deviation[row["vec_id"] - 1]
        assert abs(row["whitened"]) == pytest.approx(
            abs(z[row["vec_id"] - 1, row["component"] - 1]), abs=1e-9
        )


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [])],
])
def test_without_variance_there_are_no_rows(spark, rows):
    table = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA)
    found = whitening.whiten(table)
    assert found.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]
    assert found.collect() == []


def test_huge_entries_null_ids_and_one_varying_dimension(spark):
    rows = [(None, [1e30, 0.0]), (None, [1e30, 0.0]), (2, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA)
    found = whitening.whiten(table).collect()
    assert [r["component"] for r in found] == [1, 1, 1]
    assert {r["deviation"] for r in found} == {None}
    assert sorted(round(abs(r["whitened"]), 9) for r in found) == [1, 1, 1]


def test_more_rows_than_a_block(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(size=3)]) for i in range(10_000)]
    table = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA).repartition(3)
    found = whitening.whiten(table).toPandas()
    assert len(found) == 30_000
    spread = found.groupby("component")["whitened"].agg(["mean", "std"])
    assert (spread["mean"].abs() < 1e-9).all() and ((spread["std"] - 1).abs() < 1e-3).all()
