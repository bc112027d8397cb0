"""Embedding whitening against numpy on whole small tables."""

import math

import numpy as np
import pytest

from hearthline.llm import whitening


def reference(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, centred = len(x), x - x.sum(0) / len(x)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, ((n * x - x.sum(0)) ** 2).sum(1), centred @ u, e, np.trace(centred.T @ centred / n)


def table(spark, rows):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, 1, b"x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, block int, w binary, n double")


def check(spark, rows, good, most=32):
    n, deviation, scores, e, trace = reference([rows[i][1] for i in good], most)
    got = whitening.whiten(table(spark, rows), most).collect()
    k = min(most, scores.shape[1])
    assert len(got) == len(good) * k and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    for c in range(1, k + 1):
        want = {rows[i][0]: (int(deviation[j]), scores[j, c - 1] / math.sqrt(e[c - 1])) for j, i in enumerate(good)}
        assert {r["vec_id"]: r["deviation"] for r in by[c]} == {i: w[0] for i, w in want.items()}
        sign = np.sign(sum(r["whitened"] * want[r["vec_id"]][1] for r in by[c]))
        assert max(abs(r["whitened"] * sign - want[r["vec_id"]][1]) for r in by[c]) < 1e-7
        assert all(abs(r["explained"] - e[c - 1] / trace) <= 1e-9 and r["identity_error"] < 1e-9 for r in by[c])


@pytest.mark.parametrize("rows_a_block", [7, 1024])
def test_against_numpy(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(whitening, "ROWS", rows_a_block)
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(40, 40))
    rows = [(i, (rng.normal(size=40) @ mix).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [math.nan] + [0.0] * 39), (1002, [math.inf] + [0.0] * 39), (1003, [None] + [0.0] * 39), (1004, [1.0, 2.0])]
    check(spark, rows, range(300))


def test_a_vector_that_a_third_of_the_rows_hold(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist() if i % 3 else [5.0, -1.0, 0.25, 3.0]) for i in range(90)]
    check(spark, rows, range(90))


def test_the_sealed_example_of_the_queries_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, rows, range(len(rows)))


def test_components_without_variance(spark):
    rows = [(i, [float(i % 5), float(i % 5), 7.0]) for i in range(20)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert {r["explained"] for r in got if r["component"] > 1} == {0.0} and max(abs(r["explained"] - 1) for r in got if r["component"] == 1) < 1e-12
    assert all(r["identity_error"] < 1e-12 for r in got)


def test_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, []), (3, [math.nan])])).count() == 0
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in same) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(0, None, None, None)}


def test_sums_of_squares_beyond_a_long(spark):
    got = whitening.whiten(table(spark, [(1, [3e8, 1.0]), (2, [-3e8, 1.0]), (3, [1e30, 1.0])])).select("vec_id", "deviation", "n").distinct().collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: None} and {r["n"] for r in got} == {3}
    x, sums = np.array([[2_000_000, 5], [1_000_000, 7]]), np.array([3_000_000, 12], object)
    assert whitening._exact(x, 2, sums) == [1_000_000**2 + 4, 1_000_000**2 + 4]
    assert whitening._exact(x * 4_000, 2, sums * 4_000) == [None, None]
