"""Whitening against a plain eigendecomposition of exact covariances."""

import math

import numpy as np
import pytest

from corvane.llm import whitening
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    kept = [(i, [math.floor(256.0 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit) - np.array(sums) / n
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = {}
    for i, v in kept:
        white[i] = (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), (np.array(v) - np.array(sums) / n) @ vectors[:, :4] / np.sqrt(values[:4]))
    return n, white, values / values.sum()


def check(ours, rows, components=4):
    n, white, explained = brute(rows)
    assert len(ours) == len(white) * components
    signs = {}
    for r in ours:
        deviation, y = white[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
        assert r["identity_error"] <= 1e-9
        if abs(y[k]) > 1e-6:
            sign = signs.setdefault(k, math.copysign(1, y[k] * r["whitened"]))
            assert r["whitened"] * sign == pytest.approx(y[k], rel=1e-7)


def test_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(whitening.whiten(table).collect(), rows)


def test_sharp_spectrum_ends_without_the_full_dimension(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) * [80, 40, 20, 10] @ np.linalg.qr(rng.normal(size=(40, 4)))[0].T
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    fit = whitening.lattice(spark.createDataFrame(rows, SCHEMA)).select("x").distinct()
    model = whitening.Components(fit, fit.count(), 40)
    assert not model.full and model.passes <= 2 + whitening.PASSES + 1
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_flat_spectrum_expands(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(300, 32)))]
    fit = whitening.lattice(spark.createDataFrame(rows, SCHEMA)).select("x").distinct()
    assert whitening.Components(fit, 300, 32).full
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(30, 3)))]
    good += [(40, good[0][1]), (40, good[0][1]), (41, [-0.0, 0.0, 0.001])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [1.0, float("inf"), 2.0]), (54, []), (55, [1.0])]
    table = spark.createDataFrame([(*r, 9.0) for r in good + bad], SCHEMA + ", whitened double")
    ours = whitening.whiten(table).collect()
    assert {r["vec_id"] for r in ours} == {i for i, _ in good} and len(ours) == 3 * len(good)
    check([r for r in ours if r["vec_id"] != 40] + [r for r in ours if r["vec_id"] == 40][:3], good, 3)
    assert whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 5.0])], SCHEMA)).count() == 2  # one component has variance
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_deviation_beyond_a_long_is_null():
    x = np.array([[2**40, 0], [3, 4]])
    assert whitening.deviations(x, 2, [2**40 + 3, 4]) == [None, None]
    assert whitening.deviations(np.array([[2**31, 0], [3, 4]]), 1, [0, 0]) == [2**62, 25]
