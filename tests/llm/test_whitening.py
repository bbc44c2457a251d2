"""Whitening: exact sums against Python integers, components against a dense fit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import whitening


def by_hand(rows, size):
    """Integers of the usable rows of one length, and the covariance of the distinct ones."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in good]
    fit = np.array(sorted({v for _, v in x}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = n * fit - total
    return x, n, total, np.array(centred.T.dot(centred), float) / n**3


@pytest.mark.parametrize("size, many, spread", [(3, 40, 1.0), (20, 300, 1.0), (5, 200, 1e6)])
def test_whitening_matches_a_dense_fit(spark, size, many, spread):
    rng = np.random.default_rng(size)
    mixed = rng.normal(size=(size, size))
    rows = [(k, (rng.normal(size=size) @ mixed * spread).astype(np.float32).tolist()) for k in range(many)]
    rows += [rows[0]] * 5 + [(None, rows[1][1]), (900, None), (901, []), (902, [float("nan")] * size), (903, [None] * size), (904, [float("-inf")] + [0.0] * (size - 1))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    got = whitening.whiten(frame).collect()
    x, n, total, covariance = by_hand(rows, size)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    most = min(16, size)
    assert len(got) == len(x) * most
    deviations = {i: sum(int(n * c - s) ** 2 for c, s in zip(v, total)) for i, v in x}
    whitened = {i: np.array([float(n * c - s) / n for c, s in zip(v, total)]) @ axes[:, :most] / np.sqrt(values[:most]) for i, v in x}
    signs = {}
    for r in got:
        k = r["component"] - 1
        assert r["n"] == n and int(r["deviation"]) == deviations[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
        assert r["identity_error"] < 1e-9
        want = whitened[r["vec_id"]][k]
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-6, abs=1e-7)
        if abs(want) > 1e-3:
            assert signs.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])


@pytest.mark.parametrize("top", [0, 1, 300, (1 << 33) - 1])
def test_bit_planes_give_exact_products(top):
    rng = np.random.default_rng(1)
    values = rng.integers(0, top + 1, size=(whitening.CHUNK + 77, 5))
    values[:, 3] = 0
    found = whitening.BitScatter(5, int(top).bit_length())
    for part in np.array_split(values, 7):
        found.add(part)
    exact = values.astype(object)
    sums, products = [0] * 5, np.zeros((5, 5), object)
    for batch in found.batches():
        for limb, i, j, value in zip(*(c.to_pylist() for c in batch.columns)):
            if i < 0:
                assert value == len(values)
            elif j < 0:
                sums[i] += value << (24 * limb)
            else:
                products[i, j] += value << (24 * limb)
    assert sums == exact.sum(axis=0).tolist()
    assert (products == np.triu(exact.T.dot(exact))).all()


def test_squares_are_exact_at_every_size():
    for top in (10, 1 << 31, 1 << 45, (1 << 60) - 1, 1 << 70):
        rows = [[top, -top + 1, 3, 0], [-top, -5, top // 3, 1]]
        values = np.array(rows, object if top > 1 << 62 else np.int64)
        assert whitening.squares(values) == [sum(v * v for v in r) for r in rows]


def test_directions_without_variance_are_null(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["explained"] == pytest.approx(float(r["component"] == 1)) for r in line)


def test_each_length_and_doubles_are_whitened_by_themselves(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=2 + k % 2).tolist()) for k in range(80)] + [(99, [1e300, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>"))
    assert {(r["n"], r["component"]): r["count"] for r in found.groupBy("n", "component").count().collect()} == {(40, 1): 80, (40, 2): 80, (40, 3): 40}
    assert found.filter("identity_error > 1e-9 or vec_id = 99").count() == 0
