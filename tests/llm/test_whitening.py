from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from haplospark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], schema)


def brute(vectors, components=16):
    """Exact covariances by rational numbers."""
    x = [[floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = [list(t) for t in {tuple(r) for r in x}]
    n, k = len(fit), len(fit[0])
    s = [sum(r[i] for r in fit) for i in range(k)]
    cov = np.array([[float(sum((r[i] - Fraction(s[i], n)) * (r[j] - Fraction(s[j], n)) for r in fit) / n) for j in range(k)] for i in range(k)])
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    centred = np.array([[float(c - Fraction(t, n)) for c, t in zip(r, s)] for r in x])
    return n, [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x], centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov)


@pytest.mark.parametrize("k, n, scale", [(5, 60, 0.2), (20, 90, 1.0), (3, 40, 1e9), (2, 9, 1e15)])
def test_equals_rational_numbers(spark, k, n, scale):
    rng = np.random.default_rng(k)
    v = (rng.standard_normal((n, k)) * scale * (1 + np.arange(k))).tolist()
    v += v[:7] * 3
    out = whitening.whiten(table(spark, v)).toPandas().sort_values(["vec_id", "component"])
    fit, deviation, white, explained = brute(v)
    c = min(k, 16)
    assert len(out) == len(v) * c and set(out["n"]) == {fit}
    for i, d in enumerate(deviation):
        got = out[out["vec_id"] == i]["deviation"]
        assert (got == d).all() if d < 2**63 else got.isna().all()
    got = out["whitened"].to_numpy().reshape(len(v), c)
    sign = np.sign((got * white).sum(0))
    assert np.allclose(got * sign, white, rtol=1e-9, atol=1e-9)
    assert np.allclose(out["explained"].to_numpy().reshape(len(v), c), explained, rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


def test_large_sums_stay_exact():
    rng = np.random.default_rng(1)
    for top in (50, 2**33, 2**60):
        d = rng.integers(-top, top, (40, 4))
        got = iter(whitening.pair_squares(d))
        for i in range(4):
            for j in range(i, 4):
                assert next(got) == sum((int(r[i]) if i == j else int(r[i]) + int(r[j])) ** 2 for r in d)


def test_polarisation_recovers_covariances():
    rng = np.random.default_rng(2)
    d = rng.integers(-40, 40, (1000, 6)) @ rng.integers(-2, 3, (6, 6))
    got = whitening.covariance(len(d), d.sum(0).tolist(), whitening.pair_squares(d))
    assert np.allclose(got, np.cov(d.T, bias=True), rtol=1e-12)


def test_what_is_left_out(spark):
    good = [[0.1, 0.5], [0.4, -0.2], [-0.3, 0.3]]
    odd = [None, [], [0.1], [None, 1.0], [nan, 1.0], [inf, 1.0], [1e300, 1.0]]
    df = table(spark, good + odd + good).selectExpr("vec_id", "embedding", "1 AS x", "2 AS component", "'a' AS v")
    assert {r.vec_id for r in whitening.whiten(df).collect()} == {0, 1, 2, 10, 11, 12}
    nulls = spark.createDataFrame([(None, v, 0) for v in good + good[:1]], SCHEMA)
    assert [r.vec_id for r in whitening.whiten(nulls).collect()] == [None] * 8


def test_without_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [None, None])).collect() == []
    assert whitening.whiten(table(spark, [[0.5, 0.5]] * 4)).collect() == []
    out = whitening.whiten(table(spark, [[0.1, 7.0, 0.2], [0.5, 7.0, 0.6], [0.9, 7.0, -0.3], [0.2, 7.0, 0.9]])).toPandas()
    assert set(out["component"]) == {1, 2} and out["identity_error"].max() < 1e-9
