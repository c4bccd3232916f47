"""Competing risks against sums over all rows for every failure."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions.special import chi2_right
from sigmaloom.operators import competing


def _made(n, seed, groups=3, effect=0.0, digits=1):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, groups, n)
    x = np.round(rng.normal(size=n), 1)
    t1, t2, c = rng.exponential(1 / np.exp(effect * x), n), rng.exponential(1.5, n), rng.exponential(2.0, n)
    t = np.round(np.minimum(np.minimum(t1, t2), c), digits)
    e = np.where(c <= np.minimum(t1, t2), 0, np.where(t1 <= t2, 1, 2))
    return t, e, g, x


def _frame(spark, t, e, g, x):
    rows = [(float(a), {0: None, 1: "a", 2: "b"}[int(b)], int(c), float(d), float(d) ** 2) for a, b, c, d in zip(t, e, g, x, strict=True)]
    return spark.createDataFrame([*rows, (None, "a", 1, 1.0, 1.0), (-1.0, "a", 1, 1.0, 1.0), (math.inf, "a", 1, 1.0, 1.0)], "t double, m string, g int, x double, y double").repartition(5)


def _fine_gray(t, e, x):
    """Newton steps with the whole risk set for every failure."""
    x = x - x.mean(axis=0)
    ahead = lambda s: np.prod([1 - np.sum((t == u) & (e == 0)) / np.sum(t >= u) for u in np.unique(t) if u < s])
    g = {u: ahead(u) for u in np.unique(t)}
    own = np.array([g[u] for u in t])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        score, info = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for i in np.flatnonzero(e == 1):
            w = np.where(t >= t[i], 1.0, np.where(e == 2, g[t[i]] / own, 0.0)) * np.exp(x @ beta)
            m = w @ x / w.sum()
            score += x[i] - m
            info += (x.T * w) @ x / w.sum() - np.outer(m, m)
        beta = beta + np.linalg.solve(info, score)
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def test_fine_gray_equals_whole_risk_sets(spark):
    t, e, g, x = _made(200, 1, effect=0.7)
    frame = _frame(spark, t, e, g, x)
    for columns, matrix in ((["x"], x[:, None]), (["x", "y"], np.column_stack([x, x**2]))):
        beta, se = _fine_gray(t, e, matrix)
        got = {r["term"]: r for r in competing.fine_gray(frame, "t", F.col("m"), "a", columns).collect()}
        for k, c in enumerate(columns):
            assert got[c]["coefficient"] == pytest.approx(beta[k], rel=1e-6) and got[c]["se"] == pytest.approx(se[k], rel=1e-6)
            assert got[c]["converged"] and (got[c]["n"], got[c]["events"], got[c]["competing"]) == (200, int(sum(e == 1)), int(sum(e == 2)))
    assert competing.fine_gray(frame.limit(5), "t", F.col("m"), "a", ["x"]).count() == 0
    assert competing.fine_gray(frame.withColumn("x", F.lit(1.0)), "t", F.col("m"), "a", ["x"]).count() == 0
    assert competing.fine_gray(frame, "t", F.col("m"), "no such mode", ["x"]).count() == 0


def _gray(t, e, g):
    """(scores, covariance) by the definitions, one time after the other."""
    groups, times = np.unique(g), np.unique(t)
    k = len(groups)
    s, f, pooled = np.ones(k), np.zeros(k), 1.0
    path = []
    for u in times:
        y = np.array([np.sum((t >= u) & (g == h)) for h in groups], float)
        d1, d2 = (np.array([np.sum((t == u) & (g == h) & (e == c)) for h in groups], float) for c in (1, 2))
        r = np.array([y[i] * (1 - f[i]) / s[i] if y[i] and s[i] else 0.0 for i in range(k)])
        hazard = d1.sum() / r.sum() if r.sum() else 0.0
        after = f + np.array([s[i] * d1[i] / y[i] if y[i] else 0.0 for i in range(k)])
        spread = np.array([[r[i] * ((i == j) - (r[j] / r.sum() if r.sum() else 0.0)) for j in range(k)] for i in range(k)])
        path.append((y, d1, d2, r, hazard, s.copy(), after, spread, pooled))
        s = s * np.array([1 - (d1[i] + d2[i]) / y[i] if y[i] else 1.0 for i in range(k)])
        f, pooled = after, pooled * (1 - hazard)
    score, cov = np.zeros(k), np.zeros((k, k))
    for a, (y, d1, d2, r, hazard, s, after, spread, _) in enumerate(path):
        score += d1 - r * hazard
        later = sum((p[7] * p[4] / p[8] for p in path[a + 1 :]), np.zeros((k, k)))
        for j in range(k):
            if y[j]:
                a1 = spread[:, j] * (y[j] / r[j] if r[j] else 0.0) + later[:, j] * (s[j] - (1 - after[j]))
                a2 = -later[:, j] * (1 - after[j])
                cov += (np.outer(a1, a1) * d1[j] + np.outer(a2, a2) * d2[j]) / y[j] ** 2
    return score, cov


@pytest.mark.parametrize("rows", [20_000, 9])
def test_gray_equals_the_definitions_in_any_parts(spark, rows):
    t, e, g, x = _made(200, 2)
    score, cov = _gray(t, e, g)
    got = competing.gray_test(_frame(spark, t, e, g, x), "t", F.col("m"), "a", "g", rows).orderBy("g").collect()
    chi = float(score @ np.linalg.pinv(cov) @ score)
    assert [r["observed"] - r["expected"] for r in got] == pytest.approx(score.tolist(), abs=1e-8) and [r["n"] for r in got] == [int(np.sum(g == k)) for k in range(3)]
    assert got[0]["chi_square"] == pytest.approx(chi, rel=1e-6) and got[0]["df"] == 2 and got[0]["p_value"] == pytest.approx(chi2_right(chi, 2), rel=1e-6)
    one = competing.gray_test(_frame(spark, t, e, g * 0, x), "t", F.col("m"), "a", "g")
    assert one.count() == 0
    none = competing.gray_test(_frame(spark, t, e, g, x), "t", F.col("m"), "no such mode", "g").first()
    assert none["p_value"] is None and none["observed"] == 0


def test_gray_covariance_is_that_of_shuffled_groups():
    """Under shuffling of groups the scores' covariance is known by repetition; the formula must meet it."""
    t, e, g, _ = _made(240, 5, groups=2, digits=2)
    rng = np.random.default_rng(0)
    scores = np.array([_gray(t, e, rng.permutation(g))[0][0] for _ in range(120)])
    formula = np.mean([_gray(t, e, rng.permutation(g))[1][0, 0] for _ in range(5)])
    assert formula == pytest.approx(scores.var(), rel=0.35)
