"""Stepwise logistic regression against refits of every candidate model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions.special import chi2_right, normal_cdf
from sigmaloom.operators import regression


def _refit(x, y):
    x = np.column_stack([np.ones(len(y)), *x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (mu * (1 - mu))) @ x, x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ b))
    return b, np.linalg.inv((x.T * (mu * (1 - mu))) @ x), mu, float((y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum())


def test_steps_follow_score_tests_and_refits(spark):
    rng = np.random.default_rng(3)
    a, b, noise = rng.normal(5, 2, 900), rng.normal(size=900), rng.normal(size=900)
    c = a + rng.normal(size=900) * 0.5  # a stand-in for a that b makes useless
    y = (rng.random(900) < 1 / (1 + np.exp(-(0.8 * (a - 5) + 1.2 * b)))).astype(float)
    rows = [tuple(map(float, r)) for r in zip(y, a, b, c, noise)] + [(1.0, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    data = {"a": a, "b": b, "c": c, "noise": noise}
    frame = spark.createDataFrame(rows, "y double, a double, b double, c double, noise double").repartition(4)
    got = regression.logistic_stepwise(frame, F.col("y"), list(data), 0.05, 0.05).collect()
    held: list[str] = []
    for r in got:
        _, _, mu, _ = _refit([data[k] for k in held], y)
        w, base = mu * (1 - mu), np.column_stack([np.ones(900), *[data[k] for k in held]])
        ps = {}
        for k in data:
            if k not in held:
                own = data[k] - base @ np.linalg.solve((base.T * w) @ base, base.T @ (w * data[k]))
                ps[k] = chi2_right(float((own @ (y - mu)) ** 2 / (w @ own**2)), 1)
        if r["action"] == "enter":
            least = min(ps, key=ps.get)
            assert r["term"] == least and r["p_value"] == pytest.approx(ps[least], rel=1e-4, abs=1e-12)
            held.append(least)
        else:
            assert min(ps.values(), default=1.0) > 0.05
            coefficients, cov, _, _ = _refit([data[k] for k in held], y)
            assert r["p_value"] == pytest.approx(max(chi2_right(float(coefficients[j + 1] ** 2 / cov[j + 1, j + 1]), 1) for j in range(len(held))), rel=1e-4)
            held.remove(r["term"])
        assert r["log_likelihood"] == pytest.approx(_refit([data[k] for k in held], y)[3], rel=1e-8)
    assert {"b", "a"} <= set(held) and "noise" not in held
    assert regression.logistic_stepwise(frame.where("y = 1"), F.col("y"), ["a"]).count() == 0


@pytest.mark.parametrize("link", ["logit", "probit"])
def test_dose_response_is_the_maximum(spark, link):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(20, 60, 40), 1)
    n = rng.integers(5, 30, 40)
    y = rng.binomial(n, 1 / (1 + np.exp(-0.15 * (x - 40))))
    cdf = (lambda v: 1 / (1 + np.exp(-v))) if link == "logit" else np.vectorize(normal_cdf)
    like = lambda b: float((y * np.log(cdf(b[0] + b[1] * x)) + (n - y) * np.log(1 - cdf(b[0] + b[1] * x))).sum())
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(y, n, x, strict=True)] + [(3, 2, 1.0), (0, 0, 1.0), (None, 2, 1.0), (1, 2, None)]
    frame = spark.createDataFrame(rows, "y int, n int, x double").repartition(3)
    got = {r["term"]: r for r in regression.dose_response(frame, "y", "n", "x", link).collect()}
    b = np.array([got["constant"]["estimate"], got["stress"]["estimate"]])
    top = like(b)
    assert got["stress"]["log_likelihood"] == pytest.approx(top) and got["stress"]["rows"] == 40
    for d in ((0.02, 0), (-0.02, 0), (0, 0.0005), (0, -0.0005)):
        assert like(b + d) < top
    assert got["ld50"]["estimate"] == pytest.approx(-b[0] / b[1]) and abs(got["ld50"]["estimate"] - 40) < 4
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.nan_to_num(y * np.log(y / n)) + np.nan_to_num((n - y) * np.log(1 - y / n))
    assert got["stress"]["deviance"] == pytest.approx(2 * (own.sum() - top)) and got["stress"]["aic"] == pytest.approx(4 - 2 * top)
    if link == "logit":
        p = cdf(b[0] + b[1] * x)
        a = np.column_stack([np.ones(40), x])
        cov = np.linalg.inv((a.T * (n * p * (1 - p))) @ a)
        assert got["stress"]["se"] == pytest.approx(cov[1, 1] ** 0.5, rel=1e-6)
        half = -b[0] / b[1]
        assert got["ld50"]["se"] == pytest.approx(((cov[0, 0] + 2 * half * cov[0, 1] + half**2 * cov[1, 1]) / b[1] ** 2) ** 0.5, rel=1e-6)
    assert regression.dose_response(frame.limit(2), "y", "n", "x", link).count() == 0
