"""Threshold and accelerated lives: likelihoods by plain sums, maxima by probing around them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions.special import normal_cdf
from sigmaloom.operators import stressed_lives as lives


def _like(t, d, threshold, location, scale, family):
    y = np.log(t - threshold)
    z = (y - location) / scale
    if family == "weibull":
        return float(np.where(d, z - np.exp(z) - np.log(scale) - y, -np.exp(z)).sum())
    tail = np.array([math.log(normal_cdf(-v)) for v in z])
    return float(np.where(d, -z * z / 2 - 0.5 * math.log(2 * math.pi) - np.log(scale) - y, tail).sum())


@pytest.mark.parametrize("family", ["weibull", "lognormal"])
def test_threshold_is_at_the_top_of_the_likelihood(spark, family):
    rng = np.random.default_rng(2)
    t = np.round(50 + (20 * rng.weibull(2.2, 250) if family == "weibull" else np.exp(rng.normal(2.5, 0.5, 250))), 2)
    d = rng.random(250) < 0.85
    rows = [(float(a), bool(b)) for a, b in zip(t, d, strict=True)] + [(None, True), (-1.0, True), (3.0, None)]
    got = lives.threshold_life(spark.createDataFrame(rows, "t double, d boolean").repartition(3), "t", F.col("d"), family).first()
    where = np.array([got["threshold"], got["location"], got["scale"]])
    top = _like(t, d, *where, family)
    assert got["log_likelihood"] == pytest.approx(top, rel=1e-9) and (got["n"], got["failures"]) == (250, int(d.sum()))
    assert got["aic"] == pytest.approx(6 - 2 * top) and where[0] < t.min() and abs(where[0] - 50) < 5
    for k in range(3):
        for by in (0.98, 1.02):
            near = where.copy()
            near[k] *= by
            if near[0] < t.min():
                assert _like(t, d, *near, family) < top + 1e-3
    for r in rng.normal(size=(200, 3)):  # nor is anything around it higher
        near = where + r * [1.0, 0.05, 0.02]
        assert near[0] >= t.min() or near[2] <= 0 or _like(t, d, *near, family) < top + 1e-3


def test_two_parameter_exponential_and_lives_that_have_no_threshold(spark):
    rng = np.random.default_rng(3)
    t = 5 + rng.exponential(3, 80)
    frame = spark.createDataFrame([(float(a), k % 4 > 0) for k, a in enumerate(t)], "t double, d boolean")
    got = lives.threshold_life(frame, "t", F.col("d"), "exponential").first()
    mean = (t - t.min()).sum() / 60
    assert (got["threshold"], got["scale"]) == (pytest.approx(t.min()), pytest.approx(mean)) and got["log_likelihood"] == pytest.approx(-60 * math.log(mean) - 60)
    early = spark.createDataFrame([(float(a), True) for a in rng.weibull(0.5, 60)], "t double, d boolean")
    assert lives.threshold_life(early, "t", F.col("d")).first()["reason"].startswith("the likelihood")
    assert lives.threshold_life(frame.limit(2), "t", F.lit(True)).first()["reason"] == "too few failures"
    assert lives.threshold_life(frame.limit(0), "t", F.col("d")).first()["n"] == 0


def test_accelerated_life_is_the_maximum_and_gives_percentiles(spark):
    t = np.array([5000, 5200, 4800, 2000, 2100, 1900, 800, 850, 820, 900.0])
    c = np.array([40, 45, 42, 60, 62, 58, 80, 82, 79, 85.0])
    terms, at = lives.accelerated_life(spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, c, strict=True)], "t double, c double"), "t", F.lit(True), "c", [25.0, 80.0])
    got = {r["term"]: r for r in terms.collect()}
    b0, b1, shape = got["intercept"]["estimate"], got["stress"]["estimate"], got["intercept"]["shape"]
    x = lives.ARRHENIUS / (c + lives.ZERO)
    like = lambda i, s, k: float((math.log(k) + k * (np.log(t) - i - s * x) - np.log(t) - np.exp(k * (np.log(t) - i - s * x))).sum())
    top = like(b0, b1, shape)
    assert got["stress"]["log_likelihood"] == pytest.approx(top) and got["log_shape"]["estimate"] == pytest.approx(math.log(shape)) and b1 > 0
    for i, s, k in ((0.01, 0, 1), (-0.01, 0, 1), (0, 0.001, 1), (0, -0.001, 1), (0, 0, 1.02), (0, 0, 0.98)):
        assert like(b0 + i, b1 + s, shape * k) < top
    h = 1e-4  # the information by differences
    f = lambda v: like(v[0], v[1], math.exp(v[2]))
    v, e = np.array([b0, b1, math.log(shape)]), np.eye(3) * h
    info = -np.array([[(f(v + e[i] + e[j]) - f(v + e[i] - e[j]) - f(v - e[i] + e[j]) + f(v - e[i] - e[j])) / (4 * h * h) for j in range(3)] for i in range(3)])
    assert got["stress"]["se"] == pytest.approx(math.sqrt(np.linalg.inv(info)[1, 1]), rel=0.02)
    found = {(r["celsius"], r["percent"]): r["life"] for r in at.collect()}
    assert found[25.0, 50.0] == pytest.approx(math.exp(b0 + b1 * lives.ARRHENIUS / 298.16) * math.log(2) ** (1 / shape))
    assert found[25.0, 10.0] < found[25.0, 50.0] < found[25.0, 90.0] and found[80.0, 50.0] < 1000 < found[25.0, 50.0]
    one = spark.createDataFrame([(float(a), 40.0) for a in t], "t double, c double")
    assert lives.accelerated_life(one, "t", F.lit(True), "c", [25.0])[0].count() == 0


def test_lognormal_tails_are_taken_of_censored_times_alone_and_few_steps_are_made(spark, monkeypatch):
    z, asked = np.linspace(-6, 30, 400), []
    plain = lives._upper_tail
    monkeypatch.setattr(lives, "_upper_tail", lambda c: asked.append(len(c)) or plain(c))
    some, every = lives._terms(z, "lognormal", np.arange(0, 400, 4)), lives._terms(z, "lognormal", np.arange(400))
    assert asked == [100, 400]
    for a, b in zip(some, every, strict=True):
        assert np.array_equal(a[::4], b[::4])
    passes, sums = [], lives._sums
    monkeypatch.setattr(lives, "_sums", lambda blocks, family, tried, p: passes.append(len(tried)) or sums(blocks, family, tried, p))
    rng = np.random.default_rng(5)
    rows = [(float(50 + a), bool(b < 0.6)) for a, b in zip(np.exp(rng.normal(2.5, 0.5, 400)), rng.random(400), strict=True)]
    assert lives.threshold_life(spark.createDataFrame(rows, "t double, d boolean"), "t", F.col("d"), "lognormal").first()["reason"] is None
    refined = sum(k for k in passes if k <= 8)
    assert refined <= 3 * 8 * 5, "refined thresholds start from their neighbours' maxima"
