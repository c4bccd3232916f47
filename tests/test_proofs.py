"""Operators that SQL cannot say, against plain numpy over the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions.special import chi2_quantile, normal_cdf, normal_quantile
from sigmaloom.operators import inference, models, multivariate, regression, reliability, spc, survival_models, timeseries


def _made(n=240, seed=7):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    b = 0.6 * a + rng.normal(size=n)
    c = rng.exponential(size=n)
    g = np.where(a + 0.5 * c > 0.7, "p", np.where(b > 0.3, "q", "r"))
    y = 2 * a - c + rng.normal(size=n)
    return {"k": np.arange(n), "a": a, "b": b, "c": c, "g": g, "y": y}


@pytest.fixture(scope="module")
def frame(spark):
    d = _made()
    rows = [tuple(v.item() for v in r) for r in zip(*d.values(), strict=True)] + [(9000, None, 1.0, 1.0, "p", None)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, g string, y double").repartition(5)


def test_principal_components(frame):
    d = _made()
    x = np.column_stack([d[c] for c in "abc"])
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    got = multivariate.pca(frame, ["a", "b", "c"]).toPandas()
    assert np.allclose(got.groupby("component")["eigenvalue"].first(), values)
    loadings = got.pivot(index="variable", columns="component", values="loading").to_numpy()
    assert np.allclose(loadings @ loadings.T, np.corrcoef(x.T))
    scores = multivariate.pca_scores(frame, ["a", "b", "c"], 2).toPandas()
    assert np.allclose(np.cov(scores[["pc1", "pc2"]].T), np.diag(values[:2]), atol=1e-9) and len(scores) == 240
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(np.sort(scores["t2"]), np.sort(((z @ np.linalg.eigh(np.corrcoef(x.T))[1][:, ::-1][:, :2]) ** 2 / values[:2]).sum(axis=1)))


def test_linear_discriminants(frame):
    d = _made()
    x, g = np.column_stack([d[c] for c in "abc"]), d["g"]
    levels = sorted(set(g))
    pooled = sum((np.cov(x[g == v].T) * (np.sum(g == v) - 1) for v in levels)) / (len(g) - len(levels))
    inverse = np.linalg.inv(pooled)
    score = np.column_stack([x @ inverse @ m - m @ inverse @ m / 2 + math.log(np.mean(g == v)) for v in levels for m in [x[g == v].mean(axis=0)]])
    got = {r["k"]: r["predicted"] for r in multivariate.discriminant(frame.where("k < 9000"), ["a", "b", "c"], "g").collect()}
    assert [got[k] for k in range(240)] == [levels[j] for j in score.argmax(axis=1)]


def test_lloyds_steps(frame):
    d = _made()
    x = np.column_stack([d["a"], d["b"]])
    centres = x[:3].copy()
    for _ in range(50):
        near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == j].mean(axis=0) if np.any(near == j) else centres[j] for j in range(3)])
    rows, table = multivariate.kmeans(frame, ["a", "b"], "k", 3)
    got = {r["k"]: r["cluster"] for r in rows.collect()}
    assert [got[k] for k in range(240)] == near.tolist()
    assert np.allclose(table.toPandas().pivot(index="cluster", columns="variable", values="centre").to_numpy(), centres)


def test_best_subsets(frame):
    d = _made()
    got = {(r["size"], r["terms"]): r for r in regression.best_subsets(frame, "y", ["a", "b", "c"], 3).collect()}
    sst = ((d["y"] - d["y"].mean()) ** 2).sum()
    full = np.column_stack([np.ones(240), d["a"], d["b"], d["c"]])
    mse = ((d["y"] - full @ np.linalg.lstsq(full, d["y"], rcond=None)[0]) ** 2).sum() / 236
    for terms in ("a", "c", "a c", "a b c"):
        x = np.column_stack([np.ones(240), *[d[t] for t in terms.split()]])
        sse = ((d["y"] - x @ np.linalg.lstsq(x, d["y"], rcond=None)[0]) ** 2).sum()
        r = got[len(terms.split()), terms]
        assert r["r_squared"] == pytest.approx(1 - sse / sst) and r["cp"] == pytest.approx(sse / mse - (240 - 2 * x.shape[1]))


def _lives(seed=3, n=200):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n), 2)
    t, c = np.round(rng.exponential(np.exp(-0.7 * x)) + 0.1, 2), np.round(rng.exponential(2, n) + 0.1, 2)
    return np.minimum(t, c), t <= c, x


def test_cox_with_tied_times(spark):
    t, e, x = _lives()
    frame = spark.createDataFrame([(float(a), bool(b), float(c)) for a, b, c in zip(t, e, x, strict=True)], "t double, e boolean, x double").repartition(4)
    beta = 0.0
    for _ in range(30):
        w = np.exp(beta * x)
        score = info = 0.0
        for i in np.flatnonzero(e):
            risk = t >= t[i]
            m = (w * x)[risk].sum() / w[risk].sum()
            score += x[i] - m
            info += (w * x * x)[risk].sum() / w[risk].sum() - m * m
        beta += score / info
    got = survival_models.cox(frame, "t", F.col("e"), ["x"]).first()
    assert got["coefficient"] == pytest.approx(beta, rel=1e-6) and got["se"] == pytest.approx(info**-0.5, rel=1e-6)


def test_lognormal_life_and_comparison_are_at_the_top(spark):
    t, e, _ = _lives()
    frame = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(t, e, strict=True)], "t double, e boolean").repartition(4)

    def like(mu, s):
        z = (np.log(t) - mu) / s
        return float(np.where(e, -z * z / 2 - np.log(s) - np.log(t) - 0.5 * math.log(2 * math.pi), np.log([normal_cdf(-v) for v in z])).sum())

    got = survival_models.lognormal(frame, "t", F.col("e")).first()
    top = like(got["location"], got["scale"])
    assert all(like(got["location"] + a, got["scale"] + b) < top for a, b in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02)))
    three = {r["distribution"]: r for r in reliability.compare_lives(frame, "t", F.col("e")).collect()}
    assert three["lognormal"]["log_likelihood"] == pytest.approx(top) and three["lognormal"]["aic"] == pytest.approx(4 - 2 * top)
    rate = e.sum() / t.sum()
    assert three["exponential"]["log_likelihood"] == pytest.approx(e.sum() * math.log(rate) - rate * t.sum())
    w = reliability.weibull(frame, "t", F.col("e")).first()
    y = (t / w["scale"]) ** w["shape"]
    assert three["weibull"]["log_likelihood"] == pytest.approx(float((e * (math.log(w["shape"]) - math.log(w["scale"]) + (w["shape"] - 1) * np.log(t / w["scale"])) - y).sum()))


def test_normal_tolerance_and_bootstrap(frame):
    y = _made()["y"]
    got = inference.normal_tolerance(frame, "y").first()
    k = normal_quantile(0.975) * math.sqrt(239 * (1 + 1 / 240) / chi2_quantile(0.05, 239))
    assert got["low"] == pytest.approx(y.mean() - k * y.std(ddof=1), rel=1e-6) and got["high"] == pytest.approx(y.mean() + k * y.std(ddof=1), rel=1e-6)
    b = inference.bootstrap_mean(frame, "y", "k", 400).first()
    half = 1.96 * y.std(ddof=1) / math.sqrt(240)
    assert b["mean"] == pytest.approx(y.mean(), abs=half / 4) and b["high"] - b["low"] == pytest.approx(2 * half, rel=0.25)


def test_smoothing_with_trend_and_season(frame):
    y = _made()["y"]
    level, trend, want = y[0], y[1] - y[0], []
    for t, v in enumerate(y):
        want.append(level if t == 0 else level + trend)
        if t:
            new = 0.2 * v + 0.8 * (level + trend)
            trend, level = 0.2 * (new - level) + 0.8 * trend, new
    got = timeseries.double_smoothing(frame, "y", "k", []).orderBy("k").toPandas()
    assert np.allclose(got["fitted"], want) and np.allclose(got["residual"], y - want)
    level, trend, season, want = y[:4].mean(), (y[4:8].mean() - y[:4].mean()) / 4, list(y[:4] - y[:4].mean()), []
    for t, v in enumerate(y):
        s = season[t % 4]
        want.append(level + trend + s)
        new = 0.2 * (v - s) + 0.8 * (level + trend)
        trend, level = 0.2 * (new - level) + 0.8 * trend, new
        season[t % 4] = 0.2 * (v - level) + 0.8 * s
    assert np.allclose(timeseries.seasonal_smoothing(frame, "y", "k", [], 4).orderBy("k").toPandas()["fitted"], want)


def test_mewma(frame):
    d = _made()
    x = np.column_stack([d["a"], d["y"]])
    inverse, z, want = np.linalg.inv(np.cov(x.T)), np.zeros(2), []
    for t, v in enumerate(x - x.mean(axis=0), 1):
        z = 0.1 * v + 0.9 * z
        want.append(z @ inverse @ z / (0.1 * (1 - 0.9 ** (2 * t)) / 1.9))
    got = spc.mewma(frame, ["a", "y"], "k", []).orderBy("k").toPandas()
    assert np.allclose(got["statistic"], want) and np.allclose(got["upper"], chi2_quantile(1 - 0.0027, 2))


def test_weibull_capability(frame):
    x = _made()["c"] + 0.01
    got = models.weibull_capability(frame.where("k < 9000").withColumn("x", F.col("c") + 0.01), "x", 0.05, 4.0).first()
    fit = reliability.weibull(frame.where("k < 9000").withColumn("x", F.col("c") + 0.01), "x", F.lit(True)).first()
    low, high = (normal_quantile(1 - math.exp(-((v / fit["scale"]) ** fit["shape"]))) for v in (0.05, 4.0))
    assert got["n"] == len(x) and got["pp"] == pytest.approx((high - low) / 6) and got["ppk"] == pytest.approx(min(-low, high) / 3)
    assert got["ppm_above"] == pytest.approx(1e6 * math.exp(-((4.0 / fit["scale"]) ** fit["shape"])))
    one = models.weibull_capability(frame.where("k < 9000").withColumn("x", F.col("c") + 0.01), "x", None, 4.0).first()
    assert one["pp"] is None and one["ppl"] is None and one["ppk"] == pytest.approx(high / 3)
    assert models.weibull_capability(frame, "a", 0.1, 1.0).count() == 0
