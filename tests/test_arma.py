"""Seasonal ARIMA against plain recursions, and unit-root tests with many lags."""

import math

import numpy as np
import pytest

from sigmaloom.operators import arma


def _plain(y, model, values, s, d, sd, mean):
    """Sum of squares by the recursion, one value after the other."""
    w = np.asarray(y, float)
    for _ in range(sd):
        w = w[s:] - w[:-s]
    w = np.diff(w, d) - mean
    (ar, sar), (ma, sma) = arma.polynomials(model, values, s)
    ar, ma = np.convolve(ar, sar), np.convolve(ma, sma)
    lag = max(len(ar), len(ma)) - 1
    e = np.zeros(len(w))
    for t in range(lag, len(w)):
        e[t] = sum(ar[k] * w[t - k] for k in range(len(ar))) - sum(ma[k] * e[t - k] for k in range(1, len(ma)))
    return float(e @ e)


def _series(n, seed, s=4):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 50)
    w = np.zeros(n + 50)
    for t in range(s + 1, n + 50):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.4 * e[t - 1] + 0.5 * e[t - s] + 0.2 * e[t - s - 1]
    return (w[50:] + 3).tolist()


MODELS = [(1, 1, 0, 0), (1, 1, 0, 1), (2, 0, 1, 0), (0, 2, 1, 1), (0, 0, 0, 0)]


@pytest.mark.parametrize("d,sd,rows", [(0, 0, 100_000), (0, 0, 150), (1, 1, 211)])
def test_fits_are_least_squares_of_the_plain_recursion(spark, d, sd, rows):
    series = {"a": _series(700, 1), None: _series(400, 2), "short": [1.0] * 5, "flat": [2.0] * 50}
    data = [(g, k, y) for g, ys in series.items() for k, y in enumerate(ys)] + [("a", -1, None)]
    frame = spark.createDataFrame(data, "g string, t int, y double").repartition(5)
    got = arma.seasonal_arima(frame, "y", "t", ["g"], MODELS, d, sd, 4, 6, rows=rows).collect()
    assert {(r["g"]) for r in got} == {"a", None} and len(got) == 2 * len(MODELS)
    for r in got:
        y, model, c = series[r["g"]], (r["p"], r["q"], r["sp"], r["sq"]), np.array(r["coefficients"])
        best = _plain(y, model, c, 4, d, sd, r["mean"])
        assert r["sse"] == pytest.approx(best, rel=1e-9)
        assert arma.admissible(model, c)
        for k in range(len(c)):
            for step in (-0.003, 0.003):
                near = c.copy()
                near[k] += step
                assert not arma.admissible(model, near) or _plain(y, model, near, 4, d, sd, r["mean"]) > best - 1e-6
        m = len(c) + 1
        assert r["aic"] == pytest.approx(r["n"] * (math.log(2 * math.pi) + 1 + math.log(best / r["n"])) + 2 * m)
        assert all(a < b < c for a, b, c in zip(r["lower"], r["forecast"], r["upper"], strict=True))


def test_coefficients_and_forecasts_of_a_known_process(spark):
    y = _series(4000, 3)
    frame = spark.createDataFrame(list(enumerate(y)), "t int, y double")
    got = arma.seasonal_arima(frame, "y", "t", [], [(1, 1, 0, 1)], 0, 0, 4, 40, rows=900).first()
    assert np.allclose(got["coefficients"], [0.6, 0.4, 0.5], atol=0.05) and got["sse"] / got["n"] == pytest.approx(1, abs=0.06)
    assert got["forecast"][-1] == pytest.approx(got["mean"], abs=1e-3)
    widths = np.array(got["upper"]) - got["lower"]
    spread = math.sqrt(got["sse"] / got["n"]) * 2 * 1.959963984540054
    assert widths[0] == pytest.approx(spread) and np.all(np.diff(widths) > -1e-12) and widths[-1] < 2 * spread


def test_forecasts_of_seasonal_differences_repeat_the_season(spark):
    y = [10.0 * (t % 4) + 0.5 * t + (0.1 if t % 7 == 0 else 0.0) for t in range(80)]
    frame = spark.createDataFrame(list(enumerate(y)), "t int, y double")
    got = arma.seasonal_arima(frame, "y", "t", [], [(0, 0, 0, 0)], 0, 1, 4, 8).first()
    assert np.allclose(got["forecast"], [y[76 + k % 4] + (k // 4 + 1) * got["mean"] for k in range(8)])
    with pytest.raises(ValueError):
        arma.seasonal_arima(frame, "y", "t", [], [(0, 0, 1, 0)], 0, 0, 1)


def _dickey_fuller(y, lags, trend):
    step = np.diff(y)
    t = np.arange(lags, len(step))
    x = np.column_stack([np.ones(len(t)), *([t + 1.0] if trend else []), y[t], *(step[t - k] for k in range(1, lags + 1))])
    b, *_ = np.linalg.lstsq(x, step[t], rcond=None)
    r = step[t] - x @ b
    at = 2 if trend else 1
    return len(t), b[at], b[at] / math.sqrt(r @ r / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[at, at])


@pytest.mark.parametrize("lags,trend", [(None, False), (0, False), (125, False), (7, True)])
def test_dickey_fuller_with_many_lags(spark, lags, trend):
    from sigmaloom.operators import forecasting

    rng = np.random.default_rng(8)
    series = {"a": np.cumsum(rng.normal(size=1500)), "b": rng.normal(size=900)}
    rows = [(g, k, float(v)) for g, y in series.items() for k, v in enumerate(y)] + [("c", k, 1.0) for k in range(7)]
    frame = spark.createDataFrame(rows, "g string, t int, y double").repartition(3)
    got = {r["g"]: r for r in forecasting.augmented_dickey_fuller(frame, "y", "t", ["g"], lags, "trend" if trend else "drift").collect()}
    assert set(got) == {"a", "b"}
    for g, y in series.items():
        used = lags if lags is not None else int(np.cbrt(len(y) - 1) + 1e-9)
        n, b, t = _dickey_fuller(y, used, trend)
        assert (got[g]["lags"], got[g]["n"]) == (used, n)
        assert got[g]["coefficient"] == pytest.approx(b, rel=1e-6) and got[g]["statistic"] == pytest.approx(t, rel=1e-6)
