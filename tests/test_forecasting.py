"""ARIMA, moving averages and unit roots against published values and plain least squares."""

import math

import numpy as np
import pytest

from sigmaloom.operators import forecasting, inference, interval_life
from sigmaloom.plans import ordered

SERIES = [100.0, 101.2, 100.8, 102.1, 103.0, 102.7, 104.2, 105.1, 104.8, 106.0, 107.2, 106.8, 108.1, 109.0, 108.7, 110.2]


@pytest.fixture(scope="module")
def trend(spark):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(SERIES)] + [("b", i, 2 * v) for i, v in enumerate(SERIES)], "s string, i int, y double").repartition(3)


def test_arima_orders_and_forecasts(trend):
    got = {(r.s, r.p): r for r in forecasting.arima(trend, "y", "i", ["s"]).collect()}
    best = got["a", 2]
    assert math.isclose(best.sse, 0.1882799988081431, rel_tol=1e-8) and math.isclose(best.aicc, -9.492999011144436, rel_tol=1e-7) and math.isclose(best.bic, -10.464817605426491, rel_tol=1e-7)
    assert np.allclose(best.forecast, [110.9334302054006, 110.70566799522649, 112.22392691574473, 112.86789308338795], rtol=1e-8)
    assert np.allclose(best.lower, [110.69755705465055, 110.3720929864361, 111.81538263450429, 112.39614678188785], rtol=1e-7)
    assert math.isclose(got["a", 1].aic, 30.072445756574595, rel_tol=1e-7) and math.isclose(got["a", 0].aicc, 38.662292132607114, rel_tol=1e-8)
    assert math.isclose(got["a", 3].sse, 0.1784371486390179, rel_tol=1e-7) and np.allclose(got["b", 2].forecast, 2 * np.array(best.forecast))
    levels = {r.p: r for r in forecasting.arima(trend.where("s = 'a'"), "y", "i", [], d=0).collect()}
    assert math.isclose(levels[3].sse, 0.1880383291454111, rel_tol=1e-5) and math.isclose(levels[1].bic, 38.945446677805485, rel_tol=1e-7)


def test_unit_root_equals_plain_regression(trend):
    for regression in ("none", "drift", "trend"):
        r = next(x for x in forecasting.augmented_dickey_fuller(trend, "y", "i", ["s"], regression=regression).collect() if x.s == "a")
        y, lags = np.array(SERIES), 2  # the whole part of the cube root of 15
        rows = [[*([1.0] if regression != "none" else []), *([float(t)] if regression == "trend" else []), y[t - 1], *[y[t - k] - y[t - k - 1] for k in range(1, lags + 1)]] for t in range(lags + 1, len(y))]
        x, d = np.array(rows), np.diff(y)[lags:]
        b, *_ = np.linalg.lstsq(x, d, rcond=None)
        at = {"none": 0, "drift": 1, "trend": 2}[regression]
        s2 = ((d - x @ b) ** 2).sum() / (len(d) - x.shape[1])
        assert (r.lags, r.n) == (lags, len(d)) and math.isclose(r.coefficient, b[at], rel_tol=1e-5)
        assert math.isclose(r.statistic, b[at] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[at, at]), rel_tol=1e-5)


def test_moving_average_model_finds_its_coefficient(spark):
    rng = np.random.default_rng(3)
    e = rng.standard_normal(3001)
    y = 5 + e[1:] + 0.6 * e[:-1]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double").repartition(4)
    r = forecasting.moving_average_model(df, "y", "i", []).first()
    grid = np.linspace(0.4, 0.8, 801)
    sse = []
    for theta in grid:
        last = total = 0.0
        for v in (y - y.mean()).tolist():
            last = v - theta * last
            total += last * last
        sse.append(total)
    assert abs(r.theta - grid[int(np.argmin(sse))]) < 2e-3 and math.isclose(r.sse, min(sse), rel_tol=1e-5)


def test_running_sums_and_quantiles_of_many_parts(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 5 == 0 else str(k % 3), i, float(rng.integers(0, 50))) for i, k in enumerate(rng.integers(0, 100, 3000))]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(7)
    got = {r.i: r.total for r in ordered.running(df, ["g"], ["i"], {"total": ordered.F.col("v")}).collect()}
    for g in (None, "0", "1", "2"):
        total = 0.0
        for _, i, v in (r for r in rows if r[0] == g):
            total += v
            assert got[i] == total
    q = {r.g: r for r in ordered.quantiles(df, "v", ["g"], {"a": 0.1, "m": 0.5, "z": 1.0}).collect()}
    for g in q:
        values = [r[2] for r in rows if r[0] == g]
        assert np.allclose([q[g].a, q[g].m, q[g].z], np.quantile(values, [0.1, 0.5, 1.0]))


def test_letters_join_levels_that_do_not_differ(spark):
    means = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, mean double")
    pairs = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("a", "c", 0.01)], "first string, second string, p_value double")
    assert {r.g: r.letters for r in inference.grouping_letters(pairs, means, "g").collect()} == {"c": "A", "b": "A B", "a": "B"}


def test_interval_survival_of_exact_steps(spark):
    rows = [(0.0, 1.0)] * 4 + [(1.0, 2.0)] * 3 + [(2.0, None)] * 3
    got = {r.high: r.survival for r in interval_life.turnbull(spark.createDataFrame(rows, "low double, high double"), "low", "high").collect()}
    assert math.isclose(got[1.0], 0.6, abs_tol=1e-4) and math.isclose(got[2.0], 0.3, abs_tol=1e-4)
