"""Johnson curves against a plain search over sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions.special import normal_cdf, normal_quantile
from sigmaloom.operators import johnson


def _plain(values):
    x = np.sort(np.array(values))
    best, n = None, len(x)
    for z in johnson.TRIED:
        if z > normal_quantile((n - 0.5) / n) / 3:
            break
        c = johnson.curve(z, tuple(np.quantile(x, normal_cdf(f * z)) for f in (-3, -1, 1, 3)))
        if not c:
            continue
        y = johnson.transformed(x, c)
        y = y[~np.isnan(y)]
        if len(y) < round(0.95 * n):
            continue
        u = (y - y.mean()) / y.std(ddof=1)
        m = len(u)
        a2 = -m - sum((2 * i + 1) * (math.log(normal_cdf(u[i])) + math.log(1 - normal_cdf(u[m - 1 - i]))) for i in range(m)) / m
        a, p = johnson.normal_p(a2, m)
        if best is None or p > best["p"]:
            best = {"p": p, "a": a, "mean": y.mean(), "stdev": y.std(ddof=1), **c}
    return best


def _samples():
    rng = np.random.default_rng(1)
    mild = [math.exp(0.05 * i) + 0.1 * (i % 3) for i in range(1, 41)]
    return {"mild": mild, "SB": (1 / (1 + np.exp(-(rng.normal(size=300) - 0.5) / 1.2))).tolist(), "SU": np.sinh(rng.normal(size=400) / 1.1).tolist(), "tied": np.round(rng.lognormal(size=200), 1).tolist(), None: rng.normal(size=60).tolist()}


@pytest.mark.parametrize("rows", [50_000, 37])
def test_fits_equal_a_plain_search(spark, rows, monkeypatch):
    from sigmaloom.plans import ordered

    blocks = ordered.value_blocks
    monkeypatch.setattr(johnson, "value_blocks", lambda df, value, by: blocks(df, value, by, rows))
    data = [(g, float(v)) for g, xs in _samples().items() for v in xs]
    odd = [("few", 1.0 * k) for k in range(5)] + [("flat", 2.0)] * 30 + [("SU", None), ("SU", math.nan), ("SU", math.inf)]
    got = {r["g"]: r for r in johnson.fit(spark.createDataFrame(data + odd, "g string, x double").repartition(4), "x", ["g"]).collect()}
    assert set(got) == {*_samples(), "few", "flat"} and not got["few"]["found"] and got["flat"]["family"] is None
    for g, xs in _samples().items():
        want = _plain(xs)
        assert (got[g]["family"], got[g]["z"]) == (want["family"], want["z"]), g
        for mine, theirs in (("gamma", "gamma"), ("eta", "eta"), ("lambda", "lambda"), ("epsilon", "epsilon"), ("mean", "mean"), ("stdev", "stdev"), ("a2", "a"), ("p_value", "p")):
            assert got[g][mine] == pytest.approx(want[theirs], rel=1e-6, abs=1e-9), (g, mine)
        assert got[g]["found"] == (want["p"] > 0.1) and got[g]["n"] == len(xs)


@pytest.mark.parametrize("family,z", [("SU", 0.5), ("SB", 0.4), ("SL", 0.5)])
def test_a_curve_through_its_own_quantiles_is_found_again(family, z):
    true = {"family": family, "gamma": 0.3, "eta": 1.4, "lambda": 2.0 if family != "SL" else 1.0, "epsilon": -1.0}
    inner = lambda u: (u - true["gamma"]) / true["eta"]
    back = {"SU": lambda u: -1 + 2 * math.sinh(inner(u)), "SB": lambda u: -1 + 2 / (1 + math.exp(-inner(u))), "SL": lambda u: -1 + math.exp(inner(u))}[family]
    got = johnson.curve(z, tuple(back(f * z) for f in (-3, -1, 1, 3)))
    assert got["family"] == family and all(got[k] == pytest.approx(true[k], rel=1e-8) for k in ("gamma", "eta", "lambda", "epsilon"))


def test_values_come_back_and_limits_outside_the_support_count_as_none(spark):
    xs = _samples()["mild"]
    df = spark.createDataFrame([(v,) for v in xs], "x double")
    fits = johnson.fit(df, "x")
    one = johnson.apply(df, "x", fits).crossJoin(fits.select(F.struct("family", "gamma", "eta", "lambda", "epsilon").alias("f")))
    assert one.where(F.abs(johnson.inverse_column(F.col("johnson"), F.col("f")) - F.col("x")) > 1e-5).count() == 0 and one.where("johnson is null").count() == 0
    want = _plain(xs)
    got = johnson.capability(df, "x", xs[0], xs[-1] * 1.2).first()
    low, high = johnson.transformed(np.array([xs[0], xs[-1] * 1.2]), want)
    assert got["family"] == want["family"] and got["ppl"] == pytest.approx((want["mean"] - low) / 3 / want["stdev"])
    if not math.isnan(high):
        assert got["pp"] == pytest.approx((high - low) / 6 / want["stdev"]) and got["ppk"] == pytest.approx(min(got["ppl"], got["ppu"]))
    if want["family"] != "SU":
        out = johnson.capability(df, "x", -1000.0, None).first()
        assert out["reason"] == "limits outside the support" and out["pp"] is None and out["ppk"] is None
