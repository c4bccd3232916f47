"""Charts whose sums run on from block to block, against loops over the whole series."""

import numpy as np
import pytest

from sigmaloom.operators import rows, spc, timeseries


def _series(n=7300):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=n), 3)
    x[1990:2600] += 0.8  # a run over the end of the first block
    x[3990:4010] = 2.5
    return {"a": x, "b": x[:30], "c": x[:1]}


@pytest.fixture(scope="module")
def frame(spark):
    data = [(g, k * 2, float(v)) for g, xs in _series().items() for k, v in enumerate(xs)] + [("a", 1, None)]
    return spark.createDataFrame(data, "g string, t int, x double").repartition(5)


def test_cusum_goes_on_over_blocks(frame):
    got = {g: rows.sort_values("t") for g, rows in spc.cusum(frame, "x", "t", ["g"], 0.1, 1.0).toPandas().groupby("g")}
    for g, xs in _series().items():
        up = down = 0.0
        for v, a, b, out in zip(xs, *(got[g][c] for c in ("cusum_upper", "cusum_lower", "out")), strict=True):
            up, down = max(0.0, up + v - 0.1 - 0.5), min(0.0, down + v - 0.1 + 0.5)
            assert abs(a - up) < 1e-8 and abs(b - down) < 1e-8 and out == (a > 4 or b < -4)


def test_zone_scores_go_on_over_blocks(frame):
    got = {g: rows.sort_values("t") for g, rows in spc.zone(frame, "x", "t", ["g"]).toPandas().groupby("g")}
    for g, xs in _series().items():
        if len(xs) < 2:
            continue
        sigma, score, side = np.abs(np.diff(xs)).mean() / spc.d2(2), 0, 0.0
        assert np.allclose(got[g]["sigma"], sigma)
        for v, s, w in zip(xs, got[g]["score"], got[g]["weight"], strict=True):
            z = (v - xs.mean()) / sigma
            weight = 0 if abs(z) < 1 else 1 if abs(z) < 2 else 2 if abs(z) < 3 else 4
            score = weight if weight == 0 or np.sign(z) != side else score + weight
            side = np.sign(z)
            assert (w, s) == (weight, score)


def test_lags_and_runs_meet_over_blocks(frame):
    x = _series()["a"]
    c = x - x.mean()
    got = {r["lag"]: r["acf"] for r in timeseries.acf(frame.where("g = 'a'"), "x", "t", ["g"], 5).collect()}
    assert all(got[k] == pytest.approx(c[k:] @ c[:-k] / (c @ c)) for k in range(1, 6))
    up = x > np.median(x)
    assert spc.runs(frame.where("g = 'a'"), "x", "t", ["g"]).first()["runs"] == 1 + int((up[1:] != up[:-1]).sum())
    line = timeseries.trend(frame.where("g = 'a'"), "x", "t", ["g"]).first()
    slope, intercept = np.polyfit(np.arange(1, len(x) + 1), x, 1)
    assert (line["slope"], line["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))


def test_places_of_mixed_cells(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(["b", "10", "9", "A", None, "9"])], "k int, c string")
    got = [r["k"] for r in rows.sorted_places(df, "c", "k").orderBy("position").collect()]
    assert got[:3] == [2, 5, 1] and got.index(3) < got.index(0) and len(got) == 6
