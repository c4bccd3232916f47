"""The dip by linear programming over all modes, and the peak screen by plain lists."""

import math

import numpy as np
import pytest

from sigmaloom.operators import modality


def _least_distance(x):
    """Half the least band in which a unimodal function fits, over all modes, by bisection with a plain fit of slopes."""
    xs, c = np.unique(x, return_counts=True)
    u = np.cumsum(c) / len(x)
    a = u - c / len(x)

    def convex_fits(t, low, high):  # a convex function between low (from below) and high at the points
        hull = modality._hull(t, high)
        return bool(np.all(np.interp(t, t[hull], high[hull]) >= low - 1e-12))

    def fits(d):
        for m in range(len(xs)):
            # left of the mode up to its lower limit, right of it from its upper limit; it may jump up at the mode
            lo_l, hi_l = np.append(u[:m], a[m]) - d, a[: m + 1] + d
            lo_r, hi_r = u[m:] - d, np.append(u[m], a[m + 1 :]) + d
            t = xs[m:]
            left = lambda top: convex_fits(xs[: m + 1], lo_l, np.append(hi_l[:-1], min(hi_l[-1], top)))  # noqa: E731, B023
            right = lambda least: convex_fits(-t[::-1], -hi_r[::-1], -np.append(max(lo_r[0], least), lo_r[1:])[::-1])  # noqa: E731, B023
            if not left(2.0) or not right(-2.0):
                continue
            bottom, top = a[m] - d - 1e-12, 2.0  # the least value the left part can end with
            for _ in range(50):
                mid = (bottom + top) / 2
                bottom, top = (bottom, mid) if left(mid) else (mid, top)
            if right(top):
                return True
        return False

    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def _dip(x):
    xs, c = np.unique(x, return_counts=True)
    u = np.cumsum(c) / len(x)
    return modality.dip(xs, u - c / len(x), u)


@pytest.mark.parametrize("seed", range(12))
def test_dip_is_the_least_distance_to_a_unimodal_function(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 40))
    x = [rng.normal(size=n), np.concatenate([rng.normal(-2, 1, n), rng.normal(3, 1, n)]), rng.exponential(size=n), rng.random(n)][seed % 4]
    assert _dip(x) == pytest.approx(_least_distance(x), abs=1e-9)


def test_known_dips():
    assert _dip(np.arange(1.0, 11.0)) == pytest.approx(0.05)  # 1 / (2 n) for even spacing
    assert _dip(np.array([0.0] * 50 + [1.0] * 50)) == pytest.approx(0.25)  # two atoms


def test_dip_test_of_series_and_of_rank_buckets(spark):
    rng = np.random.default_rng(1)
    series = {"one": rng.normal(size=600), "two": np.concatenate([rng.normal(-4, 1, 300), rng.normal(4, 1, 300)]), None: np.round(rng.random(200), 2)}
    rows = [(g, float(v)) for g, xs in series.items() for v in xs] + [("few", 1.0)] * 3 + [("flat", 2.0)] * 9 + [("one", None), ("one", math.nan), ("one", math.inf)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in modality.dip_test(frame, "x", ["g"], replicates=99).collect()}
    for g, xs in series.items():
        assert (got[g]["n"], got[g]["dip"]) == (len(xs), pytest.approx(_dip(xs), abs=1e-12))
    assert got["two"]["p_value"] == 0.01 and got["one"]["p_value"] > 0.05
    assert (got["few"]["dip"], got["few"]["p_value"], got["flat"]["dip"], got["flat"]["p_value"]) == (0.0, None, 0.0, None)
    near = {r["g"]: r["dip"] for r in modality.dip_test(frame, "x", ["g"], buckets=100).collect()}
    assert all(abs(near[g] - got[g]["dip"]) <= 1 / 100 for g in series) and modality.dip_test(frame.limit(0), "x", ["g"]).count() == 0


def _screen(x):
    bins = int(min(max(math.ceil(math.sqrt(len(x))), 8), 40))
    c = [0] * bins
    for v in x:
        c[min(int((v - min(x)) / (max(x) - min(x)) * bins), bins - 1)] += 1
    at = [k for k in range(bins) if c[k] > 0 and ((0 < k < bins - 1 and c[k] >= c[k - 1] and c[k] >= c[k + 1] and c[k] > min(c[k - 1], c[k + 1])) or (k == 0 and c[0] > c[1]) or (k == bins - 1 and c[k] > c[k - 1]))]
    two = any(b >= a + 2 and min(c[a : b + 1]) * 5 <= min(c[a], c[b]) * 3 for a in at for b in at)
    return bins, len(at), "suspected" if two else "clear"


def test_screen_equals_plain_lists(spark):
    rng = np.random.default_rng(3)
    series = {"one": rng.normal(size=4000), "two": np.concatenate([rng.normal(-4, 1, 500), rng.normal(4, 1, 500)]), None: rng.exponential(size=40)}
    rows = [(g, float(v)) for g, xs in series.items() for v in xs] + [("few", float(k)) for k in range(29)] + [("flat", 1.0)] * 30 + [("one", None), ("two", math.nan)]
    got = {r["g"]: tuple(r)[1:] for r in modality.bimodality_screen(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", ["g"]).collect()}
    for g, xs in series.items():
        assert got[g] == (len(xs), *_screen(xs.tolist()))
    assert got["few"] == (29, None, 0, "insufficient_n") and got["flat"] == (30, None, 1, "clear")
