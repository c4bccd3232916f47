"""Statistics of pairs and interval-censored survival against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.functions.special import normal_quantile
from sigmaloom.operators import interval_life, pairs


def _shift(x, y, confidence=0.95):
    d = np.sort(np.subtract.outer(x, y).ravel())
    n, m = len(x), len(y)
    _, c = np.unique(np.concatenate([x, y]), return_counts=True)
    ties, total = float((c.astype(float) ** 3 - c).sum()), n + m
    sigma = math.sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1))))
    low = max(0, math.floor(n * m / 2 - normal_quantile(1 - (1 - confidence) / 2) * sigma))
    return float(np.median(d)), float(d[low]), float(d[n * m - 1 - low])


@pytest.mark.parametrize("kind,listed", [("real", 2_000_000), ("real", 600), ("ties", 50), ("equal", 0)])
def test_shift_interval_equals_all_differences(spark, kind, listed):
    rng = np.random.default_rng(3)
    x, y = {"real": (rng.normal(1, 1, 80), rng.normal(0, 2, 61)), "ties": (rng.integers(0, 9, 90) * 0.1, rng.integers(2, 7, 70) * 0.1), "equal": (np.full(20, 5e5), np.full(9, 5e5))}[kind]
    rows = [(float(v), "a") for v in x] + [(float(v), "b") for v in y] + [(None, "a"), (math.nan, "b"), (math.inf, "a"), (3.0, None), (9.0, "c")]
    got = pairs.shift_interval(spark.createDataFrame(rows, "v double, g string"), "v", "g", "a", "b", listed=listed).first()
    assert (got["n1"], got["n2"]) == (len(x), len(y))
    assert [got["estimate"], got["low"], got["high"]] == pytest.approx(_shift(x, y), rel=1e-9, abs=1e-9)


def test_shift_of_an_empty_sample_has_no_row_and_tiny_ones_the_extremes(spark):
    frame = spark.createDataFrame([(1.0, "a"), (4.0, "b")], "v double, g string")
    assert pairs.shift_interval(frame, "v", "g", "a", "c").count() == 0
    assert tuple(pairs.shift_interval(frame, "v", "g", "a", "b").first()) == (1, 1, -3.0, -3.0, -3.0)


def _discordant(x, y, w):
    up = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))
    return int((np.outer(w, w) * (up < 0)).sum()) // 2


@pytest.mark.parametrize("n,top", [(0, 5), (1, 5), (200, 6), (200, 1000)])
def test_discordant_weights_in_memory(n, top):
    rng = np.random.default_rng(n + top)
    x, y, w = rng.integers(0, top, n), rng.integers(0, top, n), rng.integers(1, 4, n)
    assert pairs.discordant(x, y, w) == _discordant(x, y, w)
    assert pairs.discordant(x, y, w * 2**40) == _discordant(x, y, w) * 2**80


def _kendall(spark, x, y, size):
    rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, math.nan)]
    return pairs.kendall(spark.createDataFrame(rows, "x double, y double"), F.col("x"), F.col("y"), size).first()


@pytest.mark.parametrize("kind,size", [("real", 100_000), ("real", 10), ("hot", 10), ("ties", 3)])
def test_kendall_equals_all_pairs_on_any_grid(spark, kind, size):
    rng = np.random.default_rng(6)
    x = rng.normal(size=900)
    y = 0.5 * x + rng.normal(size=900)
    if kind == "hot":  # a third of the rows have one x, and others one y
        x[:300], y[200:500] = 0.1, -0.2
    if kind == "ties":
        x, y = np.round(x), np.round(2 * y)
    got = _kendall(spark, x, y, size)
    down, up = _discordant(x, y, np.ones(900, int)), _discordant(x, -y, np.ones(900, int))
    n0, tx, ty = 900 * 899 // 2, *((np.unique(v, return_counts=True)[1] ** 2).sum() // 2 - 450 for v in (x, y))
    assert (got["n"], got["concordant"], got["discordant"]) == (900, up, down)
    assert got["tau_b"] == pytest.approx((up - down) / math.sqrt((n0 - tx) * (n0 - ty)))
    if kind == "real":
        assert got["z"] == pytest.approx((up - down) / math.sqrt(900 * 899 * 1805 / 18)) and 0 < got["p_value"] < 1e-6


def test_kendall_variance_with_ties_is_that_of_shuffled_ranks(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 4, 60), rng.integers(0, 5, 60)
    w = np.ones(60, int)
    s = lambda b: _discordant(x, -b, w) - _discordant(x, b, w)
    got = _kendall(spark, x, y, 100)
    spread = np.std([s(rng.permutation(y)) for _ in range(2000)])
    assert s(y) / got["z"] == pytest.approx(spread, rel=0.06)
    assert _kendall(spark, np.ones(9), np.arange(9), 100)["tau_b"] is None and _kendall(spark, [], [], 100)["n"] == 0


def _cells(rows):
    """(innermost intervals, which rows cover which): a left end next to a right end in the sorted list."""
    rows = [(0.0 if a is None else a, math.inf if b is None else b) for a, b in rows]
    lefts, rights = sorted({(a, 0 if a == b else 2) for a, b in rows}), sorted({(b, 1) for _, b in rows})
    ends = sorted(lefts + rights)
    cells = [(l, r) for l, r in zip(ends, ends[1:]) if l[1] != 1 and r[1] == 1]
    held = np.array([[(a, 0 if a == b else 2) <= l and r <= (b, 1) for l, r in cells] for a, b in rows], float)
    return [(l[0], r[0]) for l, r in cells], held


def _turnbull(rows):
    """(innermost intervals, masses) by plain expectation steps."""
    cells, held = _cells(rows)
    p = np.full(len(cells), 1 / len(cells))
    for _ in range(100_000):
        share = held * p
        new = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        if np.abs(new - p).sum() < 1e-12:
            break
        p = new
    return cells, p


def _intervals(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for t in rng.weibull(1.5, n) * 10:
        a, b = sorted(np.round([max(0.0, t - rng.exponential(2)), t + rng.exponential(2)], 1))
        out.append([(a, b), (t.round(1), t.round(1)), (a, None), (None, b)][rng.choice(4, p=[0.6, 0.1, 0.2, 0.1])])
    return [(None if a is None else float(a), None if b is None else float(b)) for a, b in out]


@pytest.mark.parametrize("n,one_task", [(120, 2_000_000), (12, 0)])
def test_turnbull_equals_plain_steps(spark, n, one_task):
    rows = _intervals(n, n)
    odd = [(None, None), (5.0, 2.0), (math.nan, 3.0), (1.0, math.nan)]
    got = interval_life.turnbull(spark.createDataFrame(rows + odd, "a double, b double").repartition(6), "a", "b", **({} if one_task else {"one_task": 0, "rounds": 12, "tolerance": 0.02})).orderBy("low", "high").collect()
    cells, p = _turnbull(rows)
    assert [(r["low"], r["high"]) for r in got] == cells
    if one_task:
        assert [r["mass"] for r in got] == pytest.approx(p.tolist(), abs=1e-5) and got[0]["converged"]
        assert [r["survival"] for r in got] == pytest.approx(np.maximum(0, 1 - np.cumsum(p)).tolist(), abs=1e-4)
    else:
        assert [r["mass"] for r in got] == pytest.approx(p.tolist(), abs=0.05)


def test_a_thousand_ends_are_all_kept(spark):
    rng = np.random.default_rng(2)
    rows = [(float(t), float(t) + float(w)) for t, w in zip(rng.permutation(1000) * 1.0, rng.integers(1, 6, 1000) + 0.5, strict=True)]
    got = interval_life.turnbull(spark.createDataFrame(rows, "a double, b double"), "a", "b").orderBy("low", "high").collect()
    cells, held = _cells(rows)
    assert [(r["low"], r["high"]) for r in got] == cells and len(cells) > 200 and got[0]["converged"]
    p = np.array([r["mass"] for r in got])
    slope = (held / (held @ p)[:, None]).mean(axis=0)  # of the likelihood: 1 where there is mass, no more anywhere
    assert p.sum() == pytest.approx(1) and slope.max() < 1 + 1e-3 and np.abs(slope[p > 1e-4] - 1).max() < 1e-3
    assert [r["survival"] for r in got] == pytest.approx(np.maximum(0, 1 - np.cumsum(p)).tolist(), abs=1e-9)


def test_exact_times_are_their_own_cells_and_none_gives_no_row(spark):
    got = interval_life.turnbull(spark.createDataFrame([(float(t), float(t)) for t in range(1, 10)], "a double, b double"), "a", "b").orderBy("low").collect()
    assert [r["low"] for r in got] == [r["high"] for r in got] == list(map(float, range(1, 10)))
    assert [r["mass"] for r in got] == pytest.approx([1 / 9] * 9) and next(r["low"] for r in got if r["survival"] <= 0.5) == 5.0
    assert interval_life.turnbull(spark.createDataFrame([], "a double, b double"), "a", "b").count() == 0
