"""Weibull and lognormal lives with a threshold or a stress: location and scale of log times, right-censored.

Rows are counted by distinct time, event and covariate, and the counts put into arrays of bounded length. A Newton
step passes over the arrays once for all thresholds that are tried; a task leaves a row of sums a threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_cdf, normal_quantile
from ..plans.ordered import running, written_rows

#: Thresholds tried below the least time, as parts of the range of times and of the least time.
OF_RANGE = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0, 1.5, 2.0)
OF_LEAST = tuple(1e-4 * k for k in range(1, 17))
#: Fixed value: an electronvolt over Boltzmann's constant in kelvin, and zero Celsius in kelvin, as the tables have them.
ARRHENIUS, ZERO = 11604.83, 273.16
FEWEST_FAILURES, FEWEST_ROWS = 3, 6


def _counts(df: DataFrame, time: str, event: Column, covariates: list[Column], rows: int = 20_000) -> DataFrame:
    """(_t, _n, _d, _x0 ..): arrays of distinct times and covariates with their rows and failures; times of 0 or less, nulls and nan are left out."""
    xs = [f"_x{i}" for i in range(len(covariates))]
    held = df.select(F.col(time).cast("double").alias("_t"), event.alias("_e"), *[c.cast("double").alias(x) for c, x in zip(covariates, xs, strict=True)]).dropna()
    held = held.where((F.col("_t") > 0) & (F.col("_t") < float("inf")))
    counts = held.groupBy("_t", *xs).agg(F.count("*").alias("_n"), F.count_if("_e").alias("_d"))
    placed = running(counts, [], ["_t", *xs], {"_i": F.lit(1)}).groupBy(F.floor((F.col("_i") - 1) / rows).alias("_part")).agg(F.collect_list(F.struct("_t", "_n", "_d", *xs)).alias("_v"))
    return written_rows(placed.select(*[F.col(f"_v.{c}").alias(c) for c in ("_t", "_n", "_d", *xs)]))


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """The upper tail of the normal distribution."""
    return np.fromiter(map(math.erfc, (z / math.sqrt(2)).tolist()), float, len(z)) / 2


def _hazard(z: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The normal density over the upper tail."""
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    far = z > 25
    return np.where(far, z + 1 / np.where(far, z, 1.0), density / np.maximum(tail, 1e-300))


def _terms(z: np.ndarray, family: str, censored: np.ndarray) -> tuple[np.ndarray, ...]:
    """(log-likelihood of a failure, of a survivor, their slopes in z, their curvatures in z).

    The lognormal's survivor terms, which cost most, are zero where no row is censored.
    """
    if family == "weibull":
        e = np.exp(np.minimum(z, 600.0))
        return z - e, -e, 1 - e, -e, -e, -e
    log_tail, slope, curve = (np.zeros(len(z)) for _ in range(3))
    c = z[censored]
    tail = _upper_tail(c)
    h = _hazard(c, tail)
    log_tail[censored] = np.where(c > 25, -c * c / 2 - np.log(np.maximum(c, 1.0)) - 0.5 * math.log(2 * math.pi), np.log(np.maximum(tail, 1e-300)))
    slope[censored], curve[censored] = -h, -h * (h - c)
    return -z * z / 2 - 0.5 * math.log(2 * math.pi), log_tail, -z, slope, np.full(len(z), -1.0), curve


def _sums(blocks: DataFrame, family: str, tried: list[tuple[float, np.ndarray]], p: int) -> np.ndarray:
    """For each (threshold, coefficients and log scale) the log-likelihood, its gradient and its Hessian, a row each."""
    size, shapes = p + 2, [(t, b.tolist()) for t, b in tried]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(shapes), 1 + size + size * size))
        for batch in batches:
            for row in batch.to_dict("records"):
                t, n, d = (np.asarray(row[c], float) for c in ("_t", "_n", "_d"))
                censored = np.flatnonzero(n > d)
                x = np.column_stack([np.ones(len(t)), *(np.asarray(row[f"_x{i}"]) for i in range(p))])
                for k, (threshold, b) in enumerate(shapes):
                    y, scale = np.log(t - threshold), math.exp(b[-1])
                    z = (y - x @ np.array(b[:-1])) / scale
                    dead, left, u1, u0, v1, v0 = _terms(z, family, censored)
                    like = d @ (dead - b[-1] - y) + (n - d) @ left
                    u, v = d * u1 + (n - d) * u0, d * v1 + (n - d) * v0
                    gradient = np.append(-(x.T @ u) / scale, -(u @ z) - d.sum())
                    hessian = np.zeros((size, size))
                    hessian[:-1, :-1] = (x.T * v) @ x / scale**2
                    hessian[:-1, -1] = hessian[-1, :-1] = x.T @ (v * z + u) / scale
                    hessian[-1, -1] = v @ (z * z) + u @ z
                    total[k] += np.concatenate([[like], gradient, hessian.ravel()])
        yield pd.DataFrame({"k": np.arange(len(shapes)), "s": list(total)})

    parts = blocks.mapInPandas(run, "k int, s array<double>")
    rows = parts.groupBy("k").agg(*[F.sum(F.col("s")[i]) for i in range(1 + size + size * size)]).orderBy("k").collect()  # a row a threshold
    return np.array([r[1:] for r in rows], float)


def _fit(blocks: DataFrame, family: str, thresholds: list[float], starts: list[np.ndarray], p: int, rounds: int = 60) -> list[dict]:
    """Newton steps from the starts, halved where they lose likelihood, for all thresholds side by side."""
    size = p + 2
    best = [{"threshold": t, "b": b, "like": -math.inf, "step": np.zeros(size), "done": False, "hessian": None} for t, b in zip(thresholds, starts, strict=True)]
    for _ in range(rounds):
        open_ = [f for f in best if not f["done"]]
        if not open_:
            break
        for f, s in zip(open_, _sums(blocks, family, [(f["threshold"], f["b"] + f["step"]) for f in open_], p), strict=True):
            like, gradient, hessian = s[0], s[1 : 1 + size], s[1 + size :].reshape(size, size)
            if not math.isfinite(like) or like < f["like"] - 1e-9 * abs(f["like"]):
                f["step"] = f["step"] / 2
                f["done"] = float(np.abs(f["step"]).max()) < 1e-9
                continue
            gain = like - f["like"]
            f["b"], f["like"], f["hessian"] = f["b"] + f["step"], like, hessian
            values, vectors = np.linalg.eigh(-hessian)
            step = vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-9))  # uphill even where the surface is not concave
            f["step"] = step / max(1.0, float(np.abs(step).max()) / 2)
            f["done"] = float(np.abs(f["step"]).max()) < 1e-10 or gain < 1e-11 * abs(like)
    return best


def _facts(df: DataFrame) -> tuple:
    flat = df.select(F.explode(F.arrays_zip("_t", "_n", "_d")).alias("r")).select("r.*")
    l_, n, d = F.log("_t"), F.col("_n"), F.col("_d")
    return flat.agg(F.sum(n), F.sum(d), F.min("_t"), F.max("_t"), F.sum(n * l_), F.sum(n * l_ * l_), F.sum(n * F.col("_t")), F.count_distinct(F.when(d > 0, F.col("_t")))).first()


LIFE = "distribution string, threshold double, location double, scale double, shape double, log_likelihood double, aic double, bic double, n long, failures long, reason string"


def threshold_life(df: DataFrame, time: str, event: Column, family: str = "weibull", refine: int = 3) -> DataFrame:
    """A row of a life of time - threshold: three-parameter Weibull or lognormal, or two-parameter exponential.

    The exponential's threshold is the least time. The others' comes from the profile of the likelihood: thresholds
    below the least time are fitted side by side, then `refine` times those around the best. location and scale are of
    the log of the rest of life; shape is the Weibull's 1 / scale, and only shapes above 1 count: the likelihood has no
    bound below, and where it is higher there no threshold is given. event is true for a failure. Fewer than 3 failures, or 3 times of failure, or no threshold that
    counts, leave the parameters null and give a reason.
    """
    spark = df.sparkSession
    blocks = _counts(df, time, event, [])
    n, d, least, most, s1, s2, total, distinct = _facts(blocks)

    def told(reason: str) -> DataFrame:
        return spark.createDataFrame([(family, *[None] * 7, int(n or 0), int(d or 0), reason)], LIFE)

    if not d or (family != "exponential" and (d < FEWEST_FAILURES or distinct < FEWEST_FAILURES)):
        return told("too few failures")
    if family == "exponential":
        mean = (total - n * least) / d
        if not mean > 0:
            return told("times do not differ")
        like = -d * math.log(mean) - d
        return spark.createDataFrame([(family, least, None, mean, 1.0, like, 4 - 2 * like, 2 * math.log(n) - 2 * like, n, d, None)], LIFE)
    span = max(most - least, least, 1.0)
    thresholds = sorted({least - span * f for f in OF_RANGE} | {least - max(least * f, 1e-8) for f in OF_LEAST})
    best, known, beyond = None, {}, -math.inf
    for k in range(refine + 1):
        starts = []
        for t in thresholds:
            if known:  # the maximum moves little between neighbours
                starts.append(min(known.values(), key=lambda f: abs(f["threshold"] - t))["b"].copy())
                continue
            spread = max(math.sqrt(max(s2 / n - (s1 / n) ** 2, 1e-6)), 0.05)
            starts.append(np.array([math.log(max(total / n - t, 1e-300)), math.log(spread)]))
        for f in _fit(blocks, family, thresholds, starts, 0):
            f["scale"] = math.exp(f["b"][-1])
            if math.isfinite(f["like"]) and (family != "weibull" or f["scale"] < 1):
                known[f["threshold"]] = f
            elif math.isfinite(f["like"]):
                beyond = max(beyond, f["like"])
        if not known or beyond > max(f["like"] for f in known.values()):  # it rises towards the least time
            return told("the likelihood has no bound")
        best = max(known.values(), key=lambda f: f["like"])
        if k == refine:
            break
        places = sorted(known)
        at = places.index(best["threshold"])
        low, high = places[max(0, at - 1)], places[min(len(places) - 1, at + 1)]
        thresholds = [t for t in (low + (high - low) * j / 9 for j in range(1, 9)) if t not in known]
        if not thresholds or high - low < 1e-9 * span:
            break
    like, parameters = float(best["like"]), 3
    return spark.createDataFrame([(family, float(best["threshold"]), float(best["b"][0]), best["scale"], 1 / best["scale"] if family == "weibull" else None, like, 2 * parameters - 2 * like, parameters * math.log(n) - 2 * like, n, d, None)], LIFE)


TERMS = "term string, estimate double, se double, z double, p_value double, low double, high double, shape double, log_likelihood double, n long, failures long"
LIVES = "celsius double, percent double, life double"


def accelerated_life(df: DataFrame, time: str, event: Column, celsius: str, at: list[float], percents: tuple[float, ...] = (10.0, 50.0, 90.0), confidence: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(terms, lives) of a Weibull life whose log scale is linear in Arrhenius' transform of a temperature.

    terms has intercept, stress and log_shape with errors from the observed information; lives the percentiles at the
    temperatures in `at`. Fewer than 6 rows, 3 failures or 2 temperatures give no rows.
    """
    spark = df.sparkSession
    stress = F.lit(ARRHENIUS) / (F.col(celsius).cast("double") + ZERO)
    centre, levels = df.where(F.col(time) > 0).agg(F.avg(stress), F.count_distinct(F.col(celsius))).first()
    if not levels or levels < 2:
        return spark.createDataFrame([], TERMS), spark.createDataFrame([], LIVES)
    blocks = _counts(df, time, event, [stress - float(centre)])
    n, d, _, _, s1, s2, *_ = _facts(blocks)
    if not n or n < FEWEST_ROWS or d < FEWEST_FAILURES:
        return spark.createDataFrame([], TERMS), spark.createDataFrame([], LIVES)
    (f,) = _fit(blocks, "weibull", [0.0], [np.array([s1 / n, 0.0, 0.5 * math.log(max(s2 / n - (s1 / n) ** 2, 1e-6))])], 1)
    b, covariance = f["b"], np.linalg.pinv(-f["hessian"])
    turn = np.array([[1.0, -centre, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, -1.0]])  # back from the centred stress, and to the log of the shape
    estimates, errors = turn @ b, np.sqrt(np.maximum(np.diag(turn @ covariance @ turn.T), 0.0))
    q, shape, rows = normal_quantile(1 - (1 - confidence) / 2), math.exp(-float(b[-1])), []
    for name, e, se in zip(("intercept", "stress", "log_shape"), estimates.tolist(), errors.tolist(), strict=True):
        z = e / se if se else math.nan
        rows.append((name, e, se, z, 2 * normal_cdf(-abs(z)), e - q * se, e + q * se, shape, float(f["like"]), n, d))
    lives = [(float(c), float(k), math.exp(float(estimates[0]) + float(estimates[1]) * ARRHENIUS / (c + ZERO)) * (-math.log(1 - k / 100)) ** (1 / shape)) for c in at for k in percents]
    return spark.createDataFrame(rows, TERMS), spark.createDataFrame(lives, LIVES)
