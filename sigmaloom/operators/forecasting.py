"""ARIMA by conditional sums of squares, and augmented Dickey-Fuller tests: cross-products of lags, a row a series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_quantile
from ..plans.ordered import block_arrays, blocked, forgotten_after, running, summed_arrays, with_levels, written_rows

MOST_P, MOST_D = 3, 2
#: Asymptotic 5 % points of the Dickey-Fuller distribution by deterministic terms.
DICKEY_FULLER_5 = {"none": -1.95, "drift": -2.86, "trend": -3.41}


def differenced(df: DataFrame, value: str, order: str, by: list[str], d: int, lags: int) -> DataFrame:
    """(by, rank, w0, w1 .. w<lags>): the d-th difference at each place and at the places before it; null where there are none."""
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_y"))
    held, window = blocked(rows, order, d + lags, 0, by=by)
    binomial = [(-1) ** k * math.comb(d, k) for k in range(d + 1)]
    w = sum((c * (F.lag("_y", k).over(window) if k else F.col("_y")) for k, c in enumerate(binomial)), F.lit(0.0))
    held = held.withColumn("_w", w)
    return held.select(*by, "rank", "_home", *[(F.lag("_w", k).over(window) if k else F.col("_w")).alias(f"w{k}") for k in range(lags + 1)]).where("_home").drop("_home")


def _products(columns: list[str]) -> list:
    """Sums of products of columns (a constant one first), the upper triangle by rows."""
    terms = [F.lit(1.0), *map(F.col, columns)]
    return [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]


def _square(sums: list[float], size: int) -> np.ndarray:
    out, at = np.zeros((size, size)), 0
    for i in range(size):
        out[i, i:] = out[i:, i] = sums[at : at + size - i]
        at += size - i
    return out


def criteria(sse: float, n: int, k: int) -> tuple[float, float, float]:
    """AIC, corrected AIC and BIC of n residuals and k parameters."""
    base = n * (math.log(sse / n) + 1 + math.log(2 * math.pi)) if sse > 0 else -math.inf
    return base + 2 * k, base + 2 * k + 2 * k * (k + 1) / (n - k - 1), base + k * math.log(n)


def arima(df: DataFrame, value: str, order: str, by: list[str], d: int = 1, forecasts: int = 4, confidence: float = 0.95) -> DataFrame:
    """Fits of AR orders 0 to 3 to the d-th differences, by series, with forecasts of the observed values.

    A row a series and p: n, sse, aic, aicc, bic, coefficients (constant first) and arrays forecast, lower and
    upper. Least squares come from one aggregation of cross-products; limits widen with the square root of the
    horizon. Orders that leave too few rows are left out; a random walk counts two parameters.
    """
    if not 0 <= d <= MOST_D:
        raise ValueError(f"d is 0 to {MOST_D}")
    w = differenced(df, value, order, by, d, MOST_P)
    level = w.groupBy(*by).agg(F.avg("w0").alias("_m"))
    centred = with_levels(w, level, by).withColumns({f"w{k}": F.col(f"w{k}") - F.col("_m") for k in range(MOST_P + 1)})
    sums = []
    for p in range(MOST_P + 1):
        part = [f"w{k}" for k in range(p + 1)]
        whole = F.col(f"w{p}").isNotNull()
        sums.append(F.array(*[F.coalesce(s, F.lit(0.0)) for s in _products_where(part, whole)]).alias(f"s{p}"))
    fit = centred.groupBy(*by).agg(F.max("_m").alias("m"), *sums)
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_y"))
    places = running(rows, by, [order], {"_i": F.lit(1)})
    ends = with_levels(places, rows.groupBy(*by).agg(F.count("*").alias("_n")), by).where(F.col("_i") > F.col("_n") - (MOST_P + d))
    last = ends.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_y"))).alias("last"))  # a few rows a series
    z = normal_quantile(1 - (1 - confidence) / 2)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                tail = np.array([x["_y"] for x in row["last"]])
                for p in range(MOST_P + 1):
                    m = _square(list(row[f"s{p}"]), p + 2)
                    n, k = int(m[0, 0]), max(p + 1, 2) if p == 0 else p + 1
                    if n <= k + 1:
                        continue
                    keep = [0, *range(2, p + 2)]
                    b, *_ = np.linalg.lstsq(m[np.ix_(keep, keep)], m[keep, 1], rcond=None)
                    sse = max(0.0, float(m[1, 1] - b @ m[keep, 1]))
                    aic, aicc, bic = criteria(sse, n, k)
                    constant = float(b[0] + row["m"] * (1 - b[1:].sum()))
                    path = _ahead(tail, d, np.append(constant, b[1:]), forecasts)
                    half = z * math.sqrt(sse / n) * np.sqrt(np.arange(1, forecasts + 1))
                    key = {c: row[c] for c in by}
                    out.append({**key, "p": p, "d": d, "n": n, "sse": sse, "aic": aic, "aicc": aicc, "bic": bic, "coefficients": [constant, *b[1:].tolist()], "forecast": path.tolist(), "lower": (path - half).tolist(), "upper": (path + half).tolist()})
            yield pd.DataFrame(out, columns=[*by, "p", "d", "n", "sse", "aic", "aicc", "bic", "coefficients", "forecast", "lower", "upper"])

    schema = "".join(f"{c} {t}, " for c, t in df.select(*by).dtypes) + "p int, d int, n long, sse double, aic double, aicc double, bic double, coefficients array<double>, forecast array<double>, lower array<double>, upper array<double>"
    return with_levels(fit, last, by).mapInPandas(solve, schema)


def _products_where(columns: list[str], condition) -> list:
    terms = [F.lit(1.0), *map(F.col, columns)]
    return [F.sum(F.when(condition, terms[i] * terms[j])) for i in range(len(terms)) for j in range(i, len(terms))]


def _ahead(tail: np.ndarray, d: int, coefficients: np.ndarray, steps: int) -> np.ndarray:
    """Values after the last ones: differences by the regression on those before, summed up d times."""
    levels = [tail]
    for _ in range(d):
        levels.append(np.diff(levels[-1]))
    w, ends = levels[-1].tolist(), [x[-1] for x in levels[:-1]]
    out = []
    for _ in range(steps):
        new = coefficients[0] + sum(c * w[-k] for k, c in enumerate(coefficients[1:], 1))
        w.append(new)
        for k in range(d - 1, -1, -1):
            new = ends[k] = ends[k] + new
        out.append(new)
    return np.array(out)


def moving_average_model(df: DataFrame, value: str, order: str, by: list[str], d: int = 0, places: int = 41, rounds: int = 3, most: float = 0.98) -> DataFrame:
    """MA(1) of the d-th differences around their mean, by conditional sums of squares, by series: theta, mean, n, sse and criteria.

    A round folds the runs of every series once for all places of a grid of theta, of which a row of sums a run is left,
    and the grid closes in on the best place.
    """
    runs = block_arrays(df, value, order, by, d + forgotten_after(most, 1e-12))
    keys = "".join(f"`{c}` {t}, " for c, t in df.select(*by).dtypes)

    def level_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                w = np.diff(np.asarray(row["_y"]), d)[-int(row["_own"]) :]
                yield pd.DataFrame([[*(row[c] for c in by), len(w), float(w.sum())]], columns=[*by, "n", "total"])

    level = runs.mapInPandas(level_sums, keys + "n long, total double").groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("_m"), F.sum("n").alias("_n")).where("_n > 0")
    best, width = level.withColumns({"theta": F.lit(0.0), "sse": F.lit(None).cast("double")}), most

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                c, grid = np.diff(np.asarray(row["_y"]), d) - row["_m"], np.clip(row["theta"] + steps, -most, most)
                own, e, out = min(int(row["_own"]), len(c)), np.zeros(places), np.zeros(places)
                for t, v in enumerate(c.tolist()):
                    e = v - grid * e
                    if t >= len(c) - own:
                        out += e * e
                yield pd.DataFrame([[*(row[k] for k in by), grid, out]], columns=[*by, "grid", "squares"])

    for _ in range(rounds):
        steps = np.linspace(-width, width, places)
        found = with_levels(runs, best.select(*by, "_m", "theta"), by).mapInPandas(squares, keys + "grid array<double>, squares array<double>")
        sums = found.groupBy(*by, "grid").agg(F.array(*[F.sum(F.col("squares")[k]) for k in range(places)]).alias("s"))
        least = F.array_min(F.arrays_zip(F.col("s").alias("sse"), F.col("grid").alias("theta")))
        best = written_rows(with_levels(level, sums.select(*by, least.alias("b")), by).select(*by, "_m", "_n", F.col("b.theta").alias("theta"), F.col("b.sse").alias("sse")))
        width = 2 * width / (places - 1)
    n, k = F.col("_n"), 2
    base = n * (F.log(F.col("sse") / n) + 1 + math.log(2 * math.pi))
    return best.select(*by, "theta", F.col("_m").alias("mean"), n.alias("n"), "sse", (base + 2 * k).alias("aic"), (base + 2 * k + 2 * k * (k + 1) / (n - k - 1)).alias("aicc"), (base + k * F.log(n)).alias("bic"))


def augmented_dickey_fuller(df: DataFrame, value: str, order: str, by: list[str], lags: int | None = None, regression: str = "drift") -> DataFrame:
    """t of the level before in the regression of the step on it, on `lags` steps before and on a constant (drift) and time (trend).

    lags: by default the whole part of the cube root of a series' length less one. Series of fewer than 8
    values, or too short for their lags, are left out. Cross-products are summed within runs of values, a row of
    sums a run, so the plan does not grow with the lags.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    own = F.lit(lags) if lags is not None else F.floor(F.cbrt(F.col("_n") - 1) + 1e-9).cast("int")
    sizes = sizes.where("_n >= 8").withColumn("lags", own)
    longest = sizes.agg(F.max("lags")).first()[0]
    schema = "".join(f"{c} {t}, " for c, t in df.select(*by).dtypes) + "lags int, n long, coefficient double, statistic double, critical_5 double"
    if longest is None:
        return df.sparkSession.createDataFrame([], schema)
    size = longest + 4  # a constant, time, the level before, the steps before, the step
    runs = with_levels(block_arrays(df, value, order, by, longest + 1), sizes, by)
    keys = "".join(f"`{c}` {t}, " for c, t in df.select(*by).dtypes)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                y, at, own, lags, n = np.asarray(row["_y"]), int(row["_at"]), int(row["_own"]), int(row["lags"]), int(row["_n"])
                sums, step = np.zeros((size, size)), np.diff(y)
                first = max(len(y) - own, lags + 1)  # a value needs `lags` steps before its own
                for low in range(first, len(y), max(1, (1 << 21) // size)):
                    t = np.arange(low, min(len(y), low + max(1, (1 << 21) // size)))
                    x = np.zeros((len(t), size))
                    x[:, 0], x[:, 1], x[:, 2], x[:, -1] = 1.0, (at + t) / n, y[t - 1], step[t - 1]
                    for k in range(1, lags + 1):
                        x[:, 2 + k] = step[t - 1 - k]
                    sums += x.T @ x
                yield pd.DataFrame([[*(row[c] for c in by), lags, sums.ravel()]], columns=[*by, "lags", "sums"])

    sums = summed_arrays(runs.mapInPandas(products, keys + "lags int, sums array<double>"), [*by, "lags"], "sums")
    fixed = {"none": [], "drift": [0], "trend": [0, 1]}[regression]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                m, used = np.asarray(row["sums"]).reshape(size, size), int(row["lags"])
                keep, y, n = [*fixed, 2, *range(3, 3 + used)], size - 1, int(m[0, 0])
                if n <= len(keep):
                    continue
                a = m[np.ix_(keep, keep)]
                inverse = np.linalg.pinv(a)
                b = inverse @ m[keep, y]
                s2 = max(0.0, float(m[y, y] - b @ m[keep, y])) / (n - len(keep))
                at = len(fixed)
                out.append({**{c: row[c] for c in by}, "lags": used, "n": n, "coefficient": b[at], "statistic": b[at] / math.sqrt(s2 * inverse[at, at]), "critical_5": DICKEY_FULLER_5[regression]})
            yield pd.DataFrame(out, columns=[*by, "lags", "n", "coefficient", "statistic", "critical_5"])

    return sums.mapInPandas(solve, schema)
