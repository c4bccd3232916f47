"""Seasonal ARIMA models (p,d,q)(P,D,Q)_s by conditional sums of squares, with forecasts.

A series is cut once into runs of values (plans.ordered.block_arrays). Every round passes over the runs: residuals
and their derivatives are linear filters of a run, solved at once by a fast Fourier transform, and only their cross
products leave it. A step of Levenberg and Marquardt a series and model follows from their sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_quantile
from ..plans.ordered import block_arrays, with_levels, written_rows

#: The inverse roots of both moving-average factors stay below this.
MOST = 0.95
ROUNDS, SETTLED = 60, 1e-9
Model = tuple[int, int, int, int]  # p, q, P, Q


def polynomials(model: Model, values: np.ndarray, s: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The plain and the seasonal factor of the autoregressive operator, and those of the moving average, by powers of the lag."""
    p, q, sp, sq = model
    parts = np.split(np.asarray(values, float), np.cumsum([p, q, sp]))
    factors = []
    for coefficients, lag, sign in zip(parts, (1, 1, s, s), (-1, 1, -1, 1), strict=True):
        out = np.zeros(len(coefficients) * lag + 1)
        out[0] = 1.0
        out[lag::lag] = sign * coefficients
        factors.append(out)
    return [factors[0], factors[2]], [factors[1], factors[3]]


def moving_parts(model: Model) -> list[slice]:
    """Where the coefficients of the two moving-average factors are."""
    p, q, sp, sq = model
    return [slice(p, p + q), slice(p + q + sp, p + q + sp + sq)]


def radius(coefficients: np.ndarray) -> float:
    """The largest inverse root of 1 + c1 B + c2 B^2 and so on."""
    return float(np.max(np.abs(np.roots([1.0, *coefficients])), initial=0.0)) if len(coefficients) else 0.0


def admissible(model: Model, values: np.ndarray) -> bool:
    return all(radius(values[part]) <= MOST for part in moving_parts(model))


def reach(s: int, q: int, sq: int) -> int:
    """Steps after which a moving average within the bounds has forgotten all but 1e-12 of a value."""
    one = math.ceil(math.log(1e-12) / math.log(MOST))
    return max(one if q else 0, one * s if sq else 0)


def _applied(polynomial: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The lag polynomial on x, with zeros before its start."""
    out = np.zeros_like(x)
    for lag in np.flatnonzero(polynomial).tolist():
        out[lag:] += polynomial[lag] * x[: len(x) - lag]
    return out


def _shifted(x: np.ndarray, lag: int) -> np.ndarray:
    return np.concatenate([np.zeros(min(lag, len(x))), x[: max(0, len(x) - lag)]])


def residuals(w: np.ndarray, model: Model, values: np.ndarray, s: int, known: int, slopes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, derivatives a row a coefficient) of centred values w; those of the first `known` places are zero."""
    p, q, sp, sq = model
    (ar, sar), (ma, sma) = polynomials(model, values, s)
    size = 1 << (len(w) + reach(s, q, sq)).bit_length()
    response = np.fft.rfft(np.convolve(ma, sma), size)

    def inverted(x: np.ndarray) -> np.ndarray:
        x[:known] = 0.0
        return np.fft.irfft(np.fft.rfft(x, size) / response, size)[: len(w)] if q or sq else x

    e = inverted(_applied(np.convolve(ar, sar), w))
    if not slopes:
        return e, np.zeros((0, len(w)))
    on_sar, on_ar, on_sma, on_ma = _applied(sar, w), _applied(ar, w), _applied(sma, e), _applied(ma, e)
    rows = [inverted(-_shifted(on_sar, k)) for k in range(1, p + 1)] + [inverted(-_shifted(on_sma, k)) for k in range(1, q + 1)]
    rows += [inverted(-_shifted(on_ar, k * s)) for k in range(1, sp + 1)] + [inverted(-_shifted(on_ma, k * s)) for k in range(1, sq + 1)]
    return e, np.array(rows).reshape(len(rows), len(w))


def seasonally_differenced(y: np.ndarray, d: int, sd: int, s: int) -> np.ndarray:
    for _ in range(sd):
        y = y[s:] - y[:-s]
    return np.diff(y, d) if d else y


def _tidy(sums: list[float], m: int) -> tuple[float, np.ndarray, np.ndarray]:
    return sums[0], np.array(sums[1 : 1 + m]), np.array(sums[1 + m : 1 + m + m * m]).reshape(m, m)


def _next(row: dict, m: int, model: Model) -> dict:
    """The state after the sums at its trial: the trial is taken if it is better, then a new one is made."""
    sse, je, jj = _tidy(list(row["sums"]), m)
    best, damping = row["sse"], row["damping"]
    better = best is None or sse < best
    gain = math.inf if best is None else (best - sse) / max(best, 1e-300)
    if better:
        row = row | {"best": list(row["trial"])[:m], "sse": sse, "je": je.tolist(), "jj": jj.ravel().tolist(), "damping": max(damping / 10, 1e-9)}
    else:
        row = row | {"damping": damping * 10}
    done = m == 0 or (better and gain < SETTLED) or row["damping"] > 1e9
    je, jj, best = np.array(row["je"]), np.array(row["jj"]).reshape(m, m), np.array(row["best"])
    if not done:
        a = jj + row["damping"] * np.diag(np.maximum(np.diag(jj), 1e-300))
        step, *_ = np.linalg.lstsq(a, -je, rcond=None)
        free = np.ones(m, bool)
        for part in moving_parts(model):  # a factor at its bound that would leave it stays
            free[part] = radius(best[part]) < MOST - 1e-6 or radius(best[part] + step[part]) < MOST
        if not free.all():
            step = np.zeros(m)
            step[free] = np.linalg.lstsq(a[np.ix_(free, free)], -je[free], rcond=None)[0]
        low, high = 0.0, 1.0
        if not admissible(model, best + step):
            for _ in range(40):
                mid = (low + high) / 2
                low, high = (mid, high) if admissible(model, best + mid * step) else (low, mid)
            step *= low
        done = not np.any(step)
        row = row | {"trial": (best + step).tolist()}
    return row | {"done": done}


def seasonal_arima(df: DataFrame, value: str, order: str, by: list[str], models: list[Model], d: int = 0, sd: int = 0, s: int = 1, forecasts: int = 4, confidence: float = 0.95, rows: int | None = None) -> DataFrame:
    """A row a series and model (p, q, P, Q): n, sse, criteria, coefficients and arrays forecast, lower and upper.

    Differences are taken d times and, at lag s, sd times, and centred on their mean. Sums of squares are conditional:
    residuals of the first places, as many as the longest lag of the model, are zero. Coefficients are those of
    1 - phi B and 1 + theta B, plain AR, plain MA, seasonal AR, seasonal MA; moving averages keep their inverse roots
    up to MOST, autoregressions are free. The criteria count the coefficients and the mean.
    Limits follow from the variance sse / n and the weights of past shocks. Nulls of value are left out; a series of
    fewer than 8 differences, or no more of them than the longest lag and three, has no row, nor has one that is
    constant. rows: values a run holds, chosen from the table if not given.
    """
    models = [tuple(m) for m in models]
    if not models or any(min(m) < 0 for m in models) or min(d, sd) < 0 or s < 1 or (s == 1 and (sd or any(m[2] or m[3] for m in models))):
        raise ValueError("orders are not negative, and seasonal parts need a season of 2 or more")
    lost = d + sd * s
    lags = [max(p + sp * s, q + sq * s) for p, q, sp, sq in models]
    before = lost + max(lags) + max(reach(s, m[1], m[3]) for m in models)
    runs = block_arrays(df, value, order, by, before, rows)
    keys = "".join(f"`{c}` {t}, " for c, t in df.select(*by).dtypes)
    most = max(sum(m) for m in models)
    width = 1 + most + most * most

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                w = seasonally_differenced(np.asarray(row["_y"]), d, sd, s)[-int(row["_own"]) :]
                out.append({**{c: row[c] for c in by}, "n": len(w), "total": float(w.sum()), "low": float(w.min(initial=math.inf)), "high": float(w.max(initial=-math.inf))})
            yield pd.DataFrame(out, columns=[*by, "n", "total", "low", "high"])

    levels = runs.mapInPandas(level, keys + "n long, total double, low double, high double").groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), (F.max("high") > F.min("low")).alias("_moves"))
    levels = levels.where("n >= 8 and _moves").drop("_moves")
    each = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(lag).alias("lag")) for k, lag in enumerate(lags)])
    states = levels.select(*by, "n", "mean", F.explode(each).alias("_m")).where(F.col("n") > F.col("_m.lag") + 3).select(*by, "n", "mean", "_m.model")
    none = F.lit(None)
    states = states.withColumns({"trial": F.transform(F.sequence(F.lit(1), F.lit(max(1, most))), lambda _: F.lit(0.0)), "best": none.cast("array<double>"), "je": none.cast("array<double>"), "jj": none.cast("array<double>"), "sse": none.cast("double"), "damping": F.lit(1e-3), "done": F.lit(False)})
    names = states.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in states.dtypes)
    def sums_of(row: dict, mean: float, k: int, trial: np.ndarray) -> np.ndarray:
        """Square sum, gradient and cross-products of a run's own residuals, padded to one width."""
        own, model, m = int(row["_own"]), models[k], sum(models[k])
        w = seasonally_differenced(np.asarray(row["_y"]), d, sd, s) - mean
        mine = min(own, len(w))
        known = max(0, lags[k] - int(row["_at"]))  # the series may begin in this run or in what it sees before it
        e, slopes = residuals(w, model, trial[:m], s, known)
        e, slopes = e[len(w) - mine :], slopes[:, len(w) - mine :]
        sums = np.zeros(width)
        sums[: 1 + m + m * m] = np.concatenate([[e @ e], slopes @ e, (slopes @ slopes.T).ravel()])
        return sums

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for ask in row["_open"]:
                    out.append({**{c: row[c] for c in by}, "model": ask["model"], "sums": sums_of(row, row["mean"], ask["model"], np.asarray(ask["trial"]))})
            yield pd.DataFrame(out, columns=[*by, "model", "sums"])

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for k, lag in enumerate(lags):
                    if row["n"] <= lag + 3:
                        continue
                    state = {**{c: row[c] for c in by}, "n": row["n"], "mean": row["mean"], "model": k, "trial": [0.0] * max(1, most), "best": None, "je": None, "jj": None, "sse": None, "damping": 1e-3, "done": False}
                    for _ in range(ROUNDS):
                        state = _next(state | {"sums": sums_of(row, row["mean"], k, np.asarray(state["trial"]))}, sum(models[k]), models[k])
                        if state["done"]:
                            break
                    out.append({c: state[c] for c in names})
            yield pd.DataFrame(out, columns=names)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records") if len(batch) else []:
                k = int(row["model"])
                if not row["done"]:
                    row = _next(row, sum(models[k]), models[k])
                out.append({c: row[c] for c in names})
            yield pd.DataFrame(out, columns=names)

    tops = runs.groupBy(*by).agg(F.max("_block").alias("_top"))
    single = with_levels(with_levels(runs, tops.where("_top = 0"), by), levels, by).mapInPandas(alone, schema)  # a series of one run needs no rounds
    states = with_levels(states, tops.where("_top > 0"), by).drop("_top")
    states = written_rows(states)
    for _ in range(ROUNDS):
        if states.where("not done").isEmpty():
            break
        going = states.where("not done").groupBy(*by).agg(F.first("mean").alias("mean"), F.collect_list(F.struct("model", "trial")).alias("_open"))  # a few models a series
        sums = with_levels(runs, going, by).mapInPandas(products, keys + "model int, sums array<double>")
        sums = sums.groupBy(*by, "model").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        states = written_rows(with_levels(states, sums, [*by, "model"], how="left").mapInPandas(step, schema))
    states = states.union(single.select(*names))
    z = normal_quantile(1 - (1 - confidence) / 2)
    ends = with_levels(runs, tops, by).where("_block = _top")
    fitted = states.groupBy(*by).agg(F.collect_list(F.struct("model", "n", "mean", "best", "sse")).alias("_fits"))
    made = "n long, sse double, aic double, aicc double, bic double, mean double, coefficients array<double>, forecast array<double>, lower array<double>, upper array<double>"

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*by, "p", "d", "q", "sp", "sd", "sq", "s", *[x.split()[0] for x in made.split(", ")]]
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                y, at = np.asarray(row["_y"]), int(row["_at"])
                w = seasonally_differenced(y, d, sd, s)
                for fit in row["_fits"]:
                    k, n, sse = fit["model"], int(fit["n"]), float(fit["sse"])
                    model, m = models[k], sum(models[k])
                    best = np.asarray(fit["best"])[:m]
                    e, _ = residuals(w - fit["mean"], model, best, s, max(0, lags[k] - at), slopes=False)
                    path, shocks = _forecast(y, w - fit["mean"], e, model, best, s, d, sd, fit["mean"], forecasts)
                    half = z * math.sqrt(sse / n) * shocks
                    parameters = m + 1
                    base = n * (math.log(2 * math.pi) + 1 + math.log(max(sse / n, 1e-300)))
                    free = n - parameters - 1
                    aic = base + 2 * parameters
                    p, q, sp, sq = model
                    out.append([*(row[c] for c in by), p, d, q, sp, sd, sq, s, n, sse, aic, aic + 2 * parameters * (parameters + 1) / free if free > 0 else aic, base + parameters * math.log(n), fit["mean"], best, path, path - half, path + half])
            yield pd.DataFrame(out, columns=columns)

    return with_levels(ends, fitted, by).mapInPandas(ahead, keys + "p int, d int, q int, sp int, sd int, sq int, s int, " + made)


def _forecast(y: np.ndarray, w: np.ndarray, e: np.ndarray, model: Model, values: np.ndarray, s: int, d: int, sd: int, mean: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(values ahead, their standard deviations for a shock of one) with future shocks at zero."""
    (ar, sar), (ma, sma) = polynomials(model, values, s)
    ar, ma = np.convolve(ar, sar), np.convolve(ma, sma)
    w, e = [*np.zeros(len(ar)), *w.tolist()], [*np.zeros(len(ma)), *e.tolist()]
    for _ in range(steps):
        w.append(-sum(ar[k] * w[-k] for k in range(1, len(ar))) + sum(ma[k] * e[-k] for k in range(1, len(ma))))
        e.append(0.0)
    undo = np.array([1.0])  # the differences' polynomial
    for lag in [1] * d + [s] * sd:
        factor = np.zeros(lag + 1)
        factor[0], factor[-1] = 1.0, -1.0
        undo = np.convolve(undo, factor)
    path = y.tolist()
    for step in range(steps):
        path.append(w[len(w) - steps + step] + mean - sum(undo[k] * path[-k] for k in range(1, len(undo))))
    whole, psi = np.convolve(ar, undo), [1.0]
    for step in range(1, steps):
        psi.append((ma[step] if step < len(ma) else 0.0) - sum(whole[k] * psi[step - k] for k in range(1, min(step, len(whole) - 1) + 1)))
    return np.array(path[len(y) :]), np.sqrt(np.cumsum(np.square(psi)))
