"""Time series: lagged products by windows over series, recursions by folds or grouped pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import folded, forgotten_after, in_blocks, quantiles, running, with_levels


def acf(df: DataFrame, value: str, order: str, by: list[str], lags: int = 20) -> DataFrame:
    """Autocorrelations with the fixed band, a row a series and lag, in one pass over the ordered rows."""
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_y"))
    rows = with_levels(rows, rows.groupBy(*by).agg(F.avg("_y").alias("_m")), by).select(*by, order, (F.col("_y") - F.col("_m")).alias("_d"))
    rows = in_blocks(rows, order, by, lags, 0, lambda w: {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_d") ** 2).alias("c0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / F.col("c0")).alias("acf")) for k in range(1, lags + 1)])
    out = s.select(*by, "n", F.explode(pairs).alias("p"))
    return out.select(*by, "n", F.col("p.lag").alias("lag"), F.col("p.acf").alias("acf"), (1.959963984540054 / F.sqrt("n")).alias("band"))


def ljung_box(correlations: DataFrame, by: list[str]) -> DataFrame:
    """Running Ljung-Box statistic of acf() rows."""
    upto = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("n").cast("double")
    return correlations.withColumn("ljung_box", n * (n + 2) * F.sum(F.col("acf") ** 2 / (n - F.col("lag"))).over(upto))


def pacf(correlations: DataFrame, by: list[str]) -> DataFrame:
    """Partial autocorrelations by Durbin-Levinson from acf() rows, a group a series."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lag")
        r, out, phi = rows["acf"].to_numpy(), [], np.zeros(0)
        for k in range(len(r)):
            top = r[k] - phi @ r[:k][::-1]
            last = top / (1 - phi @ r[:k]) if k else r[0]
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return rows[[*by, "lag"]].assign(pacf=out)

    schema = ", ".join(f"{c} {t}" for c, t in correlations.select(*by, "lag").dtypes) + ", pacf double"
    return correlations.groupBy(*by).applyInPandas(run, schema)


def ccf(df: DataFrame, first: str, second: str, order: str, by: list[str], lags: int = 10) -> DataFrame:
    """Cross-correlations of two series at lags from -lags to lags (first at t + lag with second at t)."""
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*by, order, F.col(first).cast("double").alias("_a"), F.col(second).cast("double").alias("_b"))
    rows = with_levels(rows, rows.groupBy(*by).agg(F.avg("_a").alias("_ma"), F.avg("_b").alias("_mb")), by).select(*by, order, (F.col("_a") - F.col("_ma")).alias("_x"), (F.col("_b") - F.col("_mb")).alias("_y"))
    ks = range(-lags, lags + 1)
    rows = in_blocks(rows, order, by, lags, lags, lambda w: {f"_k{i}": F.lag("_x", -k).over(w) for i, k in enumerate(ks)})
    c = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("_x") ** 2) * F.sum(F.col("_y") ** 2)).alias("c"), *[F.sum(F.col(f"_k{i}") * F.col("_y")).alias(f"s{i}") for i in range(len(ks))])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"s{i}") / F.col("c")).alias("ccf")) for i, k in enumerate(ks)])
    return c.select(*by, F.explode(pairs).alias("p")).select(*by, "p.lag", "p.ccf")


def _fits(df: DataFrame, value: str, order: str, by: list[str], function, reach: int) -> DataFrame:
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_y"))
    fits = folded(rows, order, by, ["_y"], lambda x, at: {"fitted": function(x[:, 0], at)}, "fitted double", reach)
    return fits.select(*by, order, "fitted", (F.col("_y") - F.col("fitted")).alias("residual"))


def smoothed_levels(y: np.ndarray, alpha: float) -> np.ndarray:
    """Levels of single exponential smoothing that begins at the first value."""
    if len(y) > 200:
        return pd.Series(y).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    out, level = np.empty(len(y)), y[0] if len(y) else 0.0
    for t, v in enumerate(y.tolist()):
        level = alpha * v + (1 - alpha) * level
        out[t] = level
    return out


def single_smoothing(df: DataFrame, value: str, order: str, by: list[str], alpha: float = 0.2) -> DataFrame:
    """One-step fits of single exponential smoothing; the first fit is the first value."""
    return _fits(df, value, order, by, lambda y, at: np.append(y[:1], smoothed_levels(y, alpha)[:-1]), forgotten_after(1 - alpha))


def double_smoothing(df: DataFrame, value: str, order: str, by: list[str], alpha: float = 0.2, gamma: float = 0.2) -> DataFrame:
    """One-step fits with a trend that begins as the second value less the first."""
    def run(y: np.ndarray, at: int) -> np.ndarray:
        fit = np.empty(len(y))
        level, trend = (y[0], y[1] - y[0]) if len(y) > 1 else (y[0] if len(y) else 0.0, 0.0)
        for t, v in enumerate(y.tolist()):
            fit[t] = level if t == 0 else level + trend
            new = v if t == 0 else alpha * v + (1 - alpha) * (level + trend)
            trend = trend if t == 0 else gamma * (new - level) + (1 - gamma) * trend
            level = new
        return fit

    step = np.array([[1 - alpha, 1 - alpha], [-alpha * gamma, 1 - alpha * gamma]])
    return _fits(df, value, order, by, run, forgotten_after(float(np.abs(np.linalg.eigvals(step)).max())))


def _seasonal_rate(period: int, alpha: float, gamma: float, delta: float) -> float:
    """What additive seasonal smoothing keeps of its state a step, but for a constant moved from the level to the seasons."""
    step = np.zeros((2 + period, 2 + period))  # level, trend, the seasons from the next one on
    step[0, :3] = 1 - alpha, 1 - alpha, -alpha
    step[1] = gamma * step[0] + np.eye(2 + period)[1] * (1 - gamma) - gamma * np.eye(2 + period)[0]
    step[2:-1, 3:] = np.eye(period - 1)
    step[-1] = -delta * step[0] + (1 - delta) * np.eye(2 + period)[2]
    sizes = np.sort(np.abs(np.linalg.eigvals(step)))
    return float(sizes[:-1].max()) if sizes[-1] > 1 - 1e-9 else float(sizes[-1])


def seasonal_smoothing(df: DataFrame, value: str, order: str, by: list[str], period: int, alpha: float = 0.2, gamma: float = 0.2, delta: float = 0.2, multiplicative: bool = False) -> DataFrame:
    """Holt-Winters one-step fits; level and seasons begin from the first period. Multiplicative fits take a series to a block."""
    def run(y: np.ndarray, at: int) -> np.ndarray:
        if len(y) < 2 * period:
            return np.full(len(y), np.nan)
        level, trend = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
        season = y[:period] / level if multiplicative else y[:period] - level
        fit = np.empty(len(y))
        for t, v in enumerate(y.tolist()):
            s = season[t % period]
            fit[t] = (level + trend) * s if multiplicative else level + trend + s
            new = alpha * (v / s if multiplicative else v - s) + (1 - alpha) * (level + trend)
            trend = gamma * (new - level) + (1 - gamma) * trend
            level = new
            season[t % period] = delta * (v / level if multiplicative else v - level) + (1 - delta) * s
        return fit

    whole = 1 << 40
    return _fits(df, value, order, by, run, whole if multiplicative else max(2 * period, forgotten_after(_seasonal_rate(period, alpha, gamma, delta))))


def accuracy(fits: DataFrame, by: list[str], value: str = "fitted", residual: str = "residual") -> DataFrame:
    """MAD, MSD and MAPE of fits by series; rows whose value is 0 count in the divisor of MAPE."""
    y = F.col(value) + F.col(residual)
    return fits.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(residual)).alias("mad"), F.avg(F.col(residual) ** 2).alias("msd"), (100 * F.sum(F.when(y != 0, F.abs(F.col(residual) / y)).otherwise(0.0)) / F.count("*")).alias("mape"))


def moving_average(df: DataFrame, value: str, order: str, by: list[str], length: int, ranks: bool = False) -> DataFrame:
    """Centred means of `length` values (twice averaged where it is even); null at the ends. ranks: keep each row's place as rank."""
    half = length // 2

    def centred(w: Window) -> dict:
        mean = lambda a, b: F.when(F.count(value).over(w.rowsBetween(a, b)) == b - a + 1, F.avg(value).over(w.rowsBetween(a, b)))
        return {"centred": mean(-half, half) if length % 2 else (mean(-half, half - 1) + mean(-half + 1, half)) / 2}

    return in_blocks(df.where(F.col(value).isNotNull()), order, by, half, half, centred, ranks)


def decompose(df: DataFrame, value: str, order: str, by: list[str], period: int) -> DataFrame:
    """Additive seasonal indices: medians of value - centred mean by phase, less their median; a row a series and phase."""
    rows = moving_average(df.select(*by, order, value), value, order, by, period, ranks=True).withColumn("phase", ((F.col("rank") - 1) % period).cast("int"))
    raw = quantiles(rows.where("centred is not null"), F.col(value) - F.col("centred"), [*by, "phase"], {"raw": 0.5}).drop("_n")
    mid = raw.groupBy(*by).agg(F.percentile("raw", F.lit(0.5)).alias("_mid"))
    joined = raw.join(mid, by) if by else raw.crossJoin(mid)
    return joined.select(*by, "phase", (F.col("raw") - F.col("_mid")).alias("seasonal_index"))


def trend(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Least-squares line of value on position 1, 2 and so on, by series."""
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("y"))
    rows = running(rows, by, [order], {"t": F.lit(1.0)})
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept("y", "t").alias("intercept"), F.regr_slope("y", "t").alias("slope"), F.regr_r2("y", "t").alias("r_squared"))


def dickey_fuller(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """t of the level in the regression of the step on the level before it (no lags), by series, with asymptotic 5 % value."""
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_y"))
    rows = in_blocks(rows, order, by, 1, 0, lambda w: {"_l": F.lag("_y").over(w)}).where("_l is not null").withColumn("_d", F.col("_y") - F.col("_l"))
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("_d", "_l").alias("b"), F.regr_sxx("_d", "_l").alias("sxx"), F.regr_syy("_d", "_l").alias("syy"), F.regr_sxy("_d", "_l").alias("sxy"))
    se = F.sqrt((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    return s.select(*by, "n", F.col("b").alias("coefficient"), (F.col("b") / se).alias("statistic"), F.lit(-2.86).alias("critical_5"))


def arima_candidates(df: DataFrame, value: str, order: str, by: list[str], most: int = 3) -> DataFrame:
    """Conditional least squares of AR(p) on the differenced series, p from 0 to most (3 at most), with AICc, by series."""
    from .forecasting import arima

    fits = arima(df, value, order, by, d=1).where((F.col("p") <= most) & (F.col("n") > F.col("p") + 3))
    n, k = F.col("n"), F.col("p") + 2
    aic = F.when(F.col("sse") > 0, n * F.log(F.col("sse") / n) + 2 * k).otherwise(float("-inf"))
    return fits.select(*by, "p", "sse", (aic + 2 * k * (k + 1) / (n - k - 1)).alias("aicc"))
