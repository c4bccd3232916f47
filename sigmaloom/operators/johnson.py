"""Johnson transforms to normality, and capability of transformed values.

A family's curve goes through four quantiles at -3z, -z, z and 3z; the ratio of their distances tells bounded (SB),
lognormal (SL) and unbounded (SU) curves apart. For each z of a list one curve is tried, and that with the largest
Anderson-Darling p of the transformed values wins. The quantiles of all z are had at once; values are counted and
sorted once, and moments and the statistic of all curves are sums over parts of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_cdf, normal_quantile
from ..plans.ordered import quantiles, value_blocks, with_levels, written_rows

#: The z that are tried, and the share of values that a bounded curve must hold.
TRIED = (0.25, 0.34, 0.44, 0.52, 0.61, 0.70, 0.80, 0.90, 1.00, 1.10, 1.25)
LEAST_HELD, FEWEST = 0.95, 8
CURVE = "struct<z:double,family:string,gamma:double,eta:double,lambda:double,epsilon:double>"
FIT = "n long, found boolean, z double, family string, gamma double, eta double, lambda double, epsilon double, mean double, stdev double, a2 double, p_value double"


def curve(z: float, q: tuple[float, float, float, float]) -> dict | None:
    """The curve through the quantiles at -3z, -z, z, 3z, or none if they do not rise or it has no finite parameters."""
    far_low, low, high, far_high = q
    m, n, p = far_high - high, low - far_low, high - low
    if min(m, n, p) <= 0:
        return None
    centre, ratio = (high + low) / 2, m * n / (p * p)
    try:
        if ratio > 1.001:
            a, b, root = m / p, n / p, math.sqrt(ratio - 1)
            family, eta = "SU", 2 * z / math.acosh((a + b) / 2)
            gamma = eta * math.asinh((b - a) / (2 * root))
            lam, eps = 2 * p * root / ((a + b - 2) * math.sqrt(a + b + 2)), centre + p * (b - a) / (2 * (a + b - 2))
        elif ratio < 0.999:
            a, b, c = p / m, p / n, 1 / ratio - 1
            whole = (1 + a) * (1 + b)
            family, eta = "SB", z / math.acosh(math.sqrt(whole) / 2)
            gamma = eta * math.asinh((b - a) * math.sqrt(whole - 4) / (2 * c))
            lam = p * math.sqrt((whole - 2) ** 2 - 4) / c
            eps = centre - lam / 2 + p * (b - a) / (2 * c)
        else:
            r = m / p
            family, eta, lam = "SL", 2 * z / math.log(r), 1.0
            gamma, eps = eta * math.log((r - 1) / (p * math.sqrt(r))), centre - p / 2 * (r + 1) / (r - 1)
    except (ValueError, ZeroDivisionError):
        return None
    if not (eta > 0 and lam > 0 and all(map(math.isfinite, (gamma, eta, lam, eps)))):
        return None
    return {"z": z, "family": family, "gamma": gamma, "eta": eta, "lambda": lam, "epsilon": eps}


def transformed(x: np.ndarray, c: dict) -> np.ndarray:
    """The curve's z of values; nan outside its support."""
    off = x - c["epsilon"]
    with np.errstate(invalid="ignore", divide="ignore"):
        if c["family"] == "SU":
            inner = np.arcsinh(off / c["lambda"])
        elif c["family"] == "SL":
            inner = np.log(np.where(off > 0, off, np.nan))
        else:
            left = c["lambda"] - off
            inner = np.log(np.where((off > 0) & (left > 0), off / left, np.nan))
    return c["gamma"] + c["eta"] * inner


def transform_column(x: Column, fit: Column) -> Column:
    """The same of a column by a struct of family, gamma, eta, lambda and epsilon; null outside the support."""
    off = x.cast("double") - fit["epsilon"]
    left = fit["lambda"] - off
    inner = F.when(fit["family"] == "SU", F.asinh(off / fit["lambda"])).when((fit["family"] == "SL") & (off > 0), F.log(off)).when((fit["family"] == "SB") & (off > 0) & (left > 0), F.log(off / left))
    return fit["gamma"] + fit["eta"] * inner


def inverse_column(z: Column, fit: Column) -> Column:
    """The value whose z it is."""
    scaled = (z - fit["gamma"]) / fit["eta"]
    inner = F.when(fit["family"] == "SU", fit["lambda"] * F.sinh(scaled)).when(fit["family"] == "SL", F.exp(scaled)).otherwise(fit["lambda"] / (1 + F.exp(-scaled)))
    return fit["epsilon"] + inner


def normal_p(a2: float, n: float) -> tuple[float, float]:
    """(adjusted A squared, Stephens' p) against a fitted normal distribution. Fixed values in the exponents."""
    a = a2 * (1 + 0.75 / n + 2.25 / n**2)
    if a > 0.6:
        return a, math.exp(1.2937 - 5.709 * a + 0.0186 * a * a) if a < 150 else 0.0
    if a > 0.34:
        return a, math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    return a, 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a if a > 0.2 else -13.436 + 101.14 * a - 223.73 * a * a)


def _log_cdf(z: np.ndarray) -> np.ndarray:
    half = np.array([math.erfc(v) for v in (-z / math.sqrt(2)).tolist()])
    with np.errstate(divide="ignore"):
        near = np.log(half / 2)
    far = z < -30
    if far.any():
        t = z[far]
        near[far] = -t * t / 2 - np.log(-t) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / t**2 + 3 / t**4)
    return near


def fit(df: DataFrame, value: str, by: list[str] | None = None, criterion: float = 0.10) -> DataFrame:
    """A row a series: n, found, the best curve, mean and deviation of its z, A squared adjusted and its p.

    found tells whether p passes the criterion. Nulls and values that are not finite are left out. A series of fewer
    than 8 values, one too short for the tails, or one whose quantiles give no curve, has nulls and found false.
    """
    by = by or []
    keys = "".join(f"`{c}` {t}, " for c, t in df.select(*by).dtypes)
    names = {f"q{k}_{j}": normal_cdf(f * z) for k, z in enumerate(TRIED) for j, f in enumerate((-3, -1, 1, 3))}
    finite = F.col(value).cast("double")
    finite = F.when((finite > float("-inf")) & (finite < float("inf")), finite)
    q = quantiles(df.withColumn("_value", finite).select(*by, "_value"), "_value", by, names)

    def curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                n, made = int(row["_n"]), []
                most = normal_quantile((n - 0.5) / n) / 3 if n >= FEWEST else 0.0
                for k, z in enumerate(TRIED):
                    if z <= most and (c := curve(z, tuple(row[f"q{k}_{j}"] for j in range(4)))):
                        made.append(c)
                out.append([*(row[c] for c in by), n, made])
            yield pd.DataFrame(out, columns=[*by, "_n", "_curves"])

    tried = written_rows(q.mapInPandas(curves, keys + f"_n long, _curves array<{CURVE}>"))
    values = value_blocks(df, value, by)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                x, c = np.asarray(row["_x"]), np.asarray(row["_c"], float)
                for k, one in enumerate(row["_curves"]):
                    z = transformed(x, one)
                    held = ~np.isnan(z)
                    below = float(c[x <= one["epsilon"]].sum()) if one["family"] != "SU" else 0.0
                    w, z = c[held], z[held]
                    out.append([*(row[b] for b in by), k, float(w.sum()), float(w @ z), float(w @ (z * z)), below])
            yield pd.DataFrame(out, columns=[*by, "_k", "m", "s", "ss", "below"])

    own = with_levels(values, tried, by)
    sums = own.mapInPandas(moments, keys + "_k int, m double, s double, ss double, below double").groupBy(*by, "_k").agg(*[F.sum(c).alias(c) for c in ("m", "s", "ss", "below")])
    mean = F.col("s") / F.col("m")
    sums = sums.where("m > 1").select(*by, F.struct("_k", "m", "below", mean.alias("mean"), F.sqrt(F.greatest((F.col("ss") - F.col("m") * mean * mean) / (F.col("m") - 1), F.lit(0.0))).alias("stdev")).alias("_s"))
    stats = written_rows(sums.groupBy(*by).agg(F.sort_array(F.collect_list("_s")).alias("_stats")))  # a few curves a series

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                x, c, u = (np.asarray(row[k], float) for k in ("_x", "_c", "_u"))
                for s in row["_stats"]:
                    z = transformed(x, row["_curves"][s["_k"]])
                    held = ~np.isnan(z)
                    if not s["stdev"] > 0 or not held.any():
                        continue
                    y, w, at = (z[held] - s["mean"]) / s["stdev"], c[held], u[held] - s["below"]
                    place = w * (2 * at - w + 1) / 2
                    total = (2 * place - w) @ _log_cdf(y) + (2 * (s["m"] * w - place) + w) @ _log_cdf(-y)
                    out.append([*(row[b] for b in by), int(s["_k"]), float(total)])
            yield pd.DataFrame(out, columns=[*by, "_k", "_t"])

    terms = with_levels(own, stats, by).mapInPandas(places, keys + "_k int, _t double").groupBy(*by, "_k").agg(F.sum("_t").alias("_t"))
    terms = terms.groupBy(*by).agg(F.collect_list(F.struct("_k", "_t")).alias("_terms"))
    columns = [*by, *[x.split()[0] for x in FIT.split(", ")]]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                n, best = int(row["_n"]), None
                told = {t["_k"]: t["_t"] for t in row["_terms"]} if row["_terms"] is not None else {}
                for s in row["_stats"] if row["_stats"] is not None else []:
                    if s["_k"] in told and s["m"] >= round(LEAST_HELD * n):
                        a, p = normal_p(-s["m"] - told[s["_k"]] / s["m"], s["m"])
                        if best is None or p > best[1]:
                            best = a, p, s
                if best is None or not best[1] > 0:
                    out.append([*(row[b] for b in by), n, False, *[None] * 10])
                    continue
                a, p, s = best
                c = row["_curves"][s["_k"]]
                out.append([*(row[b] for b in by), n, p > criterion, *(c[k] for k in ("z", "family", "gamma", "eta", "lambda", "epsilon")), s["mean"], s["stdev"], a, p])
            yield pd.DataFrame(out, columns=columns)

    return with_levels(with_levels(tried, stats, by, how="left"), terms, by, how="left").mapInPandas(choose, keys + FIT)


def apply(df: DataFrame, value: str, fits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df with the column johnson: each value's z by the curve of its series; null without one or outside its support."""
    by = by or []
    one = fits.select(*by, F.struct("family", "gamma", "eta", "lambda", "epsilon").alias("_fit"))
    return with_levels(df, one, by, how="left").withColumn("johnson", transform_column(F.col(value), F.col("_fit"))).drop("_fit")


def capability(df: DataFrame, value: str, lsl: float | None, usl: float | None, by: list[str] | None = None, criterion: float = 0.10) -> DataFrame:
    """A row a series: the fit, limits by its curve, overall Pp, Ppl, Ppu, Ppk of the z, and observed parts per million.

    A limit outside the curve's support, or one that is not given, counts as none; Pp needs both. Without a curve that
    passes the criterion, or without any limit left, all indices are null and `reason` tells why.
    """
    by = by or []
    x = F.col(value).cast("double")
    seen = df.where((x > float("-inf")) & (x < float("inf"))).groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("_low", x < lsl if lsl is not None else F.lit(False)), ("_high", x > usl if usl is not None else F.lit(False)))])
    fits = with_levels(fit(df, value, by, criterion), seen, by).withColumn("_fit", F.struct("family", "gamma", "eta", "lambda", "epsilon"))
    limit = lambda v: F.when(F.col("found"), transform_column(F.lit(None if v is None else float(v)), F.col("_fit")))
    fits = fits.withColumns({"lsl_z": limit(lsl), "usl_z": limit(usl)})
    low, high = (F.col("mean") - F.col("lsl_z")) / (3 * F.col("stdev")), (F.col("usl_z") - F.col("mean")) / (3 * F.col("stdev"))
    both = F.col("lsl_z").isNull() & F.col("usl_z").isNull()
    reason = F.when(~F.col("found"), "no curve passes the criterion").when(both, "limits outside the support")
    return fits.select(
        *by, "n", "found", "family", "p_value", "lsl_z", "usl_z", ((F.col("usl_z") - F.col("lsl_z")) / (6 * F.col("stdev"))).alias("pp"), low.alias("ppl"), high.alias("ppu"), F.least(low, high).alias("ppk"),
        (1e6 * F.col("_low") / F.col("n")).alias("ppm_below"), (1e6 * F.col("_high") / F.col("n")).alias("ppm_above"), reason.alias("reason"),
    )
