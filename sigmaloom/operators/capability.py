"""Process capability: indices from one aggregation, exact intervals and rates through special functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import beta_quantile_col, chi2_quantile_col, normal_cdf_col, normal_quantile, normal_quantile_col
from ..plans.ordered import in_blocks, quantiles, with_levels
from .spc import d2, within_sigma


def indices(mean: Column, within: Column, overall: Column, lsl: float | None, usl: float | None, target: float | None = None) -> dict[str, Column]:
    """Cp, CPL, CPU, Cpk by the within sigma, Pp, PPL, PPU, Ppk by the overall one, Cpm against a target."""
    def family(s: Column, names: tuple[str, ...]) -> dict[str, Column]:
        two, low, high, k = names
        lower = (mean - lsl) / (3 * s) if lsl is not None else F.lit(None).cast("double")
        upper = (usl - mean) / (3 * s) if usl is not None else F.lit(None).cast("double")
        both = (usl - lsl) / (6 * s) if lsl is not None and usl is not None else F.lit(None).cast("double")
        return {two: both, low: lower, high: upper, k: F.least(lower, upper)}

    out = family(within, ("cp", "cpl", "cpu", "cpk")) | family(overall, ("pp", "ppl", "ppu", "ppk"))
    if target is not None and lsl is not None and usl is not None:
        out["cpm"] = (usl - lsl) / (6 * F.sqrt(overall**2 + (mean - target) ** 2))
    return out


def normal_capability(df: DataFrame, value: str, group: str, size: int, lsl: float | None, usl: float | None, target: float | None = None) -> DataFrame:
    """Indices of all values, sigma within from the subgroups of `size`, and observed parts per million outside."""
    x = F.col(value)
    out = (x < lsl if lsl is not None else F.lit(False)) | (x > usl if usl is not None else F.lit(False))
    s = df.where(x.isNotNull()).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sigma_overall"), (1e6 * F.count_if(out) / F.count("*")).alias("observed_ppm"))
    s = s.crossJoin(within_sigma(df, value, group, size))
    return s.select("n", "mean", "sigma_within", "sigma_overall", "observed_ppm", *[c.alias(a) for a, c in indices(F.col("mean"), F.col("sigma_within"), F.col("sigma_overall"), lsl, usl, target).items()])


def with_expected_ppm(df: DataFrame, lsl: float | None, usl: float | None) -> DataFrame:
    """Parts per million a normal distribution puts outside, within and overall, and z.bench (the smaller z)."""
    for s in ("within", "overall"):
        low = normal_cdf_col((F.lit(lsl) - F.col("mean")) / F.col(f"sigma_{s}")) if lsl is not None else F.lit(0.0)
        high = normal_cdf_col((F.col("mean") - F.lit(usl)) / F.col(f"sigma_{s}")) if usl is not None else F.lit(0.0)
        df = df.withColumn(f"ppm_{s}", 1e6 * (low + high)).withColumn(f"z_bench_{s}", 3 * F.col("cpk" if s == "within" else "ppk"))
    return df


def with_index_intervals(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Chi-square limits of Pp and Bissell's limits of Ppk."""
    tail, d = (1 - confidence) / 2, F.col("n") - 1
    half = normal_quantile(1 - tail) * F.sqrt(1 / (9 * F.col("n")) + F.col("ppk") ** 2 / (2 * d))
    out = df.withColumn("pp_low", F.col("pp") * F.sqrt(chi2_quantile_col(tail, d) / d)).withColumn("pp_high", F.col("pp") * F.sqrt(chi2_quantile_col(1 - tail, d) / d))
    return out.withColumn("ppk_low", F.col("ppk") - half).withColumn("ppk_high", F.col("ppk") + half)


def between_within(df: DataFrame, value: str, group: str, size: int, lsl: float, usl: float) -> DataFrame:
    """sigma between from the moving range of subgroup means, and indices by the sum of both."""
    from .spc import imr_rs

    s = imr_rs(df, value, group, size)
    return s.select("n_subgroups", "sigma_within", "sigma_between", "sigma_total", *[c.alias(a) for a, c in indices(F.col("centre"), F.col("sigma_total"), F.col("sigma_total"), lsl, usl).items() if a in ("cp", "cpk")])


def batch_capability(df: DataFrame, value: str, batch: str, lsl: float, usl: float, least: int = 2) -> DataFrame:
    """Indices by batch; a batch's own deviation stands for both sigmas, batches of fewer values are left out."""
    s = df.where(F.col(value).isNotNull()).groupBy(batch).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    s = s.where((F.col("n") >= max(2, least)) & (F.col("s") > 0))
    return s.select(batch, "n", "mean", "s", *[c.alias(a) for a, c in indices(F.col("mean"), F.col("s"), F.col("s"), lsl, usl).items() if a in ("cp", "cpk", "pp", "ppk")])


def nonparametric(df: DataFrame, value: str, lsl: float, usl: float, by: list[str] | None = None) -> DataFrame:
    """Cnp, Cnpl, Cnpu, Cnpk from the 0.135, 50 and 99.865 percentiles by the p(n+1) rule, of 10 values or more."""
    places = {"low": 0.00135, "median": 0.5, "high": 0.99865}
    q = quantiles(df, value, by, places, rule="n+1").withColumnRenamed("_n", "n").where("n >= 10")
    lower, upper = (F.col("median") - lsl) / (F.col("median") - F.col("low")), (usl - F.col("median")) / (F.col("high") - F.col("median"))
    return q.select("*", ((usl - lsl) / (F.col("high") - F.col("low"))).alias("cnp"), lower.alias("cnpl"), upper.alias("cnpu"), F.least(lower, upper).alias("cnpk"))


def box_cox(df: DataFrame, value: str, lambdas: tuple[float, float, float] = (-5.0, 5.0, 0.01)) -> DataFrame:
    """The deviation of the scaled transform at each power of a grid: a sum and a square sum a power over distinct values."""
    low, high, step = lambdas
    grid = [round(low + i * step, 10) for i in range(round((high - low) / step) + 1)]
    rows = df.where(F.col(value) > 0).select(F.log(F.col(value).cast("double")).alias("l"))
    centre = rows.agg(F.avg("l").alias("g")).first().g
    powers = np.array(grid)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(len(powers)), np.zeros(len(powers))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                off, c = part["l"].to_numpy()[:, None] - centre, part["c"].to_numpy(float)
                zero = powers == 0
                w = math.exp(centre) * np.where(zero, off, np.expm1(powers * off) / np.where(zero, 1.0, powers))
                n, s, ss = n + c.sum(), s + c @ w, ss + c @ (w * w)
        if n:
            yield pd.DataFrame({"power": powers, "n": n, "s": s, "ss": ss})

    counts = rows.groupBy("l").agg(F.count("*").alias("c"))
    parts = counts.mapInPandas(sums, "power double, n double, s double, ss double")  # a row a power and partition
    s = parts.groupBy("power").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    return s.select("power", F.sqrt((F.col("ss") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1)).alias("stdev"))


def box_cox_apply(value: Column, lam: float) -> Column:
    return F.log(value) if lam == 0 else (F.pow(value, F.lit(lam)) - 1) / lam


def binomial_capability(df: DataFrame, defectives: str, inspected: str, confidence: float = 0.95) -> DataFrame:
    """Share of defectives in percent with exact limits, parts per million and the process z."""
    tail = (1 - confidence) / 2
    s = df.agg(F.sum(defectives).alias("defectives"), F.sum(inspected).alias("inspected"))
    d, n = F.col("defectives"), F.col("inspected")
    p = d / n
    low = F.when(d == 0, 0.0).otherwise(beta_quantile_col(tail, F.greatest(d, F.lit(1)), n - d + 1))
    high = F.when(d == n, 1.0).otherwise(beta_quantile_col(1 - tail, d + 1, F.greatest(n - d, F.lit(1))))
    return s.select("defectives", "inspected", (100 * p).alias("percent"), (100 * low).alias("low"), (100 * high).alias("high"), (1e6 * p).alias("ppm"), (-normal_quantile_col(F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12)))).alias("process_z"))


def poisson_capability(df: DataFrame, defects: str, units: str | None = None, confidence: float = 0.95) -> DataFrame:
    """Defects a unit with Garwood's limits."""
    tail = (1 - confidence) / 2
    s = df.agg(F.sum(defects).alias("defects"), (F.sum(units) if units else F.count(defects)).alias("units"))
    d, u = F.col("defects"), F.col("units")
    low = F.when(d == 0, 0.0).otherwise(chi2_quantile_col(tail, 2 * F.greatest(d, F.lit(1))) / 2 / u)
    return s.select("defects", "units", (d / u).alias("dpu"), low.alias("low"), (chi2_quantile_col(1 - tail, 2 * (d + 1)) / 2 / u).alias("high"))


def stability(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Values beyond the limits of individuals, by series: a screen before capability is read."""
    rows = in_blocks(df.where(F.col(value).isNotNull()).select(*by, order, value), order, by, 1, 0, lambda w: {"_mr": F.abs(F.col(value) - F.lag(value).over(w))})
    limits = rows.groupBy(*by).agg(F.avg(value).alias("centre"), (F.avg("_mr") / d2(2)).alias("sigma"))
    return with_levels(rows, limits, by).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col(value) - F.col("centre")) > 3 * F.col("sigma")).alias("n_out"))
