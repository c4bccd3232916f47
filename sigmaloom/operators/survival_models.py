"""Further life models: Cox regression, lognormal life, K-group log-rank, per-mode fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_right, normal_cdf, normal_cdf_col, normal_quantile
from ..plans.ordered import running
from .reliability import risk_table, weibull


def cox(df: DataFrame, time: str, event: Column, covariates: list[str], confidence: float = 0.95, rounds: int = 25) -> DataFrame:
    """Cox regression with Breslow's ties by Newton steps.

    A step sums exp(xb), x exp(xb) and xx exp(xb) by distinct time in one grouping, then from the last time
    back over parts of the time axis: risk sets never hold rows.
    """
    p = len(covariates)
    rows = df.where(F.col(time).isNotNull()).select(F.col(time).cast("double").alias("t"), event.alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).where("e is not null")
    rows = rows.where(" and ".join(f"x{i} is not null" for i in range(p)))
    means = rows.agg(*[F.avg(f"x{i}") for i in range(p)]).first()
    rows = rows.withColumns({f"x{i}": F.col(f"x{i}") - float(means[i]) for i in range(p)})
    beta, pairs = np.zeros(p), [(i, j) for i in range(p) for j in range(i, p)]
    like = 0.0
    for _ in range(rounds):
        eta = sum((float(b) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        w = F.exp(eta)
        sums = {"s": w, **{f"s{i}": w * F.col(f"x{i}") for i in range(p)}, **{f"q{i}_{j}": w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
        at = rows.groupBy("t").agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.count_if("e").alias("d"), F.sum(F.when(F.col("e"), eta).otherwise(0.0)).alias("de"), *[F.sum(F.when(F.col("e"), F.col(f"x{i}")).otherwise(0.0)).alias(f"d{i}") for i in range(p)])
        risk = running(at, [], [F.desc("t")], {f"r_{k}": F.col(k) for k in sums}).select("d", "de", *[f"d{i}" for i in range(p)], *[F.col(f"r_{k}").alias(k) for k in sums]).where("d > 0")
        m = lambda i: F.col(f"s{i}") / F.col("s")
        out = risk.agg(
            F.sum(F.col("de") - F.col("d") * F.log("s")), *[F.sum(F.col(f"d{i}") - F.col("d") * m(i)) for i in range(p)],
            *[F.sum(F.col("d") * (F.col(f"q{i}_{j}") / F.col("s") - m(i) * m(j))) for i, j in pairs],
        ).first()
        if out[0] is None:
            return df.sparkSession.createDataFrame([], "term string, coefficient double, se double, z double, p_value double, hazard_ratio double, low double, high double, log_likelihood double")
        like, score, info = float(out[0]), np.array(out[1 : p + 1], float), np.zeros((p, p))
        for k, (i, j) in enumerate(pairs):
            info[i, j] = info[j, i] = out[p + 1 + k]
        step = np.linalg.solve(info, score)
        if np.abs(step).max() < 1e-9:
            break
        beta = beta + step
    cov, q, table = np.linalg.inv(info), normal_quantile(1 - (1 - confidence) / 2), []
    for i, c in enumerate(covariates):
        b, se = float(beta[i]), math.sqrt(cov[i, i])
        table.append((c, b, se, b / se, 2 * normal_cdf(-abs(b / se)), math.exp(b), math.exp(b - q * se), math.exp(b + q * se), like))
    return df.sparkSession.createDataFrame(table, "term string, coefficient double, se double, z double, p_value double, hazard_ratio double, low double, high double, log_likelihood double")


def log_rank_groups(df: DataFrame, time: str, event: Column, group: str) -> DataFrame:
    """Observed and expected events of every group, from the risk sets at every distinct time of any group."""
    t = risk_table(df.where(F.col(group).isNotNull()), time, event, [group])
    groups = t.select(group).distinct()
    total = risk_table(df.where(F.col(group).isNotNull()), time, event).select("time", F.col("events").alias("d"), F.col("at_risk").alias("n"))
    grid = total.crossJoin(F.broadcast(groups)).join(t, ["time", group], "left")  # distinct times x groups
    grid = running(grid, [group], [F.desc("time")], {"own": F.coalesce(F.col("events") + F.col("censored"), F.lit(0))})
    return grid.groupBy(group).agg(F.sum(F.coalesce("events", F.lit(0))).alias("observed"), F.sum(F.col("d") * F.col("own") / F.col("n")).alias("expected"))


def lognormal(df: DataFrame, time: str, event: Column, rounds: int = 40) -> DataFrame:
    """Location and scale of a lognormal life, right-censored, by Newton steps over counts of distinct times."""
    rows = df.where(F.col(time) > 0).select(F.log(F.col(time).cast("double")).alias("l"), event.alias("e")).where("e is not null")
    c = rows.groupBy("l", "e").agg(F.count("*").alias("n")).cache()
    n, l_ = F.col("n"), F.col("l")
    start = c.agg(F.sum(n * l_) / F.sum(n), F.sum(n * l_**2) / F.sum(n), F.sum(n), F.sum(F.when(F.col("e"), n).otherwise(0))).first()
    if not start[2] or not start[3]:
        return df.sparkSession.createDataFrame([], "location double, scale double, events long, n long")
    mu, log_s = start[0], 0.5 * math.log(max(start[1] - start[0] ** 2, 1e-12))
    for _ in range(rounds):
        s, z = math.exp(log_s), (l_ - mu) / math.exp(log_s)
        h = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / F.greatest(normal_cdf_col(-z), F.lit(1e-300))
        d = h * (h - z)
        one = lambda seen, left: F.sum(n * F.when(F.col("e"), seen).otherwise(left))
        g1, g2, a, b, q = c.agg(one(z / s, h / s), one(z * z - 1, h * z), one(F.lit(1 / s**2), d / s**2), one(2 * z / s, (h + z * d) / s), one(2 * z * z, z * h + z * z * d)).first()
        step = np.linalg.solve(np.array([[a, b], [b, q]], float), np.array([g1, g2], float))
        step /= max(1.0, float(np.abs(step).max()))
        mu, log_s = mu + float(step[0]), log_s + float(step[1])
        if float(np.abs(step).max()) < 1e-9:
            break
    c.unpersist()
    return df.sparkSession.createDataFrame([(mu, math.exp(log_s), int(start[3]), int(start[2]))], "location double, scale double, events long, n long")


def weibull_by_mode(df: DataFrame, time: str, mode: Column, modes: list[str]) -> DataFrame:
    """A Weibull life of each failure mode, rows of other modes censored."""
    out = None
    for m in modes:
        one = weibull(df.withColumn("_mode", mode.cast("string")), time, F.coalesce(F.col("_mode") == m, F.lit(False))).withColumn("mode", F.lit(m))
        out = one if out is None else out.union(one)
    return out


def chi_square_of(table: DataFrame) -> float:
    """Conservative log-rank chi-square of observed and expected, and nothing else, on the driver (a row a group)."""
    rows = table.collect()
    return sum((r.observed - r.expected) ** 2 / r.expected for r in rows if r.expected)


def conservative_p(table: DataFrame) -> float:
    return chi2_right(chi_square_of(table), max(1, table.count() - 1))
