"""Competing risks: Fine and Gray's regression and Gray's test of K groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_right, normal_cdf, normal_quantile
from ..plans.ordered import dealt_by, running, running_in, written_rows

FEWEST, LEAST_EVENTS, MOST_GROUPS = 10, 2, 64
TERMS = "term string, coefficient double, se double, z double, p_value double, hazard_ratio double, low double, high double, n long, events long, competing long, converged boolean"


def _statuses(df: DataFrame, time: str, mode: Column, target: str) -> DataFrame:
    """df with _t and _e: 1 the target, 2 another mode, 0 (null mode) censored; rows without a time of 0 or more are left out."""
    t = F.col(time).cast("double")
    m = mode.cast("string")
    return df.withColumns({"_t": t, "_e": F.when(m.isNull(), 0).when(m == target, 1).otherwise(2)}).where((t >= 0) & (t < float("inf")))


def fine_gray(df: DataFrame, time: str, mode: Column, target: str, covariates: list[str], confidence: float = 0.95, rounds: int = 50) -> DataFrame:
    """A row a covariate: the log ratio of subdistribution hazards of the target mode, its error and limits.

    mode is null for a censored row. A row that failed of another mode stays at risk with the weight of the censoring
    curve before a time over that before its own. Rows are counted by distinct time, mode and covariates and dealt by
    time once; a Newton step sums exponentials by time, then two ways along the times: risk sets from a time on, and
    weighted rows of other modes before it. Errors come from the information. Rows without a covariate are left out.
    Fewer than 10 rows or 2 target failures, or a covariate of one value, give no row.
    """
    p = len(covariates)
    xs = [f"_x{i}" for i in range(p)]
    rows = _statuses(df, time, mode, target).select("_t", "_e", *[F.col(c).cast("double").alias(x) for c, x in zip(covariates, xs, strict=True)]).dropna()
    facts = rows.agg(F.count("*"), F.count_if(F.col("_e") == 1), F.count_if(F.col("_e") == 2), *[f(x) for x in xs for f in (F.avg, F.min, F.max)]).first()
    n, events, others = facts[:3]
    if n < FEWEST or events < LEAST_EVENTS or any(not facts[3 + 3 * i + 2] > facts[3 + 3 * i + 1] for i in range(p)):
        return df.sparkSession.createDataFrame([], TERMS)
    rows = rows.withColumns({x: F.col(x) - float(facts[3 + 3 * i]) for i, x in enumerate(xs)})
    counts = dealt_by(rows.groupBy("_t", "_e", *xs).agg(F.count("*").alias("n")), ["_t"])
    times = counts.groupBy("_part", "_t").agg(F.sum("n").alias("m"), F.sum(F.when(F.col("_e") == 0, F.col("n")).otherwise(0)).alias("c"))
    times = running_in(times, ["_t"], back={"risk": F.col("m")})
    own = F.when(F.col("c") < F.col("risk"), F.log(1 - F.col("c") / F.col("risk"))).otherwise(math.log(1e-12))
    curve = running_in(times.withColumn("_l", own), ["_t"], {"g": F.col("_l")}).select("_t", F.greatest(F.exp(F.col("g") - F.col("_l")), F.lit(1e-12)).alias("g"))
    counts = written_rows(counts.join(curve, "_t"))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    beta, info, converged = np.zeros(p), np.eye(p), False
    for _ in range(rounds):
        e = F.col("n") * F.exp(sum((float(b) * F.col(x) for b, x in zip(beta, xs, strict=True)), F.lit(0.0)))
        terms = {"s": e, **{f"s{i}": e * F.col(x) for i, x in enumerate(xs)}, **{f"q{i}_{j}": e * F.col(xs[i]) * F.col(xs[j]) for i, j in pairs}}
        is_target, is_other = F.col("_e") == 1, F.col("_e") == 2
        at = counts.groupBy("_part", "_t", "g").agg(
            *[F.sum(c).alias(f"r_{k}") for k, c in terms.items()], *[F.sum(F.when(is_other, c / F.col("g")).otherwise(0.0)).alias(f"w_{k}") for k, c in terms.items()],
            F.sum(F.when(is_target, F.col("n")).otherwise(0)).alias("d"), *[F.sum(F.when(is_target, F.col("n") * F.col(x)).otherwise(0.0)).alias(f"d{i}") for i, x in enumerate(xs)],
        )
        risk = running_in(at, ["_t"], {f"u_{k}": F.col(f"w_{k}") for k in terms}, {f"b_{k}": F.col(f"r_{k}") for k in terms}).where("d > 0")
        risk = risk.select("d", *[f"d{i}" for i in range(p)], *[(F.col(f"b_{k}") + F.col("g") * (F.col(f"u_{k}") - F.col(f"w_{k}"))).alias(k) for k in terms])
        mean = lambda i: F.col(f"s{i}") / F.col("s")
        out = risk.agg(*[F.sum(F.col(f"d{i}") - F.col("d") * mean(i)) for i in range(p)], *[F.sum(F.col("d") * (F.col(f"q{i}_{j}") / F.col("s") - mean(i) * mean(j))) for i, j in pairs]).first()
        score = np.array(out[:p], float)
        for k, (i, j) in enumerate(pairs):
            info[i, j] = info[j, i] = out[p + k]
        if converged:  # the information at the last step
            break
        step, *_ = np.linalg.lstsq(info, score, rcond=None)
        beta = beta + step
        converged = bool(np.abs(step).max() < 1e-8)
        if np.abs(beta).max() > 20:
            converged = False
            break
    errors, q, table = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0.0)), normal_quantile(1 - (1 - confidence) / 2), []
    for c, b, se in zip(covariates, beta.tolist(), errors.tolist(), strict=True):
        z = b / se if se else math.nan
        table.append((c, b, se, z, 2 * normal_cdf(-abs(z)), math.exp(b), math.exp(b - q * se), math.exp(b + q * se), n, events, others, converged))
    return df.sparkSession.createDataFrame(table, TERMS)


def _before(parts: dict[int, np.ndarray], start, step, backwards: bool = False) -> dict[int, np.ndarray]:
    """What each part begins with, from the parts ahead of it (or behind it)."""
    out, now = {}, start
    for k in sorted(parts, reverse=backwards):
        out[k] = now
        now = step(now, parts[k])
    return out


class _Times:
    """Failures and leavers of K groups at the distinct times of one part, and what follows from its start values."""

    def __init__(self, row: dict, given: dict):
        self.d1, self.d2, self.m = (np.array([list(v) for v in row[k]], float) for k in ("_d1", "_d2", "_m"))
        self.at_risk = given["risk"] - np.cumsum(self.m, axis=0) + self.m
        with np.errstate(invalid="ignore", divide="ignore"):
            self.leave = np.where(self.at_risk > 0, (self.d1 + self.d2) / self.at_risk, 0.0)
            self.first = np.where(self.at_risk > 0, self.d1 / self.at_risk, 0.0)
        product = np.cumprod(1 - self.leave, axis=0)
        self.survival_after = product[-1]
        before = np.vstack([np.ones(product.shape[1]), product[:-1]])
        self.incidence_after = (before * self.first).sum(axis=0)
        if "survival" not in given:
            return
        self.s = given["survival"] * before  # just before a time, as all below but `f`
        self.f = given["incidence"] + given["survival"] * np.cumsum(before * self.first, axis=0)
        self.rest = 1 - (self.f - self.s * self.first)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.r = np.where((self.at_risk > 0) & (self.s > 0), self.at_risk * self.rest / self.s, 0.0)
            total = self.r.sum(axis=1)
            self.hazard = np.where(total > 0, self.d1.sum(axis=1) / total, 0.0)
            share = np.where(total[:, None] > 0, self.r / total[:, None], 0.0)
        self.score = (self.d1 - self.r * self.hazard[:, None]).sum(axis=0)
        self.expected = (self.r * self.hazard[:, None]).sum(axis=0)
        self.spread = self.r[:, :, None] * (np.eye(self.r.shape[1])[None] - share[:, None, :])  # time, k, r
        pooled = np.cumprod(1 - np.minimum(self.hazard, 1 - 1e-12))
        self.pooled_after = pooled[-1]
        if "pooled" in given:
            rest = given["pooled"] * np.concatenate([[1.0], pooled[:-1]])
            self.steps = self.spread * (self.hazard / rest)[:, None, None]


def gray_test(df: DataFrame, time: str, mode: Column, target: str, group: str, rows: int = 20_000) -> DataFrame:
    """A row a group: n, observed and expected failures of the target mode, and chi-square, df and p of equal incidence.

    Gray's K-sample score process with weight one: each group's risk set is at_risk (1 - incidence) / survival, the
    expected failures its share of all. The covariance is that of the scores' linear form in the groups' counting
    processes. mode is null for a censored row; rows without a group are left out, and so are groups in which nothing
    fails of the target from the chi-square's rank alone. At most 64 groups; fewer than two give no row. Distinct times
    are taken in parts of `rows`; what goes from part to part is a few numbers a part.
    """
    schema = f"`{group}` {dict(df.dtypes)[group]}, n long, observed long, expected double, chi_square double, df int, p_value double"
    held = _statuses(df, time, mode, target).where(F.col(group).isNotNull()).withColumn("_g", F.col(group))
    counts = held.groupBy("_t", "_g").agg(*[F.count_if(F.col("_e") == k).alias(f"e{k}") for k in (0, 1, 2)])
    sizes = counts.groupBy("_g").agg(F.sum(F.col("e0") + F.col("e1") + F.col("e2")).alias("n"), F.sum("e1").alias("d")).limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    sizes = sorted(sizes, key=lambda r: r["_g"])
    if len(sizes) < 2:
        return df.sparkSession.createDataFrame([], schema)
    groups, n_groups = [r["_g"] for r in sizes], len(sizes)
    of = lambda c: F.array(*[F.sum(F.when(F.col("_g") == g, c).otherwise(0)) for g in groups])
    times = counts.groupBy("_t").agg(of(F.col("e1")).alias("d1"), of(F.col("e2")).alias("d2"), of(F.col("e0") + F.col("e1") + F.col("e2")).alias("m"))
    times = running(times, [], ["_t"], {"_i": F.lit(1)}).groupBy(F.floor((F.col("_i") - 1) / rows).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_t", "d1", "d2", "m"))).alias("_v"))
    times = written_rows(times.select("_part", F.col("_v.d1").alias("_d1"), F.col("_v.d2").alias("_d2"), F.col("_v.m").alias("_m")))
    given: dict[int, dict] = {}

    def over(what) -> dict[int, np.ndarray]:
        """what(times) of every part, an array each."""
        known = dict(given)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    yield pd.DataFrame({"k": [int(row["_part"])], "v": [np.asarray(what(row, known.get(int(row["_part"]), {})), float).ravel()]})

        return {r["k"]: np.array(r["v"]) for r in times.mapInPandas(run, "k long, v array<double>").collect()}  # a row a part

    def give(name: str, values: dict) -> None:
        for k, v in values.items():
            given.setdefault(k, {})[name] = v

    leavers = over(lambda row, _: np.array([list(v) for v in row["_m"]], float).sum(axis=0))
    give("risk", {k: v + leavers[k] for k, v in _before(leavers, np.zeros(n_groups), np.add, backwards=True).items()})
    curves = over(lambda row, g: np.concatenate([(t := _Times(row, g)).survival_after, t.incidence_after]))
    start = _before(curves, np.concatenate([np.ones(n_groups), np.zeros(n_groups)]), lambda now, p: np.concatenate([now[:n_groups] * p[:n_groups], now[n_groups:] + now[:n_groups] * p[n_groups:]]))
    give("survival", {k: v[:n_groups] for k, v in start.items()})
    give("incidence", {k: v[n_groups:] for k, v in start.items()})
    scores = over(lambda row, g: np.concatenate([[(t := _Times(row, g)).pooled_after], t.score, t.expected]))
    give("pooled", _before({k: v[0] for k, v in scores.items()}, 1.0, lambda now, p: now * p))
    total = sum(scores.values())
    score, expected = total[1 : n_groups + 1], total[n_groups + 1 :]
    later = over(lambda row, g: _Times(row, g).steps.sum(axis=0))
    give("later", {k: v.reshape(n_groups, n_groups) for k, v in _before(later, np.zeros(n_groups * n_groups), np.add, backwards=True).items()})

    def products(row: dict, g: dict) -> np.ndarray:
        t = _Times(row, g)
        behind = g["later"] + np.cumsum(t.steps[::-1], axis=0)[::-1] - t.steps  # time, k, r: what is after the time
        with np.errstate(invalid="ignore", divide="ignore"):
            own = np.where(t.r > 0, t.at_risk / t.r, 0.0)
            first, other = (np.where(t.at_risk > 0, d / t.at_risk**2, 0.0) for d in (t.d1, t.d2))
        left = 1 - t.f
        a1 = t.spread * own[:, None, :] + behind * (t.s - left)[:, None, :]
        a2 = -behind * left[:, None, :]
        return np.einsum("tkr,tlr,tr->kl", a1, a1, first) + np.einsum("tkr,tlr,tr->kl", a2, a2, other)

    covariance = sum(over(products).values()).reshape(n_groups, n_groups)
    rank = n_groups - 1
    chi = float(score @ np.linalg.pinv(covariance, rcond=1e-9, hermitian=True) @ score)
    p = chi2_right(chi, rank) if sum(r["d"] for r in sizes) else None
    return df.sparkSession.createDataFrame([(g, r["n"], r["d"], float(x), chi if p is not None else None, rank, p) for g, r, x in zip(groups, sizes, expected, strict=True)], schema)
