"""Linear and generalised linear models from cross products that Spark sums; only p x p matrices reach the driver."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_right, f_right, normal_cdf, normal_cdf_col, normal_quantile, t_cdf, t_quantile
from ..plans.ordered import in_blocks


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]))


def gram(df: DataFrame, terms: list[Column], response: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'WX, X'Wy, y'Wy, n) in one aggregation; terms are X's columns."""
    w = weight if weight is not None else F.lit(1.0)
    k = len(terms)
    sums = [F.sum(w * terms[i] * terms[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * t * response) for t in terms] + [F.sum(w * response * response), F.count("*")]
    row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    m, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[at] or 0.0
            at += 1
    return m, np.array([row[at + i] or 0.0 for i in range(k)]), float(row[at + k] or 0.0), row[at + k + 1]


def _design(predictors: list[str]) -> list[Column]:
    return [F.lit(1.0)] + [F.col(p).cast("double") for p in predictors]


class Fit:
    """A least-squares fit from cross products; centred where there is an intercept, for accuracy."""

    def __init__(self, df: DataFrame, response: str, predictors: list[str]):
        self.names, self.response = ["constant", *predictors], response
        self.rows = complete(df, [response, *predictors])
        means = self.rows.agg(*[F.avg(c) for c in (response, *predictors)]).first()
        y0, x0 = float(means[0]), np.array(means[1:], float)
        off = [F.col(p).cast("double") - float(m) for p, m in zip(predictors, x0, strict=True)]
        self.sxx, sxy, self.sst, self.n = gram(self.rows, off, F.col(response).cast("double") - y0)
        self.sxy, self.x0, self.y0 = sxy, x0, y0
        self.inverse = np.linalg.inv(self.sxx)
        slopes = self.inverse @ sxy
        self.beta = np.append(y0 - slopes @ x0, slopes)
        self.sse = max(0.0, self.sst - float(slopes @ sxy))
        self.df = self.n - len(self.names)
        self.mse = self.sse / self.df if self.df > 0 else math.nan
        self.cov = np.zeros((len(self.names),) * 2)
        self.cov[1:, 1:] = self.mse * self.inverse
        self.cov[0, 1:] = self.cov[1:, 0] = -self.mse * self.inverse @ x0
        self.cov[0, 0] = self.mse * (1 / self.n + x0 @ self.inverse @ x0)

    @property
    def r2(self) -> float:
        return 1 - self.sse / self.sst if self.sst else math.nan


def linear_regression(df: DataFrame, response: str, predictors: list[str], confidence: float = 0.95) -> DataFrame:
    """Coefficients with errors, t, p, limits and variance inflation (centred), a row a term."""
    fit = Fit(df, response, predictors)
    q = t_quantile(1 - (1 - confidence) / 2, fit.df)
    rows = []
    for k, name in enumerate(fit.names):
        se = math.sqrt(fit.cov[k, k])
        t = float(fit.beta[k]) / se if se else math.nan
        vif = float(fit.sxx[k - 1, k - 1] * fit.inverse[k - 1, k - 1]) if k else None
        rows.append((name, float(fit.beta[k]), se, t, 2 * (1 - t_cdf(abs(t), fit.df)), float(fit.beta[k] - q * se), float(fit.beta[k] + q * se), vif))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, t double, p_value double, low double, high double, vif double")


def regression_summary(df: DataFrame, response: str, predictors: list[str]) -> DataFrame:
    """S, R squared (adjusted too), F and its p."""
    fit = Fit(df, response, predictors)
    k = len(predictors)
    f = (fit.sst - fit.sse) / k / fit.mse
    row = (fit.n, math.sqrt(fit.mse), fit.r2, 1 - (fit.sse / fit.df) / (fit.sst / (fit.n - 1)), float(fit.sst), float(fit.sse), f, f_right(f, k, fit.df))
    return df.sparkSession.createDataFrame([row], "n long, s double, r_squared double, r_squared_adjusted double, sst double, sse double, f double, p_value double")


def regression_diagnostics(df: DataFrame, response: str, predictors: list[str]) -> DataFrame:
    """df's complete rows with fitted, residual, leverage, standardised and deleted residual, Cook's distance and DFITS."""
    fit = Fit(df, response, predictors)
    off = [F.col(p).cast("double") - float(m) for p, m in zip(predictors, fit.x0, strict=True)]
    fitted = reduce(add, [float(b) * o for b, o in zip(fit.beta[1:], off, strict=True)], F.lit(fit.y0))
    h = reduce(add, [off[i] * off[j] * float(fit.inverse[i, j]) for i in range(len(off)) for j in range(len(off))], F.lit(1 / fit.n))
    p = len(fit.names)
    out = fit.rows.withColumn("fitted", fitted).withColumn("residual", F.col(response) - F.col("fitted")).withColumn("leverage", h)
    e, h = F.col("residual"), F.col("leverage")
    out = out.withColumn("standardised", e / F.sqrt(fit.mse * (1 - h)))
    r = F.col("standardised")
    deleted = r * F.sqrt((fit.df - 1) / (fit.df - r * r))
    return out.withColumn("deleted", deleted).withColumn("cook", r * r * h / ((1 - h) * p)).withColumn("dfits", F.col("deleted") * F.sqrt(h / (1 - h)))


def durbin_watson(rows: DataFrame, residual: str, order: str, by: list[str]) -> DataFrame:
    step = in_blocks(rows.select(*by, order, residual), order, by, 1, 0, lambda w: {"_d": F.col(residual) - F.lag(residual).over(w)})
    return step.groupBy(*by).agg((F.sum(F.col("_d") ** 2) / F.sum(F.col(residual) ** 2)).alias("durbin_watson"))


def _subset(fit: Fit, keep: list[int]) -> tuple[float, np.ndarray]:
    if not keep:
        return fit.sst, np.zeros(0)
    inverse = np.linalg.inv(fit.sxx[np.ix_(keep, keep)])
    b = inverse @ fit.sxy[keep]
    return max(0.0, fit.sst - float(b @ fit.sxy[keep])), inverse


def best_subsets(df: DataFrame, response: str, predictors: list[str], models: int = 2) -> DataFrame:
    """The best models of each size by R squared, with the adjusted one and Mallows' Cp, from one set of cross products."""
    fit, rows = Fit(df, response, predictors), []
    for k in range(1, len(predictors) + 1):
        found = []
        for keep in combinations(range(len(predictors)), k):
            sse, _ = _subset(fit, list(keep))
            found.append((k, " ".join(predictors[i] for i in keep), 1 - sse / fit.sst, 1 - sse / (fit.n - k - 1) / (fit.sst / (fit.n - 1)), sse / fit.mse - (fit.n - 2 * (k + 1))))
        rows += sorted(found, key=lambda r: (-r[2], r[1]))[:models]
    return df.sparkSession.createDataFrame(rows, "size int, terms string, r_squared double, r_squared_adjusted double, cp double")


def stepwise(df: DataFrame, response: str, predictors: list[str], enter: float = 0.15, remove: float = 0.15) -> DataFrame:
    """Steps of entering the least p below enter and leaving the greatest above remove, from one set of cross products."""
    fit = Fit(df, response, predictors)
    chosen: list[int] = []
    steps = []

    def p_of(k: int, keep: list[int]) -> float:
        sse, inverse = _subset(fit, keep)
        d = fit.n - len(keep) - 1
        b = (inverse @ fit.sxy[keep])[keep.index(k)]
        return float(2 * (1 - t_cdf(abs(b / math.sqrt(sse / d * inverse[keep.index(k), keep.index(k)])), d)))

    for step in range(1, 2 * len(predictors) + 1):
        options = sorted((p_of(k, sorted([*chosen, k])), k) for k in range(len(predictors)) if k not in chosen)
        if options and options[0][0] <= enter:
            p, k = options[0]
            chosen = sorted([*chosen, k])
            steps.append((step, "enter", predictors[k], p, 1 - _subset(fit, chosen)[0] / fit.sst))
            continue
        worst = max(((p_of(k, chosen), k) for k in chosen), default=(0.0, -1))
        if worst[0] <= remove:
            break
        chosen.remove(worst[1])
        steps.append((step, "remove", predictors[worst[1]], worst[0], 1 - _subset(fit, chosen)[0] / fit.sst))
    return df.sparkSession.createDataFrame(steps, "step int, action string, term string, p_value double, r_squared double")


def glm(df: DataFrame, response: Column, predictors: list[str], family: str, confidence: float = 0.95, rounds: int = 25) -> DataFrame:
    """Logistic (binomial) or Poisson regression by reweighted least squares: one aggregation a round.

    Coefficients with errors, z, p, limits and exp(coefficient).
    """
    names = ["constant", *predictors]
    rows = complete(df, predictors).where(response.isNotNull()).select(response.cast("double").alias("_y"), *[F.col(p).cast("double").alias(p) for p in predictors])
    terms, beta = _design(predictors), np.zeros(len(names))
    mean = rows.agg(F.avg("_y")).first()[0]
    beta[0] = math.log(mean) if family == "poisson" else math.log(mean / (1 - mean))
    for _ in range(rounds):
        eta = reduce(add, [float(b) * t for b, t in zip(beta, terms, strict=True)])
        mu = F.exp(eta) if family == "poisson" else 1 / (1 + F.exp(-eta))
        w = mu if family == "poisson" else mu * (1 - mu)
        m, score, _, n = gram(rows.withColumn("_mu", mu).withColumn("_w", w), terms, (F.col("_y") - F.col("_mu")) / F.col("_w"), F.col("_w"))
        step = np.linalg.solve(m, score)
        beta = beta + step
        if np.abs(step).max() < 1e-10 * (1 + np.abs(beta).max()):
            break
    cov, q, out = np.linalg.inv(m), normal_quantile(1 - (1 - confidence) / 2), []
    for k, name in enumerate(names):
        se, b = math.sqrt(cov[k, k]), float(beta[k])
        out.append((name, b, se, b / se, 2 * normal_cdf(-abs(b / se)), b - q * se, b + q * se, math.exp(min(b, 700))))
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, se double, z double, p_value double, low double, high double, ratio double")


def logistic_stepwise(df: DataFrame, response: Column, predictors: list[str], enter: float = 0.15, remove: float = 0.15, rounds: int = 25) -> DataFrame:
    """Steps of entering the predictor of the least score-test p below enter and leaving that of the greatest Wald p above remove.

    Every Newton round is one aggregation of cross products of all predictors, in the model or not, so the last round of
    a fit also has the score statistics of all candidates. Rows without some predictor or the response are left out of
    every step. A row a step: step, action, term, p_value, and the log-likelihood after it.
    """
    rows = complete(df, predictors).where(response.isNotNull()).select(response.cast("double").alias("_y"), *[F.col(p).cast("double").alias(p) for p in predictors])
    n, mean, *moments = rows.agg(F.count("*"), F.avg("_y"), *[f(p) for p in predictors for f in (F.avg, F.stddev_samp)]).first()
    schema = "step int, action string, term string, p_value double, log_likelihood double"
    if not n or not 0 < mean < 1:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.withColumns({p: (F.col(p) - float(moments[2 * k])) / float(moments[2 * k + 1] or 1.0) for k, p in enumerate(predictors)})  # p values do not depend on units
    terms, beta = _design(predictors), np.zeros(len(predictors) + 1)
    beta[0] = math.log(mean / (1 - mean))

    def fitted(keep: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        """(cross products, scores, log-likelihood) of all terms at the best coefficients of those in keep."""
        beta[[k for k in range(len(beta)) if k not in keep]] = 0.0
        for _ in range(rounds):
            eta = reduce(add, [float(b) * t for b, t in zip(beta, terms, strict=True)])
            mu = 1 / (1 + F.exp(-eta))
            held = rows.withColumns({"_mu": mu, "_w": F.greatest(mu * (1 - mu), F.lit(1e-12)), "_eta": eta})
            m, score, _, _ = gram(held, terms, (F.col("_y") - F.col("_mu")) / F.col("_w"), F.col("_w"))
            step = np.linalg.lstsq(m[np.ix_(keep, keep)], score[keep], rcond=None)[0]
            if np.abs(step).max() < 1e-9 * (1 + np.abs(beta).max()):
                break
            beta[keep] += step
        like = held.agg(F.sum(F.col("_y") * F.col("_eta") - F.greatest(F.col("_eta"), F.lit(0.0)) - F.log1p(F.exp(-F.abs(F.col("_eta")))))).first()[0]
        return m, score, float(like)

    chosen, steps, seen = [0], [], set()
    m, score, _ = fitted(chosen)
    for step in range(1, 2 * len(predictors) + 1):
        inner = np.linalg.pinv(m[np.ix_(chosen, chosen)])
        options = []
        for k in (k for k in range(1, len(beta)) if k not in chosen):
            left = m[k, k] - m[k, chosen] @ inner @ m[chosen, k]
            if left > 1e-9 * m[k, k]:
                options.append((chi2_right(float(score[k] ** 2 / left), 1), k))
        p, k = min(options, default=(1.0, -1))
        action = "enter" if k > 0 and p <= enter else "remove"
        if action == "remove":
            wald = [(chi2_right(float(beta[c] ** 2 / inner[j, j]), 1), c) for j, c in enumerate(chosen) if c]
            p, k = max(wald, default=(0.0, -1))
            if k < 0 or p <= remove:
                break
        chosen = sorted([*chosen, k]) if action == "enter" else [c for c in chosen if c != k]
        m, score, like = fitted(chosen)
        steps.append((step, action, predictors[k - 1], float(p), like))
        if tuple(chosen) in seen:  # a term that enters and leaves in turn
            break
        seen.add(tuple(chosen))
    return df.sparkSession.createDataFrame(steps, schema)


def glm_scores(df: DataFrame, coefficients: dict[str, float], family: str) -> DataFrame:
    """df with `predicted`, the mean of a fitted model."""
    eta = reduce(add, [b * (F.lit(1.0) if t == "constant" else F.col(t).cast("double")) for t, b in coefficients.items()])
    return df.withColumn("predicted", F.exp(eta) if family == "poisson" else 1 / (1 + F.exp(-eta)))


def dose_response(df: DataFrame, events: str, trials: str, stress: str, link: str = "logit", confidence: float = 0.95, rounds: int = 50) -> DataFrame:
    """A row a term (constant, stress, ld50) of a binomial response to a stress, by the logit or the probit link.

    ld50 is the stress at which half respond, with its error by the delta method. Every round is one aggregation over
    rows of events out of trials. Rows with a null, without trials or with more events than trials are left out; fewer
    than 3 rows or one stress alone give no row. log_likelihood leaves out the binomial coefficients; deviance is
    against each row's own share.
    """
    if link not in ("logit", "probit"):
        raise ValueError("link is logit or probit")
    y, n, x = (F.col(c).cast("double") for c in (events, trials, stress))
    rows = df.select(y.alias("_y"), n.alias("_n"), x.alias("_x")).dropna().where("_n > 0 and _y between 0 and _n and abs(_x) < double('inf')")
    schema = "term string, estimate double, se double, z double, p_value double, low double, high double, log_likelihood double, deviance double, aic double, rows long"
    count, share, mean, spread = rows.agg(F.count("*"), F.sum("_y") / F.sum("_n"), F.avg("_x"), F.stddev_samp("_x")).first()
    if not count or count < 3 or not spread or not 0 < share < 1:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.withColumn("_z", (F.col("_x") - float(mean)) / float(spread))  # undone below
    beta, floor = np.array([math.log(share / (1 - share)) if link == "logit" else normal_quantile(share), 0.0]), 1e-15
    for _ in range(rounds):
        eta = float(beta[0]) + float(beta[1]) * F.col("_z")
        p = 1 / (1 + F.exp(-eta)) if link == "logit" else normal_cdf_col(eta)
        held = rows.withColumn("_p", F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor)))
        slope = F.col("_p") * (1 - F.col("_p")) if link == "logit" else F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
        held = held.withColumn("_d", F.greatest(slope, F.lit(floor))).withColumn("_w", F.col("_n") * F.col("_d") ** 2 / (F.col("_p") * (1 - F.col("_p"))))
        m, score, _, _ = gram(held, [F.lit(1.0), F.col("_z")], (F.col("_y") - F.col("_n") * F.col("_p")) / (F.col("_n") * F.col("_d")), F.col("_w"))
        step = np.linalg.lstsq(m, score, rcond=None)[0]
        if np.abs(step).max() < 1e-10 * (1 + np.abs(beta).max()):
            break
        beta = beta + step / max(1.0, float(np.abs(step).max()) / 4)
    hit, missed = F.col("_y"), F.col("_n") - F.col("_y")
    own = F.when(hit > 0, hit * F.log(hit / F.col("_n"))).otherwise(0.0) + F.when(missed > 0, missed * F.log(missed / F.col("_n"))).otherwise(0.0)
    like, best = held.agg(F.sum(hit * F.log("_p") + missed * F.log1p(-F.col("_p"))), F.sum(own)).first()
    turn = np.array([[1.0, -mean / spread], [0.0, 1 / spread]])
    b, cov = turn @ beta, turn @ np.linalg.pinv(m) @ turn.T
    half = -b[0] / b[1] if b[1] else math.nan
    error = math.sqrt(max(0.0, cov[0, 0] + 2 * half * cov[0, 1] + half * half * cov[1, 1])) / abs(b[1]) if b[1] else math.nan
    q, out = normal_quantile(1 - (1 - confidence) / 2), []
    for term, e, se in (("constant", b[0], math.sqrt(cov[0, 0])), ("stress", b[1], math.sqrt(cov[1, 1])), ("ld50", half, error)):
        e, se = float(e), float(se)
        z = e / se if se and term != "ld50" else None
        out.append((term, e, se, z, None if z is None else 2 * normal_cdf(-abs(z)), e - q * se, e + q * se, float(like), 2 * float(best - like), 4 - 2 * float(like), count))
    return df.sparkSession.createDataFrame(out, schema)


def fitted_line(df: DataFrame, response: str, predictor: str, places: int = 20, confidence: float = 0.95) -> DataFrame:
    """Confidence and prediction bands at equal places of one predictor's range."""
    fit = Fit(df, response, [predictor])
    low, high = fit.rows.agg(F.min(predictor), F.max(predictor)).first()
    q, rows = t_quantile(1 - (1 - confidence) / 2, fit.df), []
    for x in np.linspace(float(low), float(high), places):
        v = fit.mse / fit.n + fit.cov[1, 1] * (x - fit.x0[0]) ** 2
        y = float(fit.beta[0] + fit.beta[1] * x)
        a, b = q * math.sqrt(v), q * math.sqrt(v + fit.mse)
        rows.append((float(x), y, y - a, y + a, y - b, y + b))
    return df.sparkSession.createDataFrame(rows, "x double, fitted double, mean_low double, mean_high double, new_low double, new_high double")


def goodness_of_logistic(df: DataFrame, response: Column, predicted: str, bins: int = 10) -> DataFrame:
    """Hosmer-Lemeshow over equal bins of probability: observed and expected, statistic and p on the total row."""
    at = F.least(F.floor(F.col(predicted) * bins), F.lit(bins - 1)).cast("int")
    s = df.where(response.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(response.cast("double")).alias("observed"), F.sum(predicted).alias("expected"))
    return s.withColumn("contribution", (F.col("observed") - F.col("expected")) ** 2 / (F.col("expected") * (1 - F.col("expected") / F.col("n"))))


def chi_square_p(value: float, df: int) -> float:
    return chi2_right(value, df)
