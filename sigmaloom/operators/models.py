"""Further models: isolation forest, trees, mixtures, multinomial logistic regression, fits of distributions."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import log_normal_cdf_col, normal_cdf, normal_quantile_col
from ..plans.ordered import folded, forgotten_after, running, with_levels
from .inference import normal_plot
from .nonparametric import mann_whitney
from .regression import complete
from .reliability import weibull


def isolation_forest(df: DataFrame, columns: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """df's complete rows with `score`, 2^(-mean path / c): near 1 for rows that are split off soon.

    Trees grow on the driver from `trees` samples of `sample` rows, chosen by hash of the key; all rows are
    scored where they lie.
    """
    rows = complete(df, columns)
    picked = rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(trees * sample).select(*[F.col(c).cast("double") for c in columns]).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    size = min(sample, len(picked))
    if size < 2:
        return rows.withColumn("score", F.lit(0.5))
    depth = math.ceil(math.log2(size))
    c = lambda n: 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(x: np.ndarray, level: int):
        wide = [j for j in range(x.shape[1]) if x[:, j].min() < x[:, j].max()] if len(x) else []
        if level >= depth or len(x) <= 1 or not wide:
            return level + c(len(x))
        j = int(rng.choice(wide))
        cut = rng.uniform(x[:, j].min(), x[:, j].max())
        low = x[:, j] < cut
        return j, cut, grow(x[low], level + 1), grow(x[~low], level + 1)

    forest = df.sparkSession.sparkContext.broadcast([grow(picked[rng.choice(len(picked), size, replace=False)], 0) for _ in range(trees)])
    scale = c(size)

    def path(node, x: np.ndarray) -> np.ndarray:
        if isinstance(node, float):
            return np.full(len(x), node)
        low = x[:, node[0]] < node[1]
        out = np.empty(len(x))
        out[low], out[~low] = path(node[2], x[low]), path(node[3], x[~low])
        return out

    @F.pandas_udf(DoubleType())
    def score(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in values])
        return pd.Series(2 ** (-np.mean([path(t, x) for t in forest.value], axis=0) / scale))

    return rows.withColumn("score", score(*[F.col(k).cast("double") for k in columns]))


def tree(df: DataFrame, label: str, columns: list[str], depth: int = 4, least: int = 5) -> DataFrame:
    """Importance of each column in a classification tree by Gini gain."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = complete(df, columns).where(F.col(label).isNotNull())
    x = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows)
    y = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(x).transform(x)
    fit = DecisionTreeClassifier(labelCol="_y", featuresCol="_x", maxDepth=depth, minInstancesPerNode=least, seed=1).fit(y)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, fit.featureImportances.toArray(), strict=True)], "variable string, importance double")


def mixture(df: DataFrame, value: str, components: int = 2) -> DataFrame:
    """Weights, means and deviations of a mixture of normals, by expectation-maximisation in Spark ML."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["_v"], outputCol="_x").transform(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v")))
    fit = GaussianMixture(featuresCol="_x", k=components, seed=1).fit(rows)
    parts = sorted((float(g.mean[0]), math.sqrt(float(g.cov.toArray()[0, 0])), float(w)) for w, g in zip(fit.weights, (r for r in fit.gaussians), strict=True))
    return df.sparkSession.createDataFrame([(k, w, m, s) for k, (m, s, w) in enumerate(parts, 1)], "component int, weight double, mean double, stdev double")


def nominal_logistic(df: DataFrame, label: str, predictors: list[str], rounds: int = 25) -> DataFrame:
    """Multinomial logistic regression against the last level by Newton steps of one aggregation each."""
    rows = complete(df, predictors).where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_l"), *[F.col(p).cast("double").alias(f"x{i}") for i, p in enumerate(predictors)])
    stats = rows.agg(*[f(f"x{i}") for i in range(len(predictors)) for f in (F.avg, F.stddev_samp)]).first()
    mean, sd = np.array(stats[::2], float), np.array([v or 1.0 for v in stats[1::2]], float)
    rows = rows.withColumns({f"x{i}": (F.col(f"x{i}") - float(mean[i])) / float(sd[i]) for i in range(len(predictors))})
    levels = sorted(r._l for r in rows.select("_l").distinct().collect())  # levels, not rows
    x = [F.lit(1.0)] + [F.col(f"x{i}") for i in range(len(predictors))]
    k, p = len(levels) - 1, len(x)
    beta = np.zeros((k, p))
    for _ in range(rounds):
        eta = [reduce(add, [float(b) * v for b, v in zip(beta[j], x, strict=True)]) for j in range(k)]
        total = reduce(add, [F.exp(e) for e in eta], F.lit(1.0))
        wide = rows.withColumns({f"p{j}": F.exp(eta[j]) / total for j in range(k)})
        score = [F.sum(((F.col("_l") == levels[j]).cast("double") - F.col(f"p{j}")) * v) for j in range(k) for v in x]
        info = [F.sum(F.col(f"p{a}") * ((1.0 if a == b else 0.0) - F.col(f"p{b}")) * x[i] * x[j]) for a in range(k) for i in range(p) for b in range(k) for j in range(p)]
        out = wide.agg(*[c.alias(f"c{n}") for n, c in enumerate(score + info)]).first()
        g, h = np.array(out[: k * p], float), np.array(out[k * p :], float).reshape(k * p, k * p)
        step = np.linalg.solve(h, g)
        beta = beta + step.reshape(k, p)
        if np.abs(step).max() < 1e-9:
            break
    cov = np.linalg.inv(h)
    table = []
    for j in range(k):
        slopes = beta[j, 1:] / sd
        for i, name in enumerate(["constant", *predictors]):
            change = np.zeros(k * p)
            if i:
                change[j * p + i] = 1 / sd[i - 1]
            else:
                change[j * p : (j + 1) * p] = [1.0, *(-mean / sd)]
            b = float(slopes[i - 1]) if i else float(beta[j, 0] - slopes @ mean)
            se = math.sqrt(change @ cov @ change)
            table.append((levels[j], name, b, se, b / se, 2 * normal_cdf(-abs(b / se))))
    return df.sparkSession.createDataFrame(table, "level string, term string, coefficient double, se double, z double, p_value double")


def ryan_joiner(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Correlation of values with normal scores of Blom's positions, by series."""
    rows = normal_plot(df, value, order, by).withColumn("_z", normal_quantile_col(F.col("position")))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(F.col("x").cast("double"), F.col("_z")).alias("rj"))


def identify_distributions(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """A squared of normal, lognormal and exponential fits of each series; the last two for positive values alone."""
    x = F.col(value).cast("double")
    log = F.when(x > 0, F.log(x))
    rows = df.where(x.isNotNull())
    level = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min(x).alias("_low"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.avg(log).alias("_lm"), F.stddev_samp(log).alias("_ls"))
    rows = with_levels(running(rows.select(*by, order, value), by, [value, order], {"_i": F.lit(1)}), level, by)
    rows = rows.withColumn("_a", (x - F.col("_m")) / F.col("_s")).withColumn("_b", (log - F.col("_lm")) / F.col("_ls"))
    tails = {"normal": (log_normal_cdf_col(F.col("_a")), log_normal_cdf_col(-F.col("_a"))), "lognormal": (log_normal_cdf_col(F.col("_b")), log_normal_cdf_col(-F.col("_b"))), "exponential": (F.log(-F.expm1(-x / F.col("_m"))), -x / F.col("_m"))}
    for name, (p, q) in tails.items():
        rows = rows.withColumn(f"_p_{name}", p).withColumn(f"_q_{name}", q)
    term = lambda d: (2 * F.col("_i") - 1) * F.col(f"_p_{d}") + (2 * (F.col("_n") - F.col("_i")) + 1) * F.col(f"_q_{d}")
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_low").alias("low"), *[(-F.count("*") - F.sum(term(d)) / F.count("*")).alias(d) for d in tails])
    pairs = F.array(*[F.struct(F.lit(d).alias("distribution"), F.when((F.col("low") > 0) | F.lit(d == "normal"), F.col(d)).alias("a2")) for d in tails])
    return s.select(*by, "n", F.explode(pairs).alias("p")).select(*by, "n", "p.distribution", "p.a2")


def t_chart(df: DataFrame, interval: str) -> DataFrame:
    """Limits of times between events by quantiles of a Weibull distribution fitted to the positive ones."""
    fit = weibull(df, interval, F.lit(True))
    q = lambda p: F.col("scale") * F.pow(-F.log(F.lit(1 - p)), 1 / F.col("shape"))
    return fit.select("n", "shape", "scale", q(0.00135).alias("lower"), q(0.5).alias("centre"), q(0.99865).alias("upper"))


def lognormal_capability(df: DataFrame, value: str, lsl: float, usl: float, by: list[str] | None = None) -> DataFrame:
    """Ppl, Ppu and Ppk by the z scores of the limits under a lognormal fit of the positive values."""
    x = F.log(F.col(value).cast("double"))
    s = df.where(F.col(value) > 0).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(x).alias("location"), F.stddev_samp(x).alias("scale"))
    low, high = (F.col("location") - math.log(lsl)) / F.col("scale") / 3, (math.log(usl) - F.col("location")) / F.col("scale") / 3
    return s.select("*", low.alias("ppl"), high.alias("ppu"), F.least(low, high).alias("ppk"))


def weibull_capability(df: DataFrame, value: str, lsl: float | None, usl: float | None) -> DataFrame:
    """One row: n, shape, scale, overall Pp, Ppl, Ppu, Ppk by the z scores of the limits under a Weibull fit, expected parts per million.

    A limit that is not given has no index; Pp needs both. Probabilities are kept 1e-12 from 0 and 1. Nulls are left out;
    values of 0 or less, or none at all, give no row.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    if not rows.where(x <= 0).isEmpty():
        rows = rows.limit(0)
    s = weibull(rows, value, F.lit(True)).select("n", "shape", "scale")
    share = lambda limit: 1 - F.exp(-F.pow(F.greatest(F.lit(float(limit)), F.lit(0.0)) / F.col("scale"), F.col("shape")))
    z = lambda p: normal_quantile_col(F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12)))
    none = F.lit(None).cast("double")
    low, high = none if lsl is None else z(share(lsl)), none if usl is None else z(share(usl))
    s = s.withColumns({"ppl": -low / 3, "ppu": high / 3, "pp": (high - low) / 6})
    return s.select("n", "shape", "scale", "pp", "ppl", "ppu", F.least("ppl", "ppu").alias("ppk"), (none if lsl is None else 1e6 * share(lsl)).alias("ppm_below"), (none if usl is None else 1e6 * (1 - share(usl))).alias("ppm_above"))


def pairwise_rank_sums(df: DataFrame, value: str, group: str, levels: list[str]) -> DataFrame:
    """Mann-Whitney of every pair of levels, ranked anew in each pair."""
    parts = [mann_whitney(df, value, group, a, b).select(F.lit(a).alias("first"), F.lit(b).alias("second"), "w", "z") for a, b in combinations(levels, 2)]
    return reduce(DataFrame.union, parts)


def median_interval(df: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    """The sign interval of the median: order statistics from both ends, counted over distinct values."""
    from .nonparametric import median_interval_ranks

    rows = df.where(F.col(value).isNotNull())
    n = rows.count()
    k, reached = median_interval_ranks(n, confidence) if n > 1 else (1, 0.0)
    k = max(k, 1)
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = running(counts, [], ["v"], {"u": F.col("c")})
    return upto.agg(F.lit(n).cast("long").alias("n"), F.min(F.when(F.col("u") >= k, F.col("v"))).alias("low"), F.min(F.when(F.col("u") >= n - k + 1, F.col("v"))).alias("high"), F.lit(float(reached)).alias("confidence"))


def rolling_origin(df: DataFrame, value: str, order: str, by: list[str], alpha: float = 0.2, start: int = 10, horizon: int = 1) -> DataFrame:
    """Errors of single smoothing forecasts from every origin on, by series: MAD, MSD and the scaled MASE."""
    from .timeseries import smoothed_levels

    def run(x: np.ndarray, at: int) -> dict:
        y, n = x[:, 0], len(x)
        error, step = np.full(n, np.nan), np.full(n, np.nan)
        if n > horizon:
            error[: n - horizon] = np.where(np.arange(at + 1, at + n + 1 - horizon) >= start, y[horizon:] - smoothed_levels(y, alpha)[: n - horizon], np.nan)
        step[:-1] = np.abs(np.diff(y))
        return {"e": error, "step": step}

    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_y"))
    made = folded(rows, order, by, ["_y"], run, "e double, step double", forgotten_after(1 - alpha), after=max(1, horizon))
    e, step = F.nanvl("e", F.lit(None).cast("double")), F.nanvl("step", F.lit(None).cast("double"))
    s = made.groupBy(*by).agg(F.count(e).alias("origins"), F.avg(F.abs(e)).alias("mad"), F.avg(e * e).alias("msd"), F.avg(step).alias("_naive"))
    return s.withColumn("mase", F.when(F.col("_naive") > 0, F.col("mad") / F.col("_naive"))).drop("_naive")


def ordinal_logistic(df: DataFrame, label: str, levels: list, predictors: list[str], rounds: int = 40) -> DataFrame:
    """Proportional odds of ordered levels, P(y <= j) = logistic(cut_j - xb), by Fisher scoring: one aggregation a step."""
    rows = complete(df, predictors).where(F.col(label).isin(levels)).select((F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(label))).cast("int").alias("_y"), *[F.col(p).cast("double").alias(f"x{i}") for i, p in enumerate(predictors)])
    stats = rows.agg(F.count("*"), *[F.count_if(F.col("_y") <= j) for j in range(1, len(levels))], *[f(f"x{i}") for i in range(len(predictors)) for f in (F.avg, F.stddev_samp)]).first()
    k, p = len(levels) - 1, len(predictors)
    share = np.clip(np.array(stats[1 : k + 1], float) / stats[0], 1e-6, 1 - 1e-6)
    mean, sd = np.array(stats[k + 1 :: 2], float), np.array([s or 1.0 for s in stats[k + 2 :: 2]], float)
    rows = rows.withColumns({f"x{i}": (F.col(f"x{i}") - float(mean[i])) / float(sd[i]) for i in range(p)})
    theta, beta = np.log(share / (1 - share)), np.zeros(p)
    for _ in range(rounds):
        eta = reduce(add, [float(b) * F.col(f"x{i}") for i, b in enumerate(beta)], F.lit(0.0))
        below = [F.lit(0.0)] + [1 / (1 + F.exp(eta - float(t))) for t in theta] + [F.lit(1.0)]
        wide = rows.withColumns({f"c{j}": c for j, c in enumerate(below)})
        c = [F.col(f"c{j}") for j in range(k + 2)]
        f = [x * (1 - x) for x in c]
        prob = [F.greatest(c[j + 1] - c[j], F.lit(1e-12)) for j in range(k + 1)]
        # the derivative of each level's probability by each parameter
        slope = [[(f[j + 1] if m == j else -f[j] if m == j - 1 else None) for m in range(k)] + [-(f[j + 1] - f[j]) * F.col(f"x{i}") for i in range(p)] for j in range(k + 1)]
        q = k + p
        score = [reduce(add, [F.when(F.col("_y") == j + 1, slope[j][m] / prob[j]).otherwise(0.0) for j in range(k + 1) if slope[j][m] is not None]) for m in range(q)]
        info = [(m, n, reduce(add, [slope[j][m] * slope[j][n] / prob[j] for j in range(k + 1) if slope[j][m] is not None and slope[j][n] is not None] or [F.lit(0.0)])) for m in range(q) for n in range(m, q)]
        out = wide.agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(score)], *[F.sum(v).alias(f"i{m}_{n}") for m, n, v in info]).first()
        g, h = np.array(out[:q], float), np.zeros((q, q))
        for at, (m, n, _) in enumerate(info):
            h[m, n] = h[n, m] = out[q + at]
        step = np.linalg.solve(h, g)
        step /= max(1.0, float(np.abs(step).max()))
        theta, beta = theta + step[:k], beta + step[k:]
        if np.abs(step).max() < 1e-9:
            break
    cov, table = np.linalg.inv(h), []
    for j in range(k):
        change = np.append(np.eye(k)[j], mean / sd)
        b = float(theta[j] + beta @ (mean / sd))
        table.append((f"cut {levels[j]}", b, math.sqrt(change @ cov @ change)))
    table += [(name, float(beta[i] / sd[i]), math.sqrt(cov[k + i, k + i]) / float(sd[i])) for i, name in enumerate(predictors)]
    return df.sparkSession.createDataFrame([(t, b, se, b / se, 2 * normal_cdf(-abs(b / se))) for t, b, se in table], "term string, coefficient double, se double, z double, p_value double")
