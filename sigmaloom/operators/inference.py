"""Hypothesis tests: one aggregation to sufficient statistics, then columns; p-values by special functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import beta_quantile_col, binomial_cdf_col, chi2_quantile_col, chi2_right_col, f_right_col, log_normal_cdf_col, normal_cdf_col, normal_quantile, t_cdf_col, t_quantile_col
from ..plans.ordered import quantiles, running, with_levels


def two_sided(cdf: Column) -> Column:
    return 2 * F.least(cdf, 1 - cdf)


def p_value(cdf: Column, alternative: str) -> Column:
    return {"two-sided": two_sided(cdf), "less": cdf, "greater": 1 - cdf}[alternative]


def one_sample_t(df: DataFrame, value: str, mean: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """t statistic of the mean against a given one, with the interval of the difference left to t_interval."""
    x = F.col(value)
    s = df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stdev"))
    se = F.col("stdev") / F.sqrt("n")
    t = F.when((se == 0) & (F.col("mean") == mean), 0.0).otherwise((F.col("mean") - mean) / F.when(se != 0, se))
    return s.withColumn("se", se).withColumn("t", t).withColumn("df", F.col("n") - 1)


def with_t_p(df: DataFrame, alternative: str = "two-sided", confidence: float = 0.95, difference: str | None = None) -> DataFrame:
    """p_value of columns t and df; with difference and se also its confidence limits."""
    out = df.withColumn("p_value", p_value(t_cdf_col(F.col("t"), F.col("df")), alternative))
    if difference:
        half = t_quantile_col(1 - (1 - confidence) / 2, F.col("df")) * F.col("se")
        out = out.withColumn("low", F.col(difference) - half).withColumn("high", F.col(difference) + half)
    return out


def one_sample_z(df: DataFrame, value: str, mean: float, sigma: float) -> DataFrame:
    s = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    se = sigma / F.sqrt("n")
    return s.withColumn("se", se).withColumn("z", (F.col("mean") - mean) / se)


def sides(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """n, mean and variance of two groups in one row."""
    def s(level, k: int) -> list[Column]:
        x = F.when(F.col(group) == level, F.col(value))
        return [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"mean{k}"), F.var_samp(x).alias(f"var{k}")]

    return df.where(F.col(group).isin(first, second)).agg(*s(first, 1), *s(second, 2))


def two_sample_t(df: DataFrame, value: str, group: str, first, second, pooled: bool = False) -> DataFrame:
    s = sides(df, value, group, first, second)
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    if pooled:
        dof = F.col("n1") + F.col("n2") - 2
        se = F.sqrt(((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / dof * (1 / F.col("n1") + 1 / F.col("n2")))
    else:
        dof, se = (a + b) ** 2 / (a**2 / (F.col("n1") - 1) + b**2 / (F.col("n2") - 1)), F.sqrt(a + b)
    s = s.withColumn("difference", F.col("mean1") - F.col("mean2")).withColumn("se", se).withColumn("df", dof.cast("double"))
    return s.withColumn("t", F.col("difference") / F.col("se"))


def paired_t(df: DataFrame, first: str, second: str) -> DataFrame:
    """One-sample t of first - second over rows that have both."""
    return one_sample_t(df.select((F.col(first) - F.col(second)).alias("d")), "d")


def one_way_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """Sums of squares, degrees of freedom and F of one factor."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.sum(value).alias("s"))
    grand = g.agg((F.sum("s") / F.sum("n")).alias("grand"))
    s = g.crossJoin(F.broadcast(grand)).agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ss_between"), F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("v")).otherwise(0.0)).alias("ss_within"),
        (F.count("*") - 1).alias("df_between"), (F.sum("n") - F.count("*")).alias("df_within"),
    )
    s = s.withColumn("f", (F.col("ss_between") / F.col("df_between")) / (F.col("ss_within") / F.col("df_within")))
    return s.withColumn("r_squared", F.col("ss_between") / (F.col("ss_between") + F.col("ss_within")))


def with_f_p(df: DataFrame, f: str = "f", d1: str = "df_between", d2: str = "df_within") -> DataFrame:
    return df.withColumn("p_value", f_right_col(F.col(f), F.col(d1), F.col(d2)))


def pairwise_means(df: DataFrame, value: str, group: str) -> DataFrame:
    """Differences of all pairs of levels with the pooled standard error and t statistic."""
    g = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    pooled = g.agg((F.sum((F.col("n") - 1) * F.col("v")) / (F.sum("n") - F.count("*"))).alias("mse"), (F.sum("n") - F.count("*")).alias("df"), (F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    a, b = g.alias("a"), g.alias("b")
    rows = a.join(b, F.col("a.g") < F.col("b.g")).crossJoin(F.broadcast(pooled))  # levels, not rows
    se = F.sqrt(F.col("mse") * (1 / F.col("a.n") + 1 / F.col("b.n")))
    return rows.select(F.col("a.g").alias("first"), F.col("b.g").alias("second"), (F.col("a.m") - F.col("b.m")).alias("difference"), se.alias("se"), ((F.col("a.m") - F.col("b.m")) / se).alias("t"), "df", "pairs")


def with_bonferroni(pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    half = t_quantile_col(1 - (1 - confidence) / (2 * F.col("pairs")), F.col("df")) * F.col("se")
    p = F.least(F.lit(1.0), F.col("pairs") * two_sided(t_cdf_col(F.col("t"), F.col("df"))))
    return pairs.withColumn("p_value", p).withColumn("low", F.col("difference") - half).withColumn("high", F.col("difference") + half)


def analysis_of_means(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Level means against the grand mean, within z(1 - alpha/2k) s sqrt((k-1)/N)."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("v"), F.sum(value).alias("s"))
    total = g.agg(F.count("*").alias("k"), F.sum("n").alias("total"), (F.sum("s") / F.sum("n")).alias("grand"), F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / (F.sum("n") - F.count("*"))).alias("sp")).first()
    reach = normal_quantile(1 - alpha / (2 * total.k)) * total.sp * math.sqrt((total.k - 1) / total.total)
    out = (F.col("mean") < total.grand - reach) | (F.col("mean") > total.grand + reach)
    return g.select(group, "n", "mean", F.lit(total.grand).alias("grand"), F.lit(total.grand - reach).alias("lower"), F.lit(total.grand + reach).alias("upper"), out.alias("out"))


def two_factor_anova(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Sequential sums of squares of A, B given A, and the interaction, through dummy-coded normal equations."""
    import numpy as np

    rows = df.where(F.col(value).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("ss")).collect()  # levels, not rows
    la, lb = sorted({r[a] for r in cells}), sorted({r[b] for r in cells})

    def rss(terms: str) -> tuple[float, int]:
        def x(r) -> list[float]:
            ax, bx = [float(r[a] == v) for v in la[1:]], [float(r[b] == v) for v in lb[1:]]
            return [1.0] + (ax if "a" in terms else []) + (bx if "b" in terms else []) + ([i * j for i in ax for j in bx] if "i" in terms else [])

        m = np.array([x(r) for r in cells])
        n, s = np.array([r.n for r in cells], float), np.array([r.s for r in cells])
        gram, xy = m.T @ (m * n[:, None]), m.T @ s
        beta = np.linalg.lstsq(gram, xy, rcond=None)[0]
        return sum(r.ss for r in cells) - float(beta @ xy), int(np.linalg.matrix_rank(m))

    steps = [rss(t) for t in ("", "a", "ab", "abi")]
    n = sum(r.n for r in cells)
    error, df_error = steps[-1][0], n - steps[-1][1]
    out = [(name, float(p[0] - q[0]), q[1] - p[1]) for name, p, q in zip((a, b, f"{a}*{b}"), steps, steps[1:], strict=False)]
    table = [(t, ss, d, ss / d / (error / df_error) if d and df_error else None) for t, ss, d in out] + [("error", float(error), df_error, None)]
    return df.sparkSession.createDataFrame(table, "term string, ss double, df long, f double")


def one_proportion(df: DataFrame, event: Column, hypothesized: float = 0.5, confidence: float = 0.95) -> DataFrame:
    """Sample proportion, its normal statistic and the Wilson interval."""
    z = normal_quantile(1 - (1 - confidence) / 2)
    s = df.agg(F.count_if(event).alias("events"), F.count(event).alias("trials"))
    p, n = F.col("events") / F.col("trials"), F.col("trials").cast("double")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return s.select("events", "trials", p.alias("proportion"), ((p - hypothesized) / F.sqrt(hypothesized * (1 - hypothesized) / n)).alias("z"), (mid - half).alias("wilson_low"), (mid + half).alias("wilson_high"))


def with_exact_proportion(df: DataFrame, hypothesized: float, confidence: float = 0.95) -> DataFrame:
    """Clopper-Pearson limits and the exact p-value, twice the smaller tail."""
    x, n, tail = F.col("events"), F.col("trials"), (1 - confidence) / 2
    low = F.when(x == 0, 0.0).otherwise(beta_quantile_col(tail, F.greatest(x, F.lit(1)), n - x + 1))
    high = F.when(x == n, 1.0).otherwise(beta_quantile_col(1 - tail, x + 1, F.greatest(n - x, F.lit(1))))
    p = F.least(F.lit(1.0), 2 * F.least(binomial_cdf_col(x, n, hypothesized), 1 - binomial_cdf_col(x - 1, n, hypothesized)))
    return df.withColumn("exact_low", low).withColumn("exact_high", high).withColumn("p_value", p)


def two_proportions(df: DataFrame, event: Column, group: str, first, second) -> DataFrame:
    """Difference of two proportions, unpooled z; no statistic where both proportions are 0 or 1."""
    def s(level, k: int) -> list[Column]:
        here = F.col(group) == level
        return [F.count_if(here & event).alias(f"events{k}"), F.count_if(here).alias(f"trials{k}")]

    out = df.agg(*s(first, 1), *s(second, 2))
    p1, p2 = F.col("events1") / F.col("trials1"), F.col("events2") / F.col("trials2")
    se = F.sqrt(p1 * (1 - p1) / F.col("trials1") + p2 * (1 - p2) / F.col("trials2"))
    return out.withColumn("difference", p1 - p2).withColumn("se", se).withColumn("z", F.when(se > 0, (p1 - p2) / se))


def with_z_p(df: DataFrame, alternative: str = "two-sided") -> DataFrame:
    return df.withColumn("p_value", p_value(normal_cdf_col(F.col("z")), alternative))


def one_poisson_rate(df: DataFrame, count: str, hypothesized: float, confidence: float = 0.95) -> DataFrame:
    """Rate a row, its normal statistic and Garwood's exact limits."""
    s = df.agg(F.sum(count).alias("events"), F.count(count).alias("exposure"))
    rate = F.col("events") / F.col("exposure")
    tail = (1 - confidence) / 2
    low = F.when(F.col("events") == 0, 0.0).otherwise(chi2_quantile_col(tail, 2 * F.greatest(F.col("events"), F.lit(1))) / 2 / F.col("exposure"))
    return s.withColumn("rate", rate).withColumn("z", (rate - hypothesized) / F.sqrt(hypothesized / F.col("exposure"))).withColumn("low", low).withColumn("high", chi2_quantile_col(1 - tail, 2 * (F.col("events") + 1)) / 2 / F.col("exposure"))


def two_poisson_rates(df: DataFrame, count: str, group: str, first, second) -> DataFrame:
    def s(level, k: int) -> list[Column]:
        x = F.when(F.col(group) == level, F.col(count))
        return [F.sum(x).alias(f"events{k}"), F.count(x).alias(f"exposure{k}")]

    out = df.agg(*s(first, 1), *s(second, 2))
    r1, r2 = F.col("events1") / F.col("exposure1"), F.col("events2") / F.col("exposure2")
    se = F.sqrt(r1 / F.col("exposure1") + r2 / F.col("exposure2"))
    return out.withColumn("difference", r1 - r2).withColumn("ratio", r1 / r2).withColumn("z", (r1 - r2) / se)


def equivalence(df: DataFrame, lower: float, upper: float) -> DataFrame:
    """The two one-sided statistics of columns difference and se against equivalence limits."""
    return df.withColumn("t_lower", (F.col("difference") - lower) / F.col("se")).withColumn("t_upper", (F.col("difference") - upper) / F.col("se"))


def with_equivalence_p(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    out = df.withColumn("p_lower", 1 - t_cdf_col(F.col("t_lower"), F.col("df"))).withColumn("p_upper", t_cdf_col(F.col("t_upper"), F.col("df")))
    return out.withColumn("equivalent", F.greatest("p_lower", "p_upper") <= alpha)


def one_variance(df: DataFrame, value: str, variance: float, confidence: float = 0.95) -> DataFrame:
    s = df.agg(F.count(value).alias("n"), F.var_samp(value).alias("variance"))
    return s.withColumn("chi_square", (F.col("n") - 1) * F.col("variance") / variance).withColumn("df", F.col("n") - 1)


def with_variance_p(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    right = chi2_right_col(F.col("chi_square"), F.col("df"))
    ss = F.col("df") * F.col("variance")
    return df.withColumn("p_value", two_sided(right)).withColumn("low", ss / chi2_quantile_col(1 - tail, F.col("df"))).withColumn("high", ss / chi2_quantile_col(tail, F.col("df")))


def two_variances(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    return sides(df, value, group, first, second).withColumn("f", F.col("var1") / F.col("var2")).withColumn("df1", F.col("n1") - 1).withColumn("df2", F.col("n2") - 1)


def levene(df: DataFrame, value: str, group: str, centre: str = "median") -> DataFrame:
    """ANOVA of absolute deviations from the level's median (Brown-Forsythe) or mean."""
    rows = df.where(F.col(value).isNotNull())
    mid = quantiles(rows, value, [group], {"_mid": 0.5}).drop("_n") if centre == "median" else rows.groupBy(group).agg(F.avg(value).alias("_mid"))
    off = rows.join(mid, group).withColumn("_off", F.abs(F.col(value) - F.col("_mid")))
    return one_way_anova(off, "_off", group)


def bartlett(df: DataFrame, value: str, group: str) -> DataFrame:
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.var_samp(value).alias("v"))
    d = F.col("n") - 1
    s = g.agg(F.count("*").alias("k"), F.sum(d).alias("d"), F.sum(d * F.col("v")).alias("ss"), F.sum(d * F.log("v")).alias("lv"), F.sum(1 / d).alias("inv"))
    c = 1 + (F.col("inv") - 1 / F.col("d")) / (3 * (F.col("k") - 1))
    return s.select("k", (F.col("k") - 1).alias("df"), ((F.col("d") * F.log(F.col("ss") / F.col("d")) - F.col("lv")) / c).alias("chi_square"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r, n and t of every pair of columns over the rows that have both, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]

    def s(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.count_if(both).alias("n"), F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))).alias("r"))

    rows = df.agg(F.array(*[s(a, b) for a, b in pairs]).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return rows.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") ** 2)))


def grubbs(df: DataFrame, value: str) -> DataFrame:
    s = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    up, down = (F.col("hi") - F.col("mean")) / F.col("s"), (F.col("mean") - F.col("lo")) / F.col("s")
    return s.select("n", F.when(up >= down, F.col("hi")).otherwise(F.col("lo")).alias("outlier"), F.greatest(up, down).alias("g"))


def with_grubbs_p(df: DataFrame) -> DataFrame:
    n = F.col("n")
    t = F.sqrt(n * (n - 2) * F.col("g") ** 2 / ((n - 1) ** 2 - n * F.col("g") ** 2))
    return df.withColumn("p_value", F.least(F.lit(1.0), 2 * n * (1 - t_cdf_col(t, n - 2))))


def dixon(df: DataFrame, value: str) -> DataFrame:
    """r10: the gap at an end over the range, the larger of both ends."""
    x = F.col(value)
    low, high = df.where(x.isNotNull()).select(x.alias("x")).orderBy("x").limit(2), df.where(x.isNotNull()).select(x.alias("x")).orderBy(F.desc("x")).limit(2)
    ends = low.agg(F.min("x").alias("x1"), F.max("x").alias("x2")).crossJoin(high.agg(F.max("x").alias("xn"), F.min("x").alias("xm")))
    span = F.col("xn") - F.col("x1")
    return ends.select(((F.col("x2") - F.col("x1")) / span).alias("r_low"), ((F.col("xn") - F.col("xm")) / span).alias("r_high"))


def normal_plot(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Values in order with plotting positions (i - 3/8) / (n + 1/4), by series."""
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("x"))
    rows = with_levels(running(rows, by, ["x", order], {"i": F.lit(1)}), rows.groupBy(*by).agg(F.count("*").alias("n")), by)
    return rows.select(*by, order, "x", ((F.col("i") - 0.375) / (F.col("n") + 0.25)).alias("position"))


def anderson_darling(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A squared against a fitted normal distribution, adjusted, with Stephens' p; by series."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(*by, x.alias("_x"))
    level = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"))
    # equal values come in any order, each place once: they are counted, and a value takes the sum of its places
    rows = running(rows.groupBy(*by, "_x").agg(F.count("*").alias("_c")), by, ["_x"], {"_u": F.col("_c")})
    rows = with_levels(rows, level, by).withColumn("_z", (F.col("_x") - F.col("_m")) / F.col("_s"))
    n, c = F.col("_n"), F.col("_c")
    places = c * (2 * F.col("_u") - c + 1) / 2
    terms = (2 * places - c) * log_normal_cdf_col(F.col("_z")) + (2 * (n * c - places) + c) * log_normal_cdf_col(-F.col("_z"))
    s = rows.groupBy(*by).agg(F.sum("_c").alias("n"), (-F.sum("_c") - F.sum(terms) / F.sum("_c")).alias("a2"))
    a = F.col("a2") * (1 + 0.75 / F.col("n") + 2.25 / F.col("n") ** 2)
    p = F.when(a > 0.6, F.exp(1.2937 - 5.709 * a + 0.0186 * a * a)).when(a > 0.34, F.exp(0.9177 - 4.279 * a - 1.38 * a * a)).when(a > 0.2, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a)).otherwise(1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a))
    return s.withColumn("a2_adjusted", a).withColumn("p_value", p)


def normal_tolerance(df: DataFrame, value: str, coverage: float = 0.95, confidence: float = 0.95) -> DataFrame:
    """Howe's two-sided interval."""
    z = normal_quantile((1 + coverage) / 2)
    s = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    d = F.col("n") - 1
    k = z * F.sqrt(d * (1 + 1 / F.col("n")) / chi2_quantile_col(1 - confidence, d))
    return s.withColumn("k", k).withColumn("low", F.col("mean") - k * F.col("s")).withColumn("high", F.col("mean") + k * F.col("s"))


def bootstrap_mean(df: DataFrame, value: str, order: str, replicates: int = 200, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean with Poisson weights: each row draws its weight in each replicate by hash."""
    means = bootstrap_rows(df, value, order, replicates, seed)
    tail = (1 - confidence) / 2
    return means.agg(F.count("*").alias("replicates"), F.avg("m").alias("mean"), F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def fisher_exact(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """Two-sided exact p of a 2 x 2 table of two conditions."""
    import math as m

    a, b, c, d = df.agg(F.count_if(row & column), F.count_if(row & ~column), F.count_if(~row & column), F.count_if(~row & ~column)).first()
    lf = lambda n: m.lgamma(n + 1)
    fixed = lf(a + b) + lf(c + d) + lf(a + c) + lf(b + d) - lf(a + b + c + d)
    log_p = lambda x: fixed - lf(x) - lf(a + b - x) - lf(a + c - x) - lf(d - a + x)
    here = log_p(a)
    p = sum(m.exp(v) for x in range(max(0, a - d), min(a + b, a + c) + 1) if (v := log_p(x)) <= here + 1e-7)
    return df.sparkSession.createDataFrame([(a, b, c, d, min(1.0, p))], "a long, b long, c long, d long, p_value double")


def equivalence_ratio(df: DataFrame, value: str, group: str, first, second, lower: float, upper: float) -> DataFrame:
    """One-sided statistics of the ratio of two means against limits, in the form mean1 - limit * mean2."""
    s = sides(df, value, group, first, second)

    def t(limit: float) -> Column:
        return (F.col("mean1") - limit * F.col("mean2")) / F.sqrt(F.col("var1") / F.col("n1") + limit**2 * F.col("var2") / F.col("n2"))

    return s.select("n1", "n2", (F.col("mean1") / F.col("mean2")).alias("ratio"), t(lower).alias("t_lower"), t(upper).alias("t_upper"))


def proportion_equivalence(df: DataFrame, event: Column, target: float, lower: float, upper: float) -> DataFrame:
    """One-sided normal statistics of a proportion less a target against limits."""
    s = df.agg(F.count_if(event).alias("events"), F.count(event).alias("trials"))
    p = F.col("events") / F.col("trials")
    s = s.withColumn("difference", p - target).withColumn("se", F.sqrt(p * (1 - p) / F.col("trials")))
    return s.withColumn("z_lower", (F.col("difference") - lower) / F.col("se")).withColumn("z_upper", (F.col("difference") - upper) / F.col("se"))


def nonparametric_tolerance(df: DataFrame, value: str, coverage: float = 0.95, confidence: float = 0.95) -> DataFrame:
    """The narrowest symmetric order-statistic interval (Wilks) that reaches the confidence, else the extremes."""
    from ..functions.special import binomial_cdf

    rows = df.where(F.col(value).isNotNull())
    n = rows.count()
    k = 0
    while 2 * (k + 1) < n and binomial_cdf(n - 2 * (k + 1), n, coverage) >= confidence:
        k += 1
    reached = binomial_cdf(n - 2 * max(k, 1), n, coverage) if n > 1 else 0.0
    r = max(k, 1)
    low = rows.select(value).orderBy(value).limit(r).agg(F.max(value).alias("low"))
    high = rows.select(value).orderBy(F.desc(value)).limit(r).agg(F.min(value).alias("high"))
    return low.crossJoin(high).select(F.lit(n).alias("n"), F.lit(r).alias("rank"), "low", "high", F.lit(float(reached)).alias("confidence"))


def two_sample_bootstrap(df: DataFrame, value: str, group: str, first, second, order: str, replicates: int = 200) -> DataFrame:
    """Percentile interval of the difference of two means, Poisson weights by hash."""
    a, b = (bootstrap_rows(df.where(F.col(group) == g), value, order, replicates) for g in (first, second))
    d = a.select("r", F.col("m").alias("a")).join(b.select("r", F.col("m").alias("b")), "r").select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.count("*").alias("replicates"), F.avg("d").alias("difference"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))


def bootstrap_rows(df: DataFrame, value: str, order: str, replicates: int, seed: int = 1) -> DataFrame:
    """(r, m): the mean of each replicate. A partition gives one row a replicate, so resamples are never written out."""
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weights = np.zeros(replicates), np.zeros(replicates)
        each = (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                h = part["h"].to_numpy().astype(np.uint64)[:, None] ^ each[None, :]
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(cuts, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right").astype(float)
                total, weights = total + part["x"].to_numpy(float) @ w, weights + w.sum(axis=0)
        yield pd.DataFrame({"r": np.arange(1, replicates + 1), "s": total, "w": weights})

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.col(order)).alias("h"), F.col(value).cast("double").alias("x"))
    return rows.mapInPandas(sums, "r long, s double, w double").groupBy("r").agg((F.sum("s") / F.sum("w")).alias("m"))


def nemenyi(df: DataFrame, treatments: list[str]) -> DataFrame:
    """Differences of mean ranks of every pair of treatments, a row a block, with their normal statistic."""
    from functools import reduce
    from itertools import combinations
    from operator import add

    rows = df.where(reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in treatments]))
    k = len(treatments)
    rank = {t: 1 + reduce(add, [(F.col(o) < F.col(t)).cast("int") + (F.col(o) == F.col(t)).cast("int") / 2 for o in treatments if o != t]) for t in treatments}
    s = rows.agg(F.count("*").alias("b"), *[F.avg(rank[t]).alias(f"r{i}") for i, t in enumerate(treatments)])
    pairs = [F.struct(F.lit(treatments[i]).alias("first"), F.lit(treatments[j]).alias("second"), (F.col(f"r{i}") - F.col(f"r{j}")).alias("difference"), ((F.col(f"r{i}") - F.col(f"r{j}")) / F.sqrt(k * (k + 1) / (6 * F.col("b")))).alias("z")) for i, j in combinations(range(k), 2)]
    return s.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def two_proportion_equivalence(df: DataFrame, event: Column, group: str, first, second, lower: float, upper: float) -> DataFrame:
    """One-sided normal statistics of the difference of two proportions against limits, by Wald's error."""
    own = lambda g: F.col(group) == g
    s = df.where(event.isNotNull()).agg(*[f.alias(a) for g, k in ((first, 1), (second, 2)) for f, a in ((F.count_if(event & own(g)), f"events{k}"), (F.count_if(own(g)), f"trials{k}"))])
    p1, p2 = F.col("events1") / F.col("trials1"), F.col("events2") / F.col("trials2")
    s = s.withColumn("difference", p1 - p2).withColumn("se", F.sqrt(p1 * (1 - p1) / F.col("trials1") + p2 * (1 - p2) / F.col("trials2")))
    return s.withColumn("z_lower", (F.col("difference") - lower) / F.col("se")).withColumn("z_upper", (F.col("difference") - upper) / F.col("se"))


def one_sample_equivalence(df: DataFrame, value: str, target: float, lower: float, upper: float) -> DataFrame:
    """The two one-sided t statistics of a mean less a target against limits."""
    s = df.agg(F.count(value).alias("n"), (F.avg(value) - target).alias("difference"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    return equivalence(s, lower, upper).withColumn("df", F.col("n") - 1)


def grouping_letters(pairs: DataFrame, means: DataFrame, level: str, alpha: float = 0.05) -> DataFrame:
    """Letters of levels, greatest mean first; levels that share a letter do not differ. pairs: first, second, p_value.

    A row a level and a row a pair of levels reach the driver. Each maximal run of levels, in order of their
    means, of which no two differ has a letter.
    """
    order = [r[level] for r in means.orderBy(F.desc("mean"), level).collect()]
    differ = {frozenset((r["first"], r["second"])) for r in pairs.where(F.col("p_value") < alpha).select("first", "second").collect()}
    runs = []
    for i, _ in enumerate(order):
        j = i + 1
        while j < len(order) and all(frozenset((order[k], order[j])) not in differ for k in range(i, j)):
            j += 1
        if not runs or j > runs[-1][1]:
            runs.append((i, j))
    letter = lambda k: (letter(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    rows = [(name, " ".join(letter(k) for k, (i, j) in enumerate(runs) if i <= at < j)) for at, name in enumerate(order)]
    return means.sparkSession.createDataFrame(rows, f"`{level}` {dict(means.dtypes)[level]}, letters string")
