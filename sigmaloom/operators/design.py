"""Designs of experiments, their analysis, and power: tables from small grids, effects from one aggregation."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import chi2_quantile, f_quantile, f_right, noncentral_f_cdf, noncentral_t_cdf, normal_cdf, normal_quantile, t_quantile
from .regression import Fit

#: First rows of the cyclic designs of 8, 12, 16, 20 and 24 runs.
CYCLIC = {8: "+++-+--", 12: "++-+++---+-", 16: "++++-+-++--+---", 20: "++--++++-+-+----++-", 24: "+++++-+-++--++--+-+----"}


def factorial(spark: SparkSession, factors: list[str], generators: dict[str, str] | None = None, centres: int = 0) -> DataFrame:
    """Two-level design in standard order; generators name further factors by products, such as D=ABC."""
    generators = generators or {}
    rows = []
    for run, levels in enumerate(product((-1, 1), repeat=len(factors)), 1):
        x = dict(zip(factors, levels[::-1], strict=True))
        x |= {g: math.prod(x[c] for c in word) for g, word in generators.items()}
        rows.append((run, False, *[float(x[f]) for f in [*factors, *generators]]))
    rows += [(len(rows) + k + 1, True, *[0.0] * (len(factors) + len(generators))) for k in range(centres)]
    return spark.createDataFrame(rows, "run int, centre boolean, " + ", ".join(f"`{f}` double" for f in [*factors, *generators]))


def plackett_burman(spark: SparkSession, factors: list[str], runs: int = 12) -> DataFrame:
    first = [1.0 if c == "+" else -1.0 for c in CYCLIC[runs]]
    if len(factors) > runs - 1:
        raise ValueError("too many factors for the runs")
    rows = [(k + 1, *[first[(j - k) % (runs - 1)] for j in range(len(factors))]) for k in range(runs - 1)] + [(runs, *[-1.0] * len(factors))]
    return spark.createDataFrame(rows, "run int, " + ", ".join(f"`{f}` double" for f in factors))


def central_composite(spark: SparkSession, factors: list[str], kind: str = "circumscribed", centres: int = 5) -> DataFrame:
    """Corners, axial points and centre points; alpha is 2^(k/4), 1 (faced), or corners shrunk (inscribed)."""
    k = len(factors)
    alpha = 1.0 if kind == "faced" else 2 ** (k / 4)
    shrink = 1 / alpha if kind == "inscribed" else 1.0
    rows = [("corner", *[s * shrink for s in x[::-1]]) for x in product((-1.0, 1.0), repeat=k)]
    rows += [("axial", *[(s * alpha * shrink if i == j else 0.0) for j in range(k)]) for i in range(k) for s in (-1, 1)]
    rows += [("centre", *[0.0] * k)] * centres
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "run int, point string, " + ", ".join(f"`{f}` double" for f in factors))


def box_behnken(spark: SparkSession, factors: list[str], centres: int = 3) -> DataFrame:
    """Pairs of factors at their corners with the others at the centre (3 to 5 factors)."""
    if not 3 <= len(factors) <= 5:
        raise ValueError("3 to 5 factors")
    rows = [[{a: x, b: y}.get(f, 0.0) for f in factors] for a, b in combinations(factors, 2) for y, x in product((-1.0, 1.0), repeat=2)]
    rows += [[0.0] * len(factors)] * centres
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "run int, " + ", ".join(f"`{f}` double" for f in factors))


def randomised(design: DataFrame, seed: int, blocks: int = 1) -> DataFrame:
    """Runs in a hashed order (the same for the same seed), dealt to blocks in turn."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy().orderBy(F.xxhash64(F.lit(seed), "run"), "run"))  # a design is small
    return design.withColumn("order", order).withColumn("block", (F.col("order") - 1) % blocks + 1)


def coded(value: Column, low: float, high: float) -> Column:
    return (value - (low + high) / 2) / ((high - low) / 2)


def actual(value: Column, low: float, high: float) -> Column:
    return (low + high) / 2 + value * ((high - low) / 2)


def effects(df: DataFrame, response: str, factors: list[str]) -> DataFrame:
    """Main effects and two-factor interactions of -1/1 factors: mean at + less mean at -, centre rows left out."""
    terms = [(f,) for f in factors] + list(combinations(factors, 2))
    rows = df.where(reduce(lambda a, b: a & b, [F.abs(f) == 1 for f in factors]))

    def one(term: tuple[str, ...]) -> Column:
        sign = reduce(lambda a, b: a * b, [F.col(f) for f in term])
        return F.struct(F.lit("*".join(term)).alias("term"), (F.avg(F.when(sign > 0, F.col(response))) - F.avg(F.when(sign < 0, F.col(response)))).alias("effect"))

    return rows.agg(F.array(*[one(t) for t in terms]).alias("e")).select(F.explode("e").alias("e")).select("e.*")


def _quadratic(df: DataFrame, factors: list[str]) -> tuple[DataFrame, list[str]]:
    squares = {f"{f}^2": F.col(f) ** 2 for f in factors}
    cross = {f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations(factors, 2)}
    return df.withColumns(squares | cross), [*factors, *squares, *cross]


def response_surface(df: DataFrame, response: str, factors: list[str]) -> DataFrame:
    """Coefficients of the full quadratic model, with errors and t."""
    wide, terms = _quadratic(df, factors)
    fit = Fit(wide.withColumnsRenamed({t: f"t{i}" for i, t in enumerate(terms)}), response, [f"t{i}" for i in range(len(terms))])
    rows = [(t, float(fit.beta[k]), math.sqrt(fit.cov[k, k]), float(fit.beta[k]) / math.sqrt(fit.cov[k, k])) for k, t in enumerate(["constant", *terms])]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, t double")


def lack_of_fit(df: DataFrame, response: str, factors: list[str]) -> DataFrame:
    """Lack-of-fit F of the quadratic model: pure error from rows of equal settings, in one grouping."""
    wide, terms = _quadratic(df, factors)
    fit = Fit(wide.withColumnsRenamed({t: f"t{i}" for i, t in enumerate(terms)}), response, [f"t{i}" for i in range(len(terms))])
    cells = df.where(F.col(response).isNotNull()).groupBy(*factors).agg(F.count("*").alias("_n"), F.var_pop(response).alias("_v"))
    pure, d = cells.agg(F.sum(F.col("_n") * F.col("_v")), F.sum(F.col("_n") - 1)).first()
    dl = fit.df - d
    f = ((fit.sse - pure) / dl) / (pure / d) if d and dl > 0 and pure else None
    return df.sparkSession.createDataFrame([(float(fit.sse - pure), int(dl), float(pure), int(d), f, f_right(f, dl, d) if f is not None else None)], "ss_lack double, df_lack int, ss_pure double, df_pure int, f double, p_value double")


def surface_grid(spark: SparkSession, coefficients: dict[str, float], x: str, y: str, places: int = 21, hold: dict[str, float] | None = None) -> DataFrame:
    """Predictions of a quadratic model over a grid of two coded factors, the others held."""
    at = lambda: F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: -1 + 2 * i / (places - 1))
    grid = spark.range(1).select(F.explode(at()).alias(x)).select(x, F.explode(at()).alias(y))
    held = hold or {}
    value = lambda f: F.col(f) if f in (x, y) else F.lit(held.get(f, 0.0))

    def term(t: str) -> Column:
        return F.lit(1.0) if t == "constant" else value(t[:-2]) ** 2 if t.endswith("^2") else reduce(lambda a, b: a * b, [value(f) for f in t.split("*")])

    return grid.withColumn("predicted", sum(c * term(t) for t, c in coefficients.items()))


def desirability(value: Column, goal: str, low: float, high: float, target: float | None = None) -> Column:
    """0 to 1: larger or smaller is better between low and high, or nearest to a target."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if goal == "maximize":
        return clip((value - low) / (high - low))
    if goal == "minimize":
        return clip((high - value) / (high - low))
    return clip(F.when(value <= target, (value - low) / (target - low)).otherwise((high - value) / (high - target)))


def t_power(n: int, difference: float, sigma: float, alpha: float = 0.05, samples: int = 1) -> float:
    """Power of the two-sided t test of one sample, or of two of n each."""
    df = samples * n - samples
    delta = difference / (sigma * math.sqrt(samples / n))
    c = t_quantile(1 - alpha / 2, df)
    return 1 - noncentral_t_cdf(c, df, delta) + noncentral_t_cdf(-c, df, delta)


def anova_power(n: int, groups: int, effect: float, alpha: float = 0.05) -> float:
    """Power of one-way ANOVA with n values a group and Cohen's effect f."""
    d1, d2 = groups - 1, groups * (n - 1)
    return 1 - noncentral_f_cdf(f_quantile(1 - alpha, d1, d2), d1, d2, n * groups * effect**2)


def proportion_power(n: int, p0: float, p1: float, alpha: float = 0.05) -> float:
    z, s0, s1 = normal_quantile(1 - alpha / 2), math.sqrt(p0 * (1 - p0) / n), math.sqrt(p1 * (1 - p1) / n)
    return normal_cdf((p1 - p0 - z * s0) / s1) + normal_cdf((-(p1 - p0) - z * s0) / s1)


def variance_power(n: int, ratio: float, alpha: float = 0.05) -> float:
    """Power of the two-sided chi-square test against a variance `ratio` times the hypothesised one."""
    from ..functions.special import chi2_right

    return chi2_right(chi2_quantile(1 - alpha / 2, n - 1) / ratio, n - 1) + 1 - chi2_right(chi2_quantile(alpha / 2, n - 1) / ratio, n - 1)


def sample_size(power, target: float, most: int = 1 << 20, **given) -> int:
    """The least n from 2 of which a power function reaches the target."""
    low, high = 1, 2
    while power(high, **given) < target:
        low, high = high, high * 2
        if high > most:
            raise ValueError("not reached")
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if power(mid, **given) < target else (low, mid)
    return high


def acceptance_curve(spark: SparkSession, n: int, c: int, places: int = 21, most: float = 0.2) -> DataFrame:
    """Probability that a sample of n with at most c defectives is accepted, over shares of defectives."""
    from ..functions.special import binomial_cdf

    rows = [(most * k / (places - 1), binomial_cdf(c, n, most * k / (places - 1))) for k in range(places)]
    return spark.createDataFrame(rows, "defective double, accepted double")


def two_proportion_power(n: int, p1: float, p2: float, alpha: float = 0.05) -> float:
    """Power of the two-sided normal test of two proportions, n each."""
    z, mid = normal_quantile(1 - alpha / 2), (p1 + p2) / 2
    s0, s1 = math.sqrt(2 * mid * (1 - mid) / n), math.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / n)
    return normal_cdf((abs(p1 - p2) - z * s0) / s1) + normal_cdf((-abs(p1 - p2) - z * s0) / s1)


def poisson_power(n: int, rate0: float, rate1: float, alpha: float = 0.05) -> float:
    """Power of the two-sided normal test of a rate over n units."""
    z, s0, s1 = normal_quantile(1 - alpha / 2), math.sqrt(rate0 / n), math.sqrt(rate1 / n)
    return normal_cdf((rate1 - rate0 - z * s0) / s1) + normal_cdf((rate0 - rate1 - z * s0) / s1)


def two_poisson_power(n: int, rate1: float, rate2: float, alpha: float = 0.05) -> float:
    z, s = normal_quantile(1 - alpha / 2), math.sqrt((rate1 + rate2) / n)
    return normal_cdf(abs(rate1 - rate2) / s - z) + normal_cdf(-abs(rate1 - rate2) / s - z)


def two_variance_power(n: int, ratio: float, alpha: float = 0.05) -> float:
    """Power of the two-sided F test of two samples of n whose variances have this ratio."""
    d = n - 1
    return f_right(f_quantile(1 - alpha / 2, d, d) / ratio, d, d) + 1 - f_right(f_quantile(alpha / 2, d, d) / ratio, d, d)


def equivalence_power(n: int, difference: float, lower: float, upper: float, sigma: float, alpha: float = 0.05, samples: int = 1) -> float:
    """Normal approximation of the power of two one-sided tests of one sample, or of two of n each."""
    z, se = normal_quantile(1 - alpha), sigma * math.sqrt(samples / n)
    return max(0.0, normal_cdf((upper - difference) / se - z) + normal_cdf((difference - lower) / se - z) - 1)


def factorial_power(replicates: int, factors: int, effect: float, sigma: float, alpha: float = 0.05) -> float:
    """Power to see an effect in a replicated two-level design of all factors with main effects and pairs."""
    n = replicates * 2**factors
    df = n - 1 - factors - factors * (factors - 1) // 2
    if df < 1:
        return 0.0
    c, delta = t_quantile(1 - alpha / 2, df), effect / (2 * sigma / math.sqrt(n))
    return 1 - noncentral_t_cdf(c, df, delta) + noncentral_t_cdf(-c, df, delta)
