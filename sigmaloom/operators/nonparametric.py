"""Rank tests: ranks come from counts of distinct values, so ties are exact and no window spans the rows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import quantiles
from .rows import mid_ranks


def _ties(df: DataFrame, value: str) -> DataFrame:
    c = df.groupBy(value).agg(F.count("*").cast("double").alias("_c"))
    return c.agg(F.sum(F.col("_c") ** 3 - F.col("_c")).alias("ties"))


def mann_whitney(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """W (rank sum of the first), U, tie-corrected z without continuity, and effect 1 - 2U/(n1 n2)."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isin(first, second))
    ranked = mid_ranks(rows, value)
    s = ranked.agg(F.sum(F.when(F.col(group) == first, F.col("mid_rank"))).alias("w"), F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) == second).alias("n2"))
    s = s.crossJoin(F.broadcast(_ties(rows, value)))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("w") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select("n1", "n2", "w", u.alias("u"), ((u - n1 * n2 / 2) / sd).alias("z"), (1 - 2 * u / (n1 * n2)).alias("effect"))


def wilcoxon(df: DataFrame, difference: Column) -> DataFrame:
    """Signed rank statistic of differences; zeros dropped, tie-corrected variance."""
    rows = df.select(difference.alias("d")).where(F.col("d").isNotNull() & (F.col("d") != 0)).withColumn("a", F.abs("d"))
    s = mid_ranks(rows, "a").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("mid_rank")).otherwise(0.0)).alias("w")).crossJoin(F.broadcast(_ties(rows, "a")))
    n = F.col("n").cast("double")
    return s.select("n", "w", ((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)).alias("z"))


def sign_test(df: DataFrame, value: Column, median: float) -> DataFrame:
    return df.agg(F.count_if(value < median).alias("below"), F.count_if(value == median).alias("equal"), F.count_if(value > median).alias("above"))


def mood_median(df: DataFrame, value: str, group: str) -> DataFrame:
    """Chi-square of counts not above and above the overall median, by level."""
    rows = df.where(F.col(value).isNotNull())
    mid = quantiles(rows, value, [], {"median": 0.5}).drop("_n")
    c = rows.crossJoin(F.broadcast(mid)).groupBy(group, "median").agg(F.count_if(F.col(value) <= F.col("median")).alias("low"), F.count_if(F.col(value) > F.col("median")).alias("high"))
    t = c.agg(F.sum("low").alias("tl"), F.sum("high").alias("th"))
    r = c.crossJoin(F.broadcast(t)).withColumn("n", F.col("low") + F.col("high"))
    e = [F.col("n") * F.col(k) / (F.col("tl") + F.col("th")) for k in ("tl", "th")]
    return r.agg(F.first("median").alias("median"), F.sum((F.col("low") - e[0]) ** 2 / e[0] + (F.col("high") - e[1]) ** 2 / e[1]).alias("chi_square"), (F.count("*") - 1).alias("df"))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """H, H corrected for ties, and degrees of freedom."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    g = mid_ranks(rows, value).groupBy(group).agg(F.count("*").alias("n"), F.sum("mid_rank").alias("r"))
    s = g.agg(F.sum("n").cast("double").alias("total"), F.sum(F.col("r") ** 2 / F.col("n")).alias("q"), (F.count("*") - 1).alias("df")).crossJoin(F.broadcast(_ties(rows, value)))
    h = 12 / (F.col("total") * (F.col("total") + 1)) * F.col("q") - 3 * (F.col("total") + 1)
    return s.select(F.col("total").cast("long").alias("n"), "df", h.alias("h"), (h / (1 - F.col("ties") / (F.col("total") ** 3 - F.col("total")))).alias("h_adjusted"))


def mean_ranks(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mean rank and its z by level, as a Kruskal-Wallis report has them."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    g = mid_ranks(rows, value).groupBy(group).agg(F.count("*").alias("n"), F.avg("mid_rank").alias("mean_rank"))
    total = g.agg(F.sum("n").cast("double").alias("total"))
    z = (F.col("mean_rank") - (F.col("total") + 1) / 2) / F.sqrt((F.col("total") + 1) * (F.col("total") / F.col("n") - 1) / 12)
    return g.crossJoin(F.broadcast(total)).select(group, "n", "mean_rank", z.alias("z"))


def dunn(df: DataFrame, value: str, group: str) -> DataFrame:
    """z of the difference of mean ranks of every pair of levels, tie-corrected."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    g = mean_ranks(df, value, group)
    total = rows.agg(F.count("*").cast("double").alias("total")).crossJoin(_ties(rows, value))
    a, b = g.alias("a"), g.alias("b")
    r = a.join(b, F.col(f"a.{group}") < F.col(f"b.{group}")).crossJoin(F.broadcast(total))  # levels, not rows
    var = (F.col("total") * (F.col("total") + 1) / 12 - F.col("ties") / (12 * (F.col("total") - 1))) * (1 / F.col("a.n") + 1 / F.col("b.n"))
    return r.select(F.col(f"a.{group}").alias("first"), F.col(f"b.{group}").alias("second"), ((F.col("a.mean_rank") - F.col("b.mean_rank")) / F.sqrt(var)).alias("z"))


def friedman(df: DataFrame, block: str, treatments: list[str]) -> DataFrame:
    """Friedman's S of columns of treatments, a row a block; ranks within the row, ties averaged."""
    complete = reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in treatments])
    rows = df.where(complete)
    k = len(treatments)
    rank = {t: 1 + reduce(add, [(F.col(o) < F.col(t)).cast("int") + (F.col(o) == F.col(t)).cast("int") / 2 for o in treatments if o != t]) for t in treatments}
    ties = reduce(add, [(lambda c: c * c - 1)(reduce(add, [(F.col(o) == F.col(t)).cast("double") for o in treatments])) for t in treatments])
    s = rows.agg(F.count("*").cast("double").alias("b"), *[F.sum(rank[t]).alias(f"r{i}") for i, t in enumerate(treatments)], F.sum(ties).alias("ties"))
    q = reduce(add, [F.col(f"r{i}") ** 2 for i in range(k)])
    stat = 12 / (F.col("b") * k * (k + 1)) * q - 3 * F.col("b") * (k + 1)
    return s.select(F.col("b").cast("long").alias("blocks"), F.lit(k - 1).alias("df"), stat.alias("s"), (stat / (1 - F.col("ties") / (F.col("b") * k * (k * k - 1)))).alias("s_adjusted"))


def mcnemar(df: DataFrame, first: Column, second: Column) -> DataFrame:
    s = df.agg(F.count_if(first & second).alias("both"), F.count_if(first & ~second).alias("only_first"), F.count_if(~first & second).alias("only_second"), F.count_if(~first & ~second).alias("neither"))
    b, c = F.col("only_first"), F.col("only_second")
    return s.withColumn("chi_square", F.when(b + c > 0, F.greatest(F.lit(0.0), F.abs(b - c) - 1.0) ** 2 / (b + c)))


def cochran_q(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Q of k binary treatments, a row a block."""
    k, x = len(columns), [c.cast("double") for c in columns]
    row = reduce(add, x)
    s = df.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"c{i}") for i, c in enumerate(x)], F.sum(row).alias("t"), F.sum(row * row).alias("rr"))
    cc = reduce(add, [F.col(f"c{i}") ** 2 for i in range(k)])
    return s.select("n", F.lit(k - 1).alias("df"), ((k - 1) * (k * cc - F.col("t") ** 2) / (k * F.col("t") - F.col("rr"))).alias("q"))


def spearman(df: DataFrame, first: str, second: str) -> DataFrame:
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    ranked = mid_ranks(mid_ranks(rows, first, alias="_ra"), second, alias="_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def median_interval_ranks(n: int, confidence: float) -> tuple[int, float]:
    """(order statistic from each end, achieved confidence) of the sign interval of a median."""
    from ..functions.special import binomial_cdf

    k = 0
    while 1 - 2 * binomial_cdf(k, n, 0.5) >= confidence:
        k += 1
    return k, 1 - 2 * binomial_cdf(k - 1, n, 0.5)


def quantile_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.select("*", F.percent_rank().over(w.orderBy(value)).alias("percent_rank"), F.cume_dist().over(w.orderBy(value)).alias("cume_dist"))
