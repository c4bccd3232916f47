"""Descriptive summaries and the data of plots: one aggregation each, the distinct level or bin as group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import in_blocks, quantiles, running, with_levels

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def descriptive(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """N, mean, spread, quartiles (linear at p(n-1)), sample-adjusted skewness and excess kurtosis, by level."""
    x, n = F.col(column), F.count(column)
    n_ = n.cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    s = df.groupBy(*(by or [])).agg(
        n.alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(n_)).alias("se_mean"),
        F.stddev_samp(x).alias("stdev"), F.stddev_pop(x).alias("stdev_pop"), F.var_samp(x).alias("variance"), F.min(x).alias("minimum"),
        F.max(x).alias("maximum"), (F.max(x) - F.min(x)).alias("range"), F.sum(x).alias("sum"),
        F.when(n > 2, g1 * F.sqrt(n_ * (n_ - 1)) / (n_ - 2)).alias("skewness"),
        F.when(n > 3, (n_ - 1) / ((n_ - 2) * (n_ - 3)) * ((n_ + 1) * g2 + 6)).alias("kurtosis"),
    )
    q = quantiles(df, column, by, QUARTILES).withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.select(*[F.col(c).alias(f"_by_{c}") for c in by or []], "q1", "median", "q3", "iqr")
    same = F.lit(True)
    for c in by or []:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return s.join(q, same, "left").drop(*[f"_by_{c}" for c in by or []])  # a level without values has no quartiles


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """bin, low, high and count of equal bins from least to greatest, empty ones too; the last one is closed."""
    x = F.col(column).cast("double")
    ends = df.where(x.isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))
    k = F.lit(bins) if bins else F.greatest(F.lit(5), F.least(F.lit(30), F.ceil(F.log2("n") + 1)))
    ends = ends.where("n > 0").withColumn("k", k.cast("int")).withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    ends = ends.withColumn("w", (F.col("hi") - F.col("lo")) / F.col("k"))
    at = F.least(F.floor((x - F.col("lo")) / F.col("w")), F.col("k") - 1).cast("int")
    counts = df.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
    grid = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("c", F.lit(0)).alias("count"))


def histogram_edges(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts between given edges, the last one inclusive; values outside are left out."""
    x = F.col(column).cast("double")
    pairs = F.array(*[F.lit(float(e)) for e in edges])
    at = F.least(F.size(F.filter(pairs, lambda e: e <= x)), F.lit(len(edges) - 1))
    inside = df.where((x >= edges[0]) & (x <= edges[-1]))
    counts = inside.groupBy((at - 1).alias("bin")).agg(F.count("*").alias("c"))
    grid = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.element_at(pairs, F.col("bin") + 1).alias("low"), F.element_at(pairs, F.col("bin") + 2).alias("high"), F.coalesce("c", F.lit(0)).alias("count"))


def box_plot(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers inside 1.5 interquartile ranges and the number of outliers, by level."""
    q = quantiles(df, column, by, QUARTILES).withColumnRenamed("_n", "n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(column) >= F.col("q1") - reach) & (F.col(column) <= F.col("q3") + reach)
    rows = with_levels(df.where(F.col(column).isNotNull()), q, by)
    return rows.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(column))).alias("whisker_low"), F.max(F.when(inside, F.col(column))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers")
    )


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """A step at each distinct value; counts are summed over distinct values, not over rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    return running(counts, [], ["x"], {"u": F.col("c")}).crossJoin(F.broadcast(total)).select("x", (F.col("u") / F.col("n")).alias("probability"))


def bar_counts(df: DataFrame, category: str, order: str, weight: str | None = None) -> DataFrame:
    """Sum of weights (rows) by category and its first place in the table's order."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.sum(w).alias("total"), F.min(order).alias("first_row"))


def pareto(df: DataFrame, category: str, weight: str | None = None, threshold: float = 100.0) -> DataFrame:
    """Categories by falling count; once the running share has passed the threshold the rest is Other."""
    c = F.col(category).cast("string")
    w = F.col(weight) if weight else F.lit(1)
    counts = df.where(c.isNotNull() & ~F.trim(c).isin("", "*")).groupBy(c.alias("category")).agg(F.sum(w).alias("count"))
    order = [F.desc("count"), "category"]
    before, all_ = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shares = counts.withColumn("total", F.sum("count").over(all_)).withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    other = 100 * F.col("before") / F.col("total") > threshold
    rows = shares.groupBy(F.when(other, "Other").otherwise(F.col("category")).alias("category"), other.alias("is_other")).agg(F.sum("count").alias("count"), F.max("total").alias("total"))
    upto = Window.orderBy("is_other", *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("category", "count", (100 * F.col("count") / F.col("total")).alias("percent"), (100 * F.sum("count").over(upto) / F.col("total")).alias("cumulative_percent"))


def pie(df: DataFrame, category: str, weight: str | None = None, other_below: float = 5.0) -> DataFrame:
    """Shares of categories; those under other_below percent are one slice Other."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    counts = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.sum(w).alias("w"))
    shares = counts.withColumn("percent", 100 * F.col("w") / F.sum("w").over(Window.partitionBy()))
    name = F.when(F.col("percent") < other_below, "Other").otherwise(F.col("category"))
    return shares.groupBy(name.alias("category")).agg(F.sum("w").alias("weight"), F.sum("percent").alias("percent"))


def kde(df: DataFrame, column: str, grid: int = 64, bandwidth: float | None = None, bins: int = 4096) -> DataFrame:
    """Gaussian kernel density at grid places, bandwidth by Silverman's rule.

    Values are first counted in distinct values, or in `bins` fine bins if there are more of these, so the
    kernels meet the grid once for each of a bounded number of places.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x"))
    s = rows.agg(F.count("*").alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.approx_count_distinct("x").alias("d")).first()
    if not s.n or s.n < 2:
        return df.sparkSession.createDataFrame([], "x double, density double")
    q = quantiles(rows, "x", [], QUARTILES).first()
    h = bandwidth or 0.9 * min(v for v in (s.s, (q.q3 - q.q1) / 1.34) if v > 0) * s.n**-0.2 if (s.s or 0) > 0 else 1.0
    place = F.col("x") if s.d <= bins / 2 else F.lit(s.lo) + (F.floor((F.col("x") - s.lo) / (s.hi - s.lo) * bins) + 0.5) * ((s.hi - s.lo) / bins)
    places = rows.groupBy(place.alias("v")).agg(F.count("*").alias("c"))
    step = (s.hi - s.lo + 6 * h) / (grid - 1)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.lit(s.lo - 3 * h) + i * step))
    u = (F.col("x") - F.col("v")) / h
    return places.select("v", "c", at.alias("x")).groupBy("x").agg((F.sum(F.col("c") * F.exp(-0.5 * u * u)) / (s.n * h * math.sqrt(2 * math.pi))).alias("density"))


def bins_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Counts of a rectangular grid, only of bins that hold rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = rows.agg(*[f(F.col(c).cast("double")).alias(f"{a}_{k}") for k, c in (("x", x), ("y", y)) for a, f in (("lo", F.min), ("hi", F.max))])

    def at(c: str, k: str) -> Column:
        width = F.when(F.col(f"hi_{k}") > F.col(f"lo_{k}"), F.col(f"hi_{k}") - F.col(f"lo_{k}")).otherwise(1.0) / bins
        return F.least(F.floor((F.col(c) - F.col(f"lo_{k}")) / width), F.lit(bins - 1)).cast("int")

    return rows.crossJoin(F.broadcast(ends)).groupBy(at(x, "x").alias("x_bin"), at(y, "y").alias("y_bin")).agg(F.count("*").alias("count"))


def interval(df: DataFrame, column: str, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Mean and its t interval by level; levels of one value have no interval."""
    from ..functions.special import t_quantile_col

    x = F.col(column)
    rows = df.where(x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("s"))
    half = F.when(F.col("n") > 1, t_quantile_col(1 - (1 - confidence) / 2, F.greatest(F.col("n") - 1, F.lit(1))) * F.col("s") / F.sqrt("n"))
    return rows.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def category_heatmap(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(row, column).agg(F.avg(value).alias("mean"), F.count("*").alias("count"))


def variability(df: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """n, mean and s of each cell of the factors; s is 0 in cells of one value."""
    x = F.col(value)
    return df.where(x.isNotNull()).groupBy(*factors).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("s"))


def multi_vari(df: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """Means of each level of each factor and of each full cell, by grouping sets."""
    view = df.where(F.col(value).isNotNull())
    sets = [[F.col(f)] for f in factors] + [[F.col(f) for f in factors]]
    out = view.groupingSets(sets, *[F.col(f) for f in factors]).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out


def cause_and_effect(df: DataFrame, category: str, cause: str) -> DataFrame:
    """Distinct causes of each category, in order of their names."""
    return df.where(F.col(category).isNotNull() & F.col(cause).isNotNull()).groupBy(category).agg(F.array_join(F.array_sort(F.collect_set(cause)), "; ").alias("causes"), F.countDistinct(cause).alias("n_causes"))


def cross_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """All cells of rows x columns: count, expected, shares and residuals (Pearson, adjusted)."""
    counts = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("o"))
    rows, columns = counts.groupBy("r").agg(F.sum("o").alias("rn")), counts.groupBy("c").agg(F.sum("o").alias("cn"))
    total = counts.agg(F.sum("o").alias("n"))
    cells = rows.crossJoin(columns).crossJoin(total).join(counts, ["r", "c"], "left")  # levels, not rows
    o, e = F.coalesce("o", F.lit(0)), F.col("rn") * F.col("cn") / F.col("n")
    residual = (o - e) / F.sqrt(e)
    return cells.select(
        F.col("r").alias(row), F.col("c").alias(column), o.alias("count"), e.alias("expected"), (100 * o / F.col("rn")).alias("row_percent"), (100 * o / F.col("cn")).alias("column_percent"),
        (100 * o / F.col("n")).alias("total_percent"), residual.alias("residual"),
        (residual / F.sqrt((1 - F.col("rn") / F.col("n")) * (1 - F.col("cn") / F.col("n")))).alias("adjusted_residual"),
    )


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Pearson and likelihood-ratio statistics of association; p only where every expected count is 1 or more."""
    from ..functions.special import chi2_right_col

    cells = cross_table(df, row, column)
    o, e = F.col("count"), F.col("expected")
    out = cells.agg(
        F.sum((o - e) ** 2 / e).alias("chi_square"), (2 * F.sum(F.when(o > 0, o * F.log(o / e)).otherwise(0.0))).alias("likelihood_ratio"),
        ((F.countDistinct(row) - 1) * (F.countDistinct(column) - 1)).alias("df"), F.min("expected").alias("least_expected"), F.sum("count").alias("n"),
    )
    return out.withColumn("p_value", F.when((F.col("least_expected") >= 1) & (F.col("df") > 0), chi2_right_col(F.col("chi_square"), F.col("df"))))


def chi_square_fit(df: DataFrame, category: str, proportions: dict[str, float] | None = None) -> DataFrame:
    """Observed, expected and contribution by category, equal or given proportions."""
    if proportions is not None and abs(sum(proportions.values()) - 1) > 1e-8:
        raise ValueError("proportions must sum to 1")
    counts = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count("*").alias("observed"))
    all_ = Window.partitionBy()
    share = 1 / F.count("*").over(all_) if proportions is None else F.create_map(*[F.lit(x) for kv in proportions.items() for x in kv])[F.col("category")]
    rows = counts.withColumn("expected", share * F.sum("observed").over(all_))
    return rows.withColumn("contribution", (F.col("observed") - F.col("expected")) ** 2 / F.col("expected"))


def scaled(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with columns from 0 to 1 by their least and greatest; 0.5 where these are equal."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"_{a}_{c}") for c in names for a, f in (("lo", F.min), ("hi", F.max))])
    rows = df.crossJoin(F.broadcast(ends))  # one row
    for c, alias in names.items():
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        rows = rows.withColumn(alias, F.when(width > 0, (F.col(c) - F.col(f"_lo_{c}")) / F.when(width > 0, width)).when(F.col(c).isNotNull(), 0.5))
    return rows.drop(*ends.columns)


def first_levels(df: DataFrame, facet: str, order: str, most: int = 6) -> DataFrame:
    """Rows of the levels that appear first: a plot has panels for these alone."""
    levels = df.where(F.col(facet).isNotNull()).groupBy(facet).agg(F.min(order).alias("_first")).orderBy("_first", facet).limit(most)
    return df.join(F.broadcast(levels.select(facet)), facet, "left_semi")


def lagged(df: DataFrame, value: str, order: str, by: list[str], lag: int = 1) -> DataFrame:
    return in_blocks(df.where(F.col(value).isNotNull()), order, by, lag, 0, lambda w: {"before": F.lag(value, lag).over(w)})


def poisson_fit(df: DataFrame, count: str) -> DataFrame:
    """Observed and expected rows of each count that occurs, by a Poisson distribution of the same mean."""
    x = F.col(count)
    c = df.where(x >= 0).groupBy(x.cast("long").alias("x")).agg(F.count("*").alias("observed"))
    total = c.agg(F.sum("observed").alias("n"), (F.sum(F.col("x") * F.col("observed")) / F.sum("observed")).alias("mean"))
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("x"), F.lit(1))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    return c.crossJoin(F.broadcast(total)).select("x", "observed", (F.col("n") * F.exp(-F.col("mean") + F.col("x") * F.log("mean") - log_factorial)).alias("expected"))


def contour(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Mean z of every x and y that occur, and whether all pairs of their levels do (a regular grid)."""
    cells = df.where(F.col(z).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.avg(z).alias("z"))
    whole = cells.agg((F.count("*") == F.countDistinct("x") * F.countDistinct("y")).alias("regular"))
    return cells.crossJoin(F.broadcast(whole))


def bubble_points(df: DataFrame, x: str, y: str, size: str, order: str) -> DataFrame:
    """Rows with both coordinates and a size of 0 or more."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(size) >= 0)).select(order, F.col(x).alias("x"), F.col(y).alias("y"), F.col(size).alias("size"))


def matrix_points(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The points of every pair of columns over rows that have all of them."""
    whole = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    pairs = F.array(*[F.struct(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]])
    return whole.select(order, F.explode(pairs).alias("p")).select(order, "p.*")


def marginal_counts(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Histograms of both coordinates over the rows that have both: axis, bin, count."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = rows.agg(*[f(F.col(c).cast("double")).alias(f"{k}{a}") for k, c in (("x", x), ("y", y)) for a, f in (("lo", F.min), ("hi", F.max))])

    def at(c: str, k: str) -> Column:
        width = F.when(F.col(f"{k}hi") > F.col(f"{k}lo"), F.col(f"{k}hi") - F.col(f"{k}lo")).otherwise(1.0) / bins
        return F.struct(F.lit(k).alias("axis"), F.least(F.floor((F.col(c) - F.col(f"{k}lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))

    return rows.crossJoin(F.broadcast(ends)).select(F.explode(F.array(at(x, "x"), at(y, "y"))).alias("p")).groupBy("p.axis", "p.bin").agg(F.count("*").alias("count"))


def stacked_area(df: DataFrame, value: str, order: str, by: str) -> DataFrame:
    """Edges of stacked areas: at each place, series in order of their names one on the other."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(order, by).agg(F.sum(F.col(value).cast("double")).alias("height"))
    here = Window.partitionBy(order).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)  # a row a series
    return rows.withColumn("top", F.sum("height").over(here)).select(order, by, (F.col("top") - F.col("height")).alias("bottom"), "top")
