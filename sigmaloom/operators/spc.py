"""Control charts and special-cause tests.

Charts of individual values take an order column and either `by`, columns that tell many series apart, or
none for one series, which is then cut into blocks with overlaps (plans.ordered). Limits come from one
aggregation, of a row a series, joined to the points.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import blocked, folded, forgotten_after, in_blocks, quantiles, with_levels

#: Mean and standard deviation of the relative range for 2 to 25 values.
D2 = (1.128, 1.693, 2.059, 2.326, 2.534, 2.704, 2.847, 2.970, 3.078, 3.173, 3.258, 3.336, 3.407, 3.472, 3.532, 3.588, 3.640, 3.689, 3.735, 3.778, 3.819, 3.858, 3.895, 3.931)
D3 = (0.853, 0.888, 0.880, 0.864, 0.848, 0.833, 0.820, 0.808, 0.797, 0.787, 0.778, 0.770, 0.763, 0.756, 0.750, 0.744, 0.739, 0.734, 0.729, 0.724, 0.720, 0.716, 0.712, 0.708)
#: Rows that make a test, and the tests that apply to a chart.
TESTS = {1: "one point beyond a control limit", 2: "nine points in a row on one side", 3: "six points in a row, all rising or all falling", 4: "fourteen points in a row, alternating", 5: "two of three points beyond two sigma, one side", 6: "four of five points beyond one sigma, one side", 7: "fifteen points in a row within one sigma", 8: "eight points in a row beyond one sigma"}
APPLICABLE = {"mr": (1, 2, 3, 4), "r": (1, 2, 3, 4), "s": (1, 2, 3, 4), "z_mr": (1, 2, 3, 4), "ewma": (1,), "g": (1,), "t": (1,), "ma": (1,), "zone": (), "cusum": ()}


def d2(n: int) -> float:
    return D2[n - 2]


def d3(n: int) -> float:
    return D3[n - 2]


def c4(n: int) -> float:
    return math.sqrt(2 / (n - 1)) * math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2))


def range_factors(n: int) -> tuple[float, float, float]:
    """(A2, D3, D4) of subgroups of n."""
    return 3 / (d2(n) * math.sqrt(n)), max(0.0, 1 - 3 * d3(n) / d2(n)), 1 + 3 * d3(n) / d2(n)


def applicable_tests(chart: str) -> tuple[int, ...]:
    return APPLICABLE.get(chart, tuple(TESTS))


def chosen_tests(chart: str, explicit: list[int] | None = None, policy: str = "") -> tuple[int, ...]:
    """Explicit tests first, then the policy test_1 (test 1 alone) or none, then all that apply."""
    wanted = explicit if explicit is not None else [1] if policy == "test_1" else [] if policy == "none" else list(TESTS)
    return tuple(t for t in applicable_tests(chart) if t in wanted)


def special_causes(points: DataFrame, window: Window, value: str, centre: str, sigma: str, lower: str, upper: str, tests: tuple[int, ...] = tuple(TESTS)) -> DataFrame:
    """points with test_1 .. test_8: every row of a span that meets a test is flagged.

    window orders the rows of a series (or a phase of it); spans reach at most 14 rows either way, so that
    blocks with that overlap do. A missing value, centre or limit breaks every span it is in.
    """
    x, z = F.col(value), (F.col(value) - F.col(centre)) / F.col(sigma)
    step = x - F.lag(x).over(window)
    df = points.withColumn("_z", z).withColumn("_side", F.signum(x - F.col(centre))).withColumn("_step", F.signum(step))
    df = df.withColumn("_turn", F.col("_step") * F.lag("_step").over(window))

    def all_of(flag: Column, k: int) -> Column:
        frame = window.rowsBetween(-(k - 1), 0)
        return (F.count_if(flag).over(frame) == k)

    def some_of(flag: Column, m: int, k: int) -> Column:
        frame = window.rowsBetween(-(k - 1), 0)
        return (F.count(F.col("_z")).over(frame) == k) & (F.count_if(flag).over(frame) >= m)

    one_side = lambda far: [F.col("_z") > far, F.col("_z") < -far]
    # a test's condition on the span that ends at a row, and the span's rows
    spans = {
        2: (reduce(or_, [all_of(F.col("_side") == s, 9) for s in (1, -1)]), 9),
        3: (reduce(or_, [all_of(F.col("_step") == s, 5) for s in (1, -1)]), 6),
        4: (all_of(F.col("_turn") == -1, 12), 14),
        5: (reduce(or_, [some_of(f, 2, 3) for f in one_side(2)]), 3),
        6: (reduce(or_, [some_of(f, 4, 5) for f in one_side(1)]), 5),
        7: (all_of(F.abs("_z") < 1, 15), 15),
        8: (all_of(F.abs("_z") > 1, 8), 8),
    }
    for t, (ends, _) in spans.items():
        if t in tests:
            df = df.withColumn(f"_e{t}", F.coalesce(ends, F.lit(False)))
    for t in TESTS:
        if t not in tests:
            df = df.withColumn(f"test_{t}", F.lit(False))
        elif t == 1:
            df = df.withColumn("test_1", F.coalesce((x < F.col(lower)) | (x > F.col(upper)), F.lit(False)))
        else:
            df = df.withColumn(f"test_{t}", F.max(f"_e{t}").over(window.rowsBetween(0, spans[t][1] - 1)))
    return df.drop("_z", "_side", "_step", "_turn", *[f"_e{t}" for t in spans])


def individuals(df: DataFrame, value: str, order: str, by: list[str] | None = None, length: int = 2, tests: tuple[int, ...] = tuple(TESTS), sigma_method: str = "average", carry: list[str] | None = None) -> DataFrame:
    """I-MR chart: value, moving range, both charts' limits and the tests of the values.

    sigma is the mean moving range over d2, or the median one over its own constant (sigma_method median).
    The first length-1 moving ranges are null.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, *(carry or []), order, F.col(value).cast("double").alias("value"))
    held, window = blocked(rows, order, 14 + length, 14, by=by)
    frame = window.rowsBetween(-(length - 1), 0)
    full = F.count("value").over(frame) == length
    held = held.withColumn("moving_range", F.when(full, F.max("value").over(frame) - F.min("value").over(frame)))
    home = held.where("_home")
    limits = home.groupBy(*by).agg(F.avg("value").alias("centre"), F.avg("moving_range").alias("mr_centre"), (F.avg("moving_range") / d2(length)).alias("sigma"))
    if sigma_method != "average":
        limits = with_levels(limits, quantiles(home, "moving_range", by, {"_m": 0.5}), by).withColumn("sigma", F.col("_m") / (0.954 if length == 2 else d2(length))).drop("_m", "_n")
    limits = limits.withColumn("lower", F.col("centre") - 3 * F.col("sigma")).withColumn("upper", F.col("centre") + 3 * F.col("sigma"))
    limits = limits.withColumn("mr_lower", range_factors(length)[1] * F.col("mr_centre")).withColumn("mr_upper", range_factors(length)[2] * F.col("mr_centre"))
    points = held.join(limits, by) if by else held.crossJoin(F.broadcast(limits))  # one row of limits
    marked = special_causes(points, window, "value", "centre", "sigma", "lower", "upper", tests)
    return marked.where("_home").drop("_home", "_own", "_block", "rank")


def sigma_from_ranges(df: DataFrame, value: str, order: str, by: list[str], length: int = 2) -> DataFrame:
    """sigma by series from moving ranges of consecutive values."""
    def ranges(w: Window) -> dict:
        frame = w.rowsBetween(-(length - 1), 0)
        return {"_mr": F.when(F.count(value).over(frame) == length, F.max(value).over(frame) - F.min(value).over(frame))}

    rows = in_blocks(df.where(F.col(value).isNotNull()).select(*by, order, value), order, by, length, 0, ranges)
    return rows.groupBy(*by).agg((F.avg("_mr") / d2(length)).alias("sigma"), F.count("*").alias("n"))


def subgroups(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    x = F.col(value)
    return df.where(x.isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.max(x) - F.min(x)).alias("range"), F.stddev_samp(x).alias("s"), F.sum(x).alias("total"))


def xbar_r(df: DataFrame, value: str, group: str, size: int) -> DataFrame:
    """X-bar and R limits of the subgroups of exactly `size` values."""
    a2, low, high = range_factors(size)
    sg = subgroups(df, value, [group]).where(F.col("n") == size)
    limits = sg.agg(F.avg("mean").alias("centre"), F.avg("range").alias("r_centre"))
    out = sg.crossJoin(F.broadcast(limits))
    return _flag(out, "mean", "centre", a2 * F.col("r_centre")).select(group, "mean", "range", "centre", "lower", "upper", "r_centre", (low * F.col("r_centre")).alias("r_lower"), (high * F.col("r_centre")).alias("r_upper"), "out")


def xbar_s(df: DataFrame, value: str, group: str, size: int) -> DataFrame:
    c = c4(size)
    spread = 3 * math.sqrt(1 - c * c) / c
    sg = subgroups(df, value, [group]).where(F.col("n") == size)
    limits = sg.agg(F.avg("mean").alias("centre"), F.avg("s").alias("s_centre"))
    out = _flag(sg.crossJoin(F.broadcast(limits)), "mean", "centre", 3 / (c * math.sqrt(size)) * F.col("s_centre"))
    return out.select(group, "mean", "s", "centre", "lower", "upper", "s_centre", (max(0.0, 1 - spread) * F.col("s_centre")).alias("s_lower"), ((1 + spread) * F.col("s_centre")).alias("s_upper"), "out")


def _flag(df: DataFrame, value: str, centre: str, reach: Column) -> DataFrame:
    df = df.withColumn("lower", F.col(centre) - reach).withColumn("upper", F.col(centre) + reach)
    return df.withColumn("out", (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))


def within_sigma(df: DataFrame, value: str, group: str, size: int) -> DataFrame:
    """Within-subgroup sigma: ranges up to subgroups of 8, standard deviations beyond."""
    sg = subgroups(df, value, [group]).where(F.col("n") == size)
    estimate = F.avg("range") / d2(size) if size <= 8 else F.avg("s") / c4(size)
    return sg.agg(estimate.alias("sigma_within"), F.count("*").alias("n_subgroups"))


def imr_rs(df: DataFrame, value: str, group: str, size: int) -> DataFrame:
    """Between and within spread of subgroups: limits of the means by their moving range, and sigmas."""
    sg = subgroups(df, value, [group]).where(F.col("n") == size)
    moving = in_blocks(sg, group, [], 1, 0, lambda w: {"mr": F.abs(F.col("mean") - F.lag("mean").over(w))})
    sums = moving.agg(F.avg("mean").alias("centre"), F.avg("mr").alias("mr_centre"), (F.avg("range") / d2(size) if size <= 8 else F.avg("s") / c4(size)).alias("sigma_within"), F.count("*").alias("n_subgroups"))
    means = F.col("mr_centre") / d2(2)
    between = F.sqrt(F.greatest(F.lit(0.0), means**2 - F.col("sigma_within") ** 2 / size))
    return sums.select("n_subgroups", "centre", "mr_centre", (F.col("centre") - 3 * means).alias("lower"), (F.col("centre") + 3 * means).alias("upper"), "sigma_within", between.alias("sigma_between"), F.sqrt(between**2 + F.col("sigma_within") ** 2).alias("sigma_total"))


def attribute_chart(df: DataFrame, kind: str, count: str, size: str | None = None, laney: bool = False, order: str | None = None) -> DataFrame:
    """p, np, c or u chart of a row a subgroup; laney widens p and u limits by the moving range of z scores."""
    n = F.col(size).cast("double") if size else F.lit(1.0)
    d = F.col(count).cast("double")
    total = df.agg((F.sum(d) / (F.sum(n) if kind != "c" else F.count("*"))).alias("_bar"))
    rows = df.crossJoin(F.broadcast(total))
    bar = F.col("_bar")
    value, centre, sd = {
        "p": (d / n, bar, F.sqrt(bar * (1 - bar) / n)), "np": (d, n * bar, F.sqrt(n * bar * (1 - bar))), "c": (d, bar, F.sqrt(bar)), "u": (d / n, bar, F.sqrt(bar / n)),
    }[kind]
    rows = rows.withColumn("value", value).withColumn("centre", centre).withColumn("_sd", sd)
    if laney:
        z = rows.withColumn("_z", (F.col("value") - F.col("centre")) / F.col("_sd"))
        steps = in_blocks(z.select(order, "_z"), order, [], 1, 0, lambda w: {"_mr": F.abs(F.col("_z") - F.lag("_z").over(w))})
        rows = rows.crossJoin(F.broadcast(steps.agg((F.avg("_mr") / d2(2)).alias("sigma_z")))).withColumn("_sd", F.col("_sd") * F.col("sigma_z"))
    rows = rows.withColumn("lower", F.greatest(F.lit(0.0), F.col("centre") - 3 * F.col("_sd")))
    upper = F.col("centre") + 3 * F.col("_sd")
    rows = rows.withColumn("upper", F.least(F.lit(1.0), upper) if kind == "p" else upper)
    return rows.withColumn("out", (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).drop("_bar", "_sd")


def moving_average(df: DataFrame, value: str, order: str, by: list[str], length: int = 5) -> DataFrame:
    """Means of the last `length` values against limits from the moving range; no limits before there are that many."""
    def means(w: Window) -> dict:
        frame = w.rowsBetween(-(length - 1), 0)
        return {"moving_average": F.when(F.count(value).over(frame) == length, F.avg(value).over(frame)), "_mr": F.abs(F.col(value) - F.lag(value).over(w))}

    rows = in_blocks(df.where(F.col(value).isNotNull()), order, by, max(1, length - 1), 0, means)
    limits = rows.groupBy(*by).agg(F.avg(value).alias("centre"), (F.avg("_mr") / d2(2) / math.sqrt(length) * 3).alias("_reach"))
    return _flag(with_levels(rows, limits, by).where("moving_average is not null"), "moving_average", "centre", F.col("_reach")).drop("_reach", "_mr")


def ewma(df: DataFrame, value: str, order: str, by: list[str], weight: float = 0.2, width: float = 3.0) -> DataFrame:
    """Exponentially weighted means from the series mean, with exact limits; sigma is the sample deviation."""
    from .timeseries import smoothed_levels

    def run(x: np.ndarray, at: int) -> dict:
        z = smoothed_levels(np.append(0.0, x[:, 0] - x[:, 1]), weight)[1:]
        n = np.arange(at + 1, at + len(x) + 1, dtype=float)
        reach = width * x[:, 2] * np.sqrt(weight / (2 - weight) * (1 - (1 - weight) ** (2 * n)))
        return {"ewma": x[:, 1] + z, "centre": x[:, 1], "lower": x[:, 1] - reach, "upper": x[:, 1] + reach, "out": np.abs(z) > reach}

    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_x"))
    rows = with_levels(rows, rows.groupBy(*by).agg(F.avg("_x").alias("_m"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("_s")), by)
    return folded(rows, order, by, ["_x", "_m", "_s"], run, "ewma double, centre double, lower double, upper double, out boolean", forgotten_after(1 - weight)).drop("_x", "_m", "_s")


def cusum(df: DataFrame, value: str, order: str, by: list[str], target: float, sigma: float, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """Tabular sums C+ and C- (negative) of a series, in blocks: a block starts with the sums that those before it leave.

    Within a block a sum is a running one less its least so far; over blocks, a row each, the same holds for their totals.
    """
    held, window = blocked(df.where(F.col(value).isNotNull()), order, 0, 0, by=by)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value) - target
    held = held.withColumns({"_u": F.sum(x - k * sigma).over(upto), "_l": F.sum(-x - k * sigma).over(upto)})
    held = held.withColumns({f"_f{c}": F.min(f"_{c}").over(upto) for c in "ul"})
    ends = held.groupBy(*by, "_block").agg(*[F.max_by(f"_{c}", "rank").alias(f"_s{c}") for c in "ul"], *[F.min(f"_f{c}").alias(f"_m{c}") for c in "ul"])
    blocks = Window.partitionBy(*by).orderBy("_block")  # a row a block
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"_p{c}": F.coalesce(F.sum(f"_s{c}").over(before), F.lit(0.0)) for c in "ul"})
    lowest = lambda c: F.least(F.lit(0.0), F.min(F.col(f"_p{c}") + F.col(f"_m{c}")).over(before))
    ends = ends.select(*by, "_block", *[(F.col(f"_p{c}") - lowest(c)).alias(f"_start{c}") for c in "ul"])
    rows = with_levels(held, ends, [*by, "_block"])
    sums = {c: F.col(f"_{c}") - F.least(-F.col(f"_start{c}"), F.col(f"_f{c}")) for c in "ul"}
    rows = rows.withColumns({"cusum_upper": sums["u"], "cusum_lower": -sums["l"]})
    rows = rows.withColumn("out", (F.col("cusum_upper") > h * sigma) | (F.col("cusum_lower") < -h * sigma))
    return rows.drop("_home", "_own", "_block", "rank", *[f"_{p}{c}" for p in ("", "f", "start") for c in "ul"])


def zone(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Zone scores: weights 0, 1, 2, 4 by whole sigmas of distance add up until a change of side or a weight of 0; 8 signals."""
    held, window = blocked(df.where(F.col(value).isNotNull()), order, 1, 0, by=by)
    held = held.withColumn("_mr", F.abs(F.col(value) - F.lag(value).over(window)))
    limits = held.where("_home").groupBy(*by).agg(F.avg(value).alias("centre"), (F.avg("_mr") / d2(2)).alias("sigma"))
    z = (F.col(value) - F.col("centre")) / F.col("sigma")
    rows = with_levels(held, limits, by).withColumn("_z", z).withColumn("_side", F.signum("_z"))
    rows = rows.withColumn("weight", F.when(F.abs("_z") < 1, 0).when(F.abs("_z") < 2, 1).when(F.abs("_z") < 3, 2).otherwise(4))
    new = (F.col("weight") == 0) | (F.col("_side") != F.coalesce(F.lag("_side").over(window), F.lit(0.0)))
    rows = rows.withColumn("_new", new.cast("int")).where("_home")
    rows = rows.withColumn("_run", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))  # 0 until the first new run of the block
    run = Window.partitionBy(*by, "_block", "_run").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("score", F.sum("weight").over(run))
    ends = rows.groupBy(*by, "_block").agg(F.max("_run").alias("_runs"), F.max_by("score", "rank").alias("_tail"))
    blocks = Window.partitionBy(*by).orderBy("_block")  # a row a block
    ends = ends.withColumn("_g", F.sum((F.col("_runs") > 0).cast("int")).over(blocks))
    ends = ends.withColumn("_left", F.sum("_tail").over(Window.partitionBy(*by, "_g").orderBy("_block")))
    ends = ends.select(*by, "_block", F.coalesce(F.lag("_left").over(blocks), F.lit(0)).alias("_carry"))  # of the run that goes on
    rows = with_levels(rows, ends, [*by, "_block"]).withColumn("score", F.col("score") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0))
    return rows.withColumn("out", F.col("score") >= 8).drop("_mr", "_z", "_side", "_run", "_new", "_carry", "_home", "_own", "_block", "rank")


def z_mr(df: DataFrame, value: str, order: str, part: str) -> DataFrame:
    """Standardised values of several parts: each part's mean, one sigma from all moving ranges within parts."""
    rows = in_blocks(df.where(F.col(value).isNotNull()), order, [part], 1, 0, lambda w: {"_mr": F.abs(F.col(value) - F.lag(value).over(w))})
    rows = rows.crossJoin(F.broadcast(rows.agg((F.avg("_mr") / d2(2)).alias("sigma")))).join(rows.groupBy(part).agg(F.avg(value).alias("centre")), part)
    return rows.withColumn("z", (F.col(value) - F.col("centre")) / F.col("sigma")).withColumn("z_range", F.col("_mr") / F.col("sigma")).withColumn("out", F.abs("z") > 3).drop("_mr")


def g_chart(df: DataFrame, interval: str) -> DataFrame:
    """Limits of counts between rare events by interpolated quantiles of the geometric distribution."""
    s = df.agg(F.avg(interval).alias("mean"), F.count(interval).alias("n"))
    q = 1 - 1 / (F.col("mean") + 1)

    def quantile(p: float) -> Column:
        k = F.floor(F.log(F.lit(1 - p)) / F.log(q)) + 1
        before, at = 1 - F.pow(q, k - 1), 1 - F.pow(q, k)
        return F.greatest(F.lit(0.0), k - 1 + (p - before) / (at - before) - 1)

    return s.select("n", "mean", quantile(0.00135).alias("lower"), quantile(0.5).alias("centre"), quantile(0.99865).alias("upper"))


def runs(df: DataFrame, value: str, order: str, by: list[str], about: str = "median") -> DataFrame:
    """Runs above and not above the median or mean: their number, what chance expects, and the normal statistic."""
    rows = df.where(F.col(value).isNotNull()).select(*by, order, value)
    mid = quantiles(rows, value, by, {"_mid": 0.5}).drop("_n") if about == "median" else rows.groupBy(*by).agg(F.avg(value).alias("_mid"))
    rows = with_levels(rows, mid, by).withColumn("_up", F.col(value) > F.col("_mid"))
    rows = in_blocks(rows, order, by, 1, 0, lambda w: {"_new": F.coalesce(F.col("_up") != F.lag("_up").over(w), F.lit(True))})
    s = rows.groupBy(*by).agg(F.count_if("_new").alias("runs"), F.count_if("_up").alias("above"), F.count_if(~F.col("_up")).alias("below"), F.first("_mid").alias("criterion"))
    a, b = F.col("above").cast("double"), F.col("below").cast("double")
    n = a + b
    expected, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    return s.select(*by, "criterion", "runs", "above", "below", expected.alias("expected"), ((F.col("runs") - expected) / F.sqrt(var)).alias("z"))


def hotelling(df: DataFrame, columns: list[str], alpha: float = 0.0027) -> DataFrame:
    """df with t2 of each complete row and the phase-1 limit; mean and covariance from one aggregation."""
    import numpy as np

    from ..functions.special import beta_quantile

    rows, p = df.where(reduce(and_, [F.col(c).isNotNull() for c in columns])), len(columns)
    sums = rows.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_samp(a, b) for a in columns for b in columns]).first()
    n, mean = sums[0], sums[1 : p + 1]
    inverse = np.linalg.inv(np.array(sums[p + 1 :]).reshape(p, p))
    off = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    t2 = reduce(lambda x, y: x + y, [off[i] * off[j] * float(inverse[i, j]) for i in range(p) for j in range(p)])
    limit = (n - 1) ** 2 / n * beta_quantile(1 - alpha, p / 2, (n - p - 1) / 2)
    return rows.withColumn("t2", t2).withColumn("upper", F.lit(limit)).withColumn("out", F.col("t2") > limit)


def generalized_variance(df: DataFrame, first: str, second: str, group: str, size: int) -> DataFrame:
    """|S| of each subgroup of two measures against limits from its mean."""
    sg = df.groupBy(group).agg(F.count("*").alias("n"), (F.var_samp(first) * F.var_samp(second) - F.covar_samp(first, second) ** 2).alias("gv")).where(F.col("n") == size)
    n, p = size, 2
    product = math.prod(n - i for i in range(1, p + 1))
    b1 = product / (n - 1) ** p
    b2 = product * (math.prod(n - i + 2 for i in range(1, p + 1)) - product) / (n - 1) ** (2 * p)
    out = sg.crossJoin(F.broadcast(sg.agg(F.avg("gv").alias("centre")))).withColumn("_s", F.col("centre") / b1 * math.sqrt(b2))
    return out.select(group, "gv", "centre", F.greatest(F.lit(0.0), F.col("centre") - 3 * F.col("_s")).alias("lower"), (F.col("centre") + 3 * F.col("_s")).alias("upper")).withColumn("out", (F.col("gv") < F.col("lower")) | (F.col("gv") > F.col("upper")))


def mewma(df: DataFrame, columns: list[str], order: str, by: list[str], weight: float = 0.1, alpha: float = 0.0027) -> DataFrame:
    """Multivariate EWMA statistic of a series; covariance of the series, limit by the chi-square quantile."""
    from ..functions.special import chi2_quantile

    limit, p = chi2_quantile(1 - alpha, len(columns)), len(columns)

    def run(x: np.ndarray, at: int) -> dict:
        centred, cov = x[:, :p] - x[:, p : 2 * p], x[0, 2 * p :].reshape(p, p)
        inverse = np.linalg.pinv(cov) if np.isfinite(cov).all() else np.zeros((p, p))
        z = np.column_stack([_levels(np.append(0.0, c), weight)[1:] for c in centred.T])
        n = np.arange(at + 1, at + len(x) + 1, dtype=float)
        out = np.einsum("ij,jk,ik->i", z, inverse, z) / (weight * (1 - (1 - weight) ** (2 * n)) / (2 - weight))
        return {"statistic": out, "upper": np.full(len(x), limit), "out": out > limit}

    from .timeseries import smoothed_levels as _levels

    rows = df.where(reduce(and_, [F.col(c).isNotNull() for c in columns])).select(*by, order, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    names = [f"_x{i}" for i in range(p)]
    level = rows.groupBy(*by).agg(*[F.avg(n).alias(f"_m{n}") for n in names], *[F.covar_samp(a, b).alias(f"_c{a}{b}") for a in names for b in names])
    held = with_levels(rows, level, by)
    made = folded(held, order, by, [*names, *[f"_m{n}" for n in names], *[f"_c{a}{b}" for a in names for b in names]], run, "statistic double, upper double, out boolean", forgotten_after(1 - weight))
    return made.select(*by, order, "statistic", "upper", "out")
