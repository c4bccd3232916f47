"""Measurement systems: gage studies, bias and linearity, attribute agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crossed_gage(df: DataFrame, value: str, part: str, operator: str, tolerance: float | None = None) -> DataFrame:
    """Variance components of a balanced crossed study, the interaction kept: a row a source.

    Negative components count as 0 in the shares; raw_variance keeps them. An unbalanced study gives no rows.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(part, operator).agg(F.count("*").alias("r"), F.avg(value).alias("m"), F.sum(value).alias("t"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    a = cells.groupBy(part).agg(F.avg("m").alias("m"))
    b = cells.groupBy(operator).agg(F.avg("m").alias("m"))
    c = cells.agg(F.min("r").alias("r"), F.max("r").alias("r_max"), F.count("*").alias("cells"), F.var_pop("m").alias("vm"), F.avg("v").alias("e"))
    c = c.crossJoin(a.agg(F.count("*").alias("p"), F.var_pop("m").alias("va"))).crossJoin(b.agg(F.count("*").alias("o"), F.var_pop("m").alias("vb")))  # one row each
    c = c.where("r = r_max and cells = p * o and r > 1 and p > 1 and o > 1")
    p, o, r = (F.col(x).cast("double") for x in ("p", "o", "r"))
    ms_p, ms_o = o * r * p * F.col("va") / (p - 1), p * r * o * F.col("vb") / (o - 1)
    ms_po = r * p * o * (F.col("vm") - F.col("va") - F.col("vb")) / ((p - 1) * (o - 1))
    e = F.col("e")
    raw = {"repeatability": e, "operator": (ms_o - ms_po) / (p * r), "interaction": (ms_po - e) / r, "part": (ms_p - ms_po) / (o * r)}
    kept = {k: F.greatest(F.lit(0.0), v) for k, v in raw.items()}
    kept["reproducibility"] = kept["operator"] + kept["interaction"]
    kept["gage"] = kept["repeatability"] + kept["reproducibility"]
    kept["total"] = kept["gage"] + kept["part"]
    rows = F.array(*[F.struct(F.lit(k).alias("source"), v.alias("variance"), raw.get(k, v).alias("raw_variance"), kept["total"].alias("t"), kept["part"].alias("vp"), kept["gage"].alias("vg")) for k, v in kept.items()])
    out = c.select(F.explode(rows).alias("x")).select("x.*")
    sd = F.sqrt("variance")
    ndc = F.greatest(F.lit(1), F.floor(1.41 * F.sqrt(F.col("vp") / F.col("vg"))).cast("int"))
    share = [(100 * 6 * sd / tolerance).alias("percent_tolerance")] if tolerance else []
    return out.select("source", "variance", "raw_variance", sd.alias("stdev"), (6 * sd).alias("study_variation"), (100 * F.col("variance") / F.col("t")).alias("percent_contribution"), (100 * sd / F.sqrt("t")).alias("percent_study"), *share, ndc.alias("ndc"))


def emp_class(gage: DataFrame) -> DataFrame:
    """Intraclass correlation of a crossed study and its class of monitor."""
    v = lambda s: F.max(F.when(F.col("source") == s, F.col("variance")))
    s = gage.agg((v("part") / v("total")).alias("icc"), (v("part") / (v("part") + v("repeatability"))).alias("icc_without_bias"))
    return s.withColumn("monitor", F.when(F.col("icc") >= 0.8, "first").when(F.col("icc") >= 0.5, "second").when(F.col("icc") >= 0.2, "third").otherwise("fourth"))


def nested_gage(df: DataFrame, value: str, part: str, operator: str) -> DataFrame:
    """Variance components of a balanced study whose parts are nested in operators."""
    cells = df.where(F.col(value).isNotNull()).groupBy(operator, part).agg(F.count("*").alias("r"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    ops = cells.groupBy(operator).agg(F.count("*").alias("p"), F.min("r").alias("r"), F.max("r").alias("rx"), F.avg("m").alias("m"), F.var_samp("m").alias("vp"), F.avg("v").alias("e"))
    s = ops.agg(F.count("*").alias("o"), F.min("p").alias("p"), F.max("p").alias("px"), F.min("r").alias("r"), F.max("rx").alias("rx"), F.var_samp("m").alias("vo"), F.avg("vp").alias("vp"), F.avg("e").alias("e")).where("p = px and r = rx")
    part_var, op_var = F.col("vp") - F.col("e") / F.col("r"), F.col("vo") - F.col("vp") / F.col("p")
    zero = lambda c: F.greatest(F.lit(0.0), c)
    return s.select(F.col("e").alias("repeatability"), zero(op_var).alias("reproducibility"), zero(part_var).alias("part"), (F.col("e") + zero(op_var) + zero(part_var)).alias("total"))


def type_1(df: DataFrame, value: str, reference: float, tolerance: float) -> DataFrame:
    """Bias against a reference with its t, and Cg and Cgk of the whole tolerance."""
    s = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    bias = F.col("mean") - reference
    return s.select("n", "mean", "s", bias.alias("bias"), (bias / (F.col("s") / F.sqrt("n"))).alias("t"), (tolerance / (6 * F.col("s"))).alias("cg"), (F.least(tolerance / 2 + bias, tolerance / 2 - bias) / (3 * F.col("s"))).alias("cgk"), (100 * 6 * F.col("s") / tolerance).alias("percent_tolerance"))


def bias_linearity(df: DataFrame, reference: str, value: str) -> DataFrame:
    """Least squares of bias on reference."""
    rows = df.where(F.col(reference).isNotNull() & F.col(value).isNotNull()).select(F.col(reference).cast("double").alias("x"), (F.col(value) - F.col(reference)).cast("double").alias("y"))
    return rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean_bias"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"))


def agreement(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Share of equal ratings and Cohen's kappa of two raters, from counts of rating pairs."""
    c = df.select(first.cast("string").alias("a"), second.cast("string").alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("c"))
    total = c.agg(F.sum("c").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left, right = c.groupBy(F.col("a").alias("k")).agg(F.sum("c").alias("x")), c.groupBy(F.col("b").alias("k")).agg(F.sum("c").alias("y"))
    chance = left.join(right, "k").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    r = total.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.coalesce("xy", F.lit(0.0)) / F.col("n") ** 2
    return r.select(F.col("n").cast("long").alias("n"), po.alias("agreement"), ((po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(df: DataFrame, item: str, rating: str) -> DataFrame:
    """Fleiss' kappa over items with the same number (two or more) of ratings."""
    c = df.where(F.col(rating).isNotNull()).groupBy(item, rating).agg(F.count("*").cast("double").alias("c"))
    items = c.groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") ** 2).alias("cc")).where("m > 1")
    p_item = items.agg(F.avg((F.col("cc") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("p"), F.count("*").alias("items"))
    shares = c.join(items.select(item), item).groupBy(rating).agg(F.sum("c").alias("c"))
    pe = shares.agg((F.sum(F.col("c") ** 2) / F.sum("c") ** 2).alias("pe"))
    return p_item.crossJoin(pe).select("items", F.col("p").alias("agreement"), ((F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def expanded_gage(df: DataFrame, value: str, part: str, operator: str, extra: str) -> DataFrame:
    """Variance components of a balanced study crossed in three random factors, a row a source.

    Sums of squares come from the spread of the means of every grouping of the factors. Negative components
    count as 0, raw_variance keeps them; an unbalanced study gives no rows.
    """
    from functools import reduce
    from itertools import combinations

    f = {"a": part, "b": operator, "c": extra}
    cells = df.where(F.col(value).isNotNull()).groupBy(*f.values()).agg(F.count("*").alias("_r"), F.avg(value).alias("_m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("_v"))
    row = cells.agg(F.min("_r").alias("r"), F.max("_r").alias("rx"), F.count("*").alias("cells"), F.avg("_v").alias("e"), F.var_pop("_m").alias("vabc"), *[F.countDistinct(f[k]).alias(f"n{k}") for k in "abc"])
    for size in (1, 2):
        for k in combinations("abc", size):
            name = "".join(k)
            row = row.crossJoin(cells.groupBy(*[f[x] for x in k]).agg(F.avg("_m").alias("_m")).agg(F.var_pop("_m").alias(f"v{name}")))  # one row each
    row = row.where("r = rx and cells = na * nb * nc and r > 1 and na > 1 and nb > 1 and nc > 1")
    v = {k: F.col(f"v{k}") for k in ("a", "b", "c", "ab", "ac", "bc", "abc")}
    n, total = {k: F.col(f"n{k}").cast("double") for k in "abc"}, F.col("r") * F.col("cells")
    own = {k: v[k] for k in "abc"} | {k: v[k] - v[k[0]] - v[k[1]] for k in ("ab", "ac", "bc")}
    own["abc"] = v["abc"] - v["ab"] - v["ac"] - v["bc"] + v["a"] + v["b"] + v["c"]
    ms = {k: total * own[k] / reduce(lambda x, y: x * y, [n[c] - 1 for c in k]) for k in own}
    r, e = F.col("r"), F.col("e")
    raw = {"repeatability": e, "abc": (ms["abc"] - e) / r}
    for k in ("ab", "ac", "bc"):
        (other,) = set("abc") - set(k)
        raw[k] = (ms[k] - ms["abc"]) / (r * n[other])
    for k in "abc":
        x, y = sorted(set("abc") - {k})
        raw[k] = (ms[k] - ms["".join(sorted(k + x))] - ms["".join(sorted(k + y))] + ms["abc"]) / (r * n[x] * n[y])
    label = {"repeatability": "repeatability"} | {k: "*".join(f[c] for c in k) for k in raw if k != "repeatability"}
    kept = {k: F.greatest(F.lit(0.0), c) for k, c in raw.items()}
    sum_ = reduce(lambda x, y: x + y, kept.values())
    rows = F.array(*[F.struct(F.lit(label[k]).alias("source"), kept[k].alias("variance"), raw[k].alias("raw_variance"), (100 * kept[k] / sum_).alias("percent_contribution")) for k in raw])
    return row.select(F.explode(rows).alias("x")).select("x.*")


def weighted_kappa(df: DataFrame, first: Column, second: Column, power: int = 1) -> DataFrame:
    """Kappa of two raters' numeric ratings, disagreement weighted by the distance (power 1) or its square (2)."""
    c = df.select(first.cast("double").alias("a"), second.cast("double").alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").cast("double").alias("c"))
    left, right = c.groupBy("a").agg(F.sum("c").alias("x")), c.groupBy("b").agg(F.sum("c").alias("y"))  # a row a rating
    far = lambda a, b: F.pow(F.abs(F.col(a) - F.col(b)), F.lit(power))
    seen = c.agg(F.sum("c").alias("n"), F.sum(F.col("c") * far("a", "b")).alias("seen"))
    chance = left.join(F.broadcast(right)).agg(F.sum(F.col("x") * F.col("y") * far("a", "b")).alias("chance"))
    return seen.crossJoin(chance).select(F.col("n").cast("long").alias("n"), (1 - F.col("seen") * F.col("n") / F.col("chance")).alias("kappa"))


def kendall_w(df: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """Kendall's concordance of columns of raters, a row an item, ties corrected, with its chi-square."""
    from functools import reduce

    from .rows import mid_ranks

    rows = df.where(reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in raters])).select(item, *raters)
    ranks, ties = rows, None
    for k, r in enumerate(raters):
        ranks = mid_ranks(ranks, r, alias=f"_r{k}")
        t = rows.groupBy(r).agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") ** 3 - F.col("c")).alias("t"))
        ties = t if ties is None else ties.union(t)
    total = reduce(lambda a, b: a + b, [F.col(f"_r{k}") for k in range(len(raters))])
    s = ranks.agg(F.count("*").cast("double").alias("n"), (F.var_pop(total) * F.count("*")).alias("s")).crossJoin(ties.agg(F.sum("t").alias("t")))
    m, n = len(raters), F.col("n")
    w = 12 * F.col("s") / (m * m * (n**3 - n) - m * F.col("t"))
    return s.select(n.cast("long").alias("items"), F.lit(m).alias("raters"), w.alias("w"), (m * (n - 1) * w).alias("chi_square"))
