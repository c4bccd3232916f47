"""Survival: risk sets come from counts of distinct times, summed over parts of the time axis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import dealt_by, running, running_in


def event_flag(cell: Column) -> Column:
    """True, false, or null for what is neither, of an event column's usual encodings."""
    c = F.lower(F.trim(cell.cast("string")))
    return F.when(c.isin("1", "true", "yes", "event", "failure", "failed", "f"), True).when(c.isin("0", "false", "no", "censored", "suspended", "c"), False)


def risk_table(df: DataFrame, time: str, event: Column, by: list[str] | None = None) -> DataFrame:
    """A row a distinct time (censored ones too): at_risk, events, censored; rows without time or event are left out.

    Without by the rows keep _part, the part of the time axis, for further sums.
    """
    by = by or []
    rows = df.where(F.col(time).isNotNull()).select(*by, F.col(time).cast("double").alias("time"), event.alias("e")).where(F.col("e").isNotNull())
    c = rows.groupBy(*by, "time").agg(F.count_if("e").alias("events"), F.count_if(~F.col("e")).alias("censored"))
    if not by:
        return running_in(dealt_by(c, ["time"]), ["time"], back={"at_risk": F.col("events") + F.col("censored")})
    return running(c, by, [F.desc("time")], {"at_risk": F.col("events") + F.col("censored")})


def kaplan_meier(df: DataFrame, time: str, event: Column, by: list[str] | None = None, z: float = 1.959963984540054) -> DataFrame:
    """Survival with Greenwood's error and log-log limits, by level."""
    by = by or []
    t = risk_table(df, time, event, by)
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    sums = {"_l": F.when(d < n, F.log(1 - d / n)).otherwise(0.0), "_dead": (d == n).cast("int"), "_g": F.when(d < n, d / (n * (n - d))).otherwise(0.0)}
    t = running(t, by, ["time"], sums) if by else running_in(t, ["time"], sums).drop("_part")
    t = t.withColumn("survival", F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_l")))
    s = F.col("survival")
    inner = (s > 0) & (s < 1)
    width = F.exp(z * F.sqrt("_g") / F.abs(F.log(F.when(inner, s))))
    return t.withColumn("se", s * F.sqrt("_g")).withColumn("low", F.when(inner, F.pow(s, width))).withColumn("high", F.when(inner, F.pow(s, 1 / width))).drop("_l", "_dead", "_g")


def log_rank(df: DataFrame, time: str, event: Column, group: str, first, second) -> DataFrame:
    """Observed and expected events of the first of two groups, variance and chi-square."""
    rows = df.where(F.col(group).isin(first, second) & F.col(time).isNotNull()).select(F.col(time).cast("double").alias("time"), event.alias("e"), (F.col(group) == first).alias("g")).where("e is not null")
    c = rows.groupBy("time").agg(*[F.count_if(side & seen).alias(f"{k}{g}") for g, side in ((1, F.col("g")), (0, ~F.col("g"))) for k, seen in (("e", F.col("e")), ("c", ~F.col("e")))])
    c = running(c, [], [F.desc("time")], {"n1": F.col("e1") + F.col("c1"), "n0": F.col("e0") + F.col("c0")})
    n, d = (F.col("n1") + F.col("n0")).cast("double"), (F.col("e1") + F.col("e0")).cast("double")
    var = F.when(n > 1, F.col("n1") * F.col("n0") * d * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    s = c.agg(F.sum("e1").alias("observed"), F.sum(d * F.col("n1") / n).alias("expected"), F.sum(var).alias("variance"))
    return s.withColumn("chi_square", (F.col("observed") - F.col("expected")) ** 2 / F.col("variance"))


def exponential(df: DataFrame, time: str, event: Column, by: list[str] | None = None) -> DataFrame:
    """Rate, mean life and log-likelihood of a one-parameter exponential life, right-censored."""
    s = df.where(F.col(time) > 0).groupBy(*(by or [])).agg(F.count_if(event).alias("events"), F.sum(time).alias("exposure"), F.count("*").alias("n"))
    rate = F.col("events") / F.col("exposure")
    return s.withColumn("rate", rate).withColumn("mean_life", 1 / rate).withColumn("log_likelihood", F.col("events") * F.log(rate) - rate * F.col("exposure"))


def weibull(df: DataFrame, time: str, event: Column, rounds: int = 60) -> DataFrame:
    """Shape, scale and log-likelihood of a Weibull life, right-censored: Newton steps, one aggregation each.

    Times are counted by distinct value first, so each step reads the counts, not the rows.
    """
    rows = df.where(F.col(time) > 0).select(F.log(F.col(time).cast("double")).alias("l"), event.alias("e")).where("e is not null")
    c = rows.groupBy("l").agg(F.count("*").alias("n"), F.count_if("e").alias("d")).cache()
    total = c.agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col("l")).alias("dl"), F.max("l").alias("top"), F.sum("n").alias("n")).first()
    schema = "shape double, scale double, log_likelihood double, events long, n long"
    if not total.d:
        return df.sparkSession.createDataFrame([], schema)
    k = 1.0
    for _ in range(rounds):
        w = F.col("n") * F.exp(k * (F.col("l") - total.top))
        a, b, q = c.agg(F.sum(w), F.sum(w * F.col("l")), F.sum(w * F.col("l") ** 2)).first()
        slope = b / a - 1 / k - total.dl / total.d
        step = slope / (q / a - (b / a) ** 2 + 1 / k**2)
        k = k - step if k > step else k / 2
        if abs(step) < 1e-12 * k:
            break
    a = c.agg(F.sum(F.col("n") * F.exp(k * (F.col("l") - total.top)))).first()[0]
    log_scale = total.top + math.log(a / total.d) / k
    like = total.d * math.log(k) - total.d * k * log_scale + (k - 1) * total.dl - total.d
    c.unpersist()
    return df.sparkSession.createDataFrame([(k, math.exp(log_scale), like, total.d, total.n)], schema)


def cumulative_incidence(df: DataFrame, time: str, mode: Column) -> DataFrame:
    """Aalen-Johansen incidence of each failure mode; mode is null for a censored row."""
    rows = df.where(F.col(time).isNotNull()).select(F.col(time).cast("double").alias("time"), mode.cast("string").alias("mode"))
    c = rows.groupBy("time", "mode").agg(F.count("*").alias("c"))
    t = c.groupBy("time").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("mode").isNotNull(), F.col("c")).otherwise(0)).alias("d"))
    t = running(t, [], [F.desc("time")], {"n": F.col("all")})
    own = F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(-800.0)
    t = running(t, [], ["time"], {"l": own}).withColumn("s", F.exp(F.col("l") - own))
    steps = c.where("mode is not null").join(t, "time").withColumn("step", F.col("s") * F.col("c") / F.col("n"))
    return running(steps, ["mode"], ["time"], {"incidence": F.col("step")}).select("mode", "time", F.col("c").alias("events"), F.col("n").alias("at_risk"), "incidence")


def warranty(df: DataFrame, time: str, event: Column, months: float, strata: list[str]) -> DataFrame:
    """Claims a thousand units at a warranty time by stratum, from an exponential life."""
    s = exponential(df, time, event, strata)
    r = F.exp(-F.col("rate") * months)
    return s.select(*strata, "n", "events", "rate", r.alias("reliability"), (1000 * (1 - r)).alias("claims_per_1000"))


def compare_lives(df: DataFrame, time: str, event: Column) -> DataFrame:
    """Log-likelihood, AIC and BIC of exponential, Weibull and lognormal lives, right-censored, the least AIC first."""
    from ..functions.special import log_normal_cdf_col
    from .survival_models import lognormal

    rows = df.where(F.col(time) > 0).select(F.col(time).cast("double").alias("_t"), event.alias("_e")).where("_e is not null")
    one = exponential(rows, "_t", F.col("_e")).select(F.lit("exponential").alias("distribution"), F.lit(1).alias("k"), "n", "log_likelihood")
    two = weibull(rows, "_t", F.col("_e")).select(F.lit("weibull").alias("distribution"), F.lit(2).alias("k"), "n", "log_likelihood")
    fit = lognormal(rows, "_t", F.col("_e"))
    c = rows.groupBy("_t", "_e").agg(F.count("*").alias("c")).crossJoin(F.broadcast(fit))
    z = (F.log("_t") - F.col("location")) / F.col("scale")
    dead = -z * z / 2 - F.log("scale") - F.log("_t") - 0.5 * math.log(2 * math.pi)
    three = c.agg(F.lit("lognormal").alias("distribution"), F.lit(2).alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * F.when(F.col("_e"), dead).otherwise(log_normal_cdf_col(-z))).alias("log_likelihood"))
    k, like = F.col("k"), F.col("log_likelihood")
    both = one.union(two).union(three).where(like.isNotNull())
    return both.select("distribution", "n", like, (2 * k - 2 * like).alias("aic"), (k * F.log("n") - 2 * like).alias("bic"))
