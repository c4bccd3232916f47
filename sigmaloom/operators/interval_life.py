"""Survival of interval-censored times by its nonparametric maximum likelihood (Turnbull)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import dealt_by, running_in, written_rows

#: Ranges of cells that one task solves in memory; more are solved by aggregations, to the same masses.
ONE_TASK = 2_000_000
CELLS = "low double, high double, mass double, survival double, rounds int, converged boolean"


def innermost(df: DataFrame, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """(cells, ranges) of intervals (low, high]: the innermost intervals, and how many rows cover which run of them.

    cells(cell, low, high) are numbered from 0 along the axis; ranges(a, b, n) are rows whose interval covers cells a to
    b. A null high is censored on the right, a null low on the left (from 0), equal ends are an exact time. Rows without
    either end, with ends that are not numbers or in the wrong order are left out. Every finite end is kept.
    """
    lo, hi = F.coalesce(F.col(low).cast("double"), F.lit(0.0)), F.coalesce(F.col(high).cast("double"), F.lit(float("inf")))
    rows = df.where(F.col(low).isNotNull() | F.col(high).isNotNull()).select(lo.alias("l"), hi.alias("h")).where("not isnan(l) and not isnan(h) and l <= h and l < double('inf')")
    # at one place a closed left end comes before the right ends, and those before open left ends
    rows = rows.groupBy("l", F.when(F.col("l") == F.col("h"), 0).otherwise(2).alias("k"), "h").agg(F.count("*").alias("n"))
    rows = written_rows(rows)
    ends = rows.select(F.col("l").alias("x"), "k").union(rows.select(F.col("h").alias("x"), F.lit(1).alias("k"))).distinct()
    dealt = dealt_by(ends, ["x", "k"])
    right = (F.col("k") == 1).cast("long")
    counted = running_in(dealt, ["x", "k"], {"_r": right}).withColumn("_g", F.col("_r") - right)  # right ends before
    groups = counted.groupBy("_g").agg(F.max(F.when(F.col("k") != 1, F.struct("x", "k"))).alias("left"), F.max(F.when(F.col("k") == 1, F.col("x"))).alias("high"))
    # the last left end before a right end and that end are an innermost interval
    found = written_rows(groups.where("left is not null and high is not null").select(F.col("left.x").alias("low"), F.col("left.k").alias("kind"), "high"))
    marks = found.select(F.col("low").alias("x"), F.col("kind").alias("k"), F.lit(1).alias("one")).union(found.select(F.col("high").alias("x"), F.lit(1).alias("k"), F.lit(1).alias("one")))
    marked = dealt.join(marks, ["x", "k"], "left").withColumn("one", F.coalesce("one", F.lit(0)))
    is_right = F.col("k") == 1
    placed = running_in(marked, ["x", "k"], {"_l": F.when(~is_right, F.col("one")).otherwise(0), "_h": F.when(is_right, F.col("one")).otherwise(0)})
    placed = placed.select("x", "k", F.when(is_right, F.col("_h") - 1).otherwise(F.col("_l") - F.col("one")).alias("cell"))
    placed = written_rows(placed)
    firsts = placed.where(~is_right).select(F.col("x").alias("l"), "k", F.col("cell").alias("a"))
    lasts = placed.where(is_right).select(F.col("x").alias("h"), F.col("cell").alias("b"))
    ranges = rows.join(firsts, ["l", "k"]).join(lasts, "h").groupBy("a", "b").agg(F.sum("n").alias("n"))
    cells = found.join(firsts.select(F.col("l").alias("low"), F.col("k").alias("kind"), F.col("a").alias("cell")), ["low", "kind"]).select("cell", "low", "high")
    return written_rows(cells), written_rows(ranges)


def _step(p: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """(masses after an expectation step, log-likelihood before it)."""
    upto = np.concatenate([[0.0], np.cumsum(p)])
    held = np.maximum(upto[b + 1] - upto[a], 1e-300)
    share = np.bincount(a, n / held, len(p) + 1) - np.bincount(b + 1, n / held, len(p) + 1)
    new = p * np.maximum(np.cumsum(share)[:-1], 0.0)
    return new / new.sum(), float(n @ np.log(held))


def solve(a: np.ndarray, b: np.ndarray, n: np.ndarray, cells: int, rounds: int, tolerance: float) -> tuple[np.ndarray, int, bool]:
    """Expectation steps with squared extrapolation, kept only where it raises the likelihood."""
    p = np.full(cells, 1.0 / cells)
    for k in range(rounds):
        one, _ = _step(p, a, b, n)
        two, _ = _step(one, a, b, n)
        if np.abs(two - one).sum() < tolerance:
            return two, k + 1, True
        r, v = one - p, two - 2 * one + p
        size = float(np.sqrt((r @ r) / max(v @ v, 1e-300)))
        far = p + 2 * size * r + size * size * v
        far = np.maximum(far, two * 1e-3)  # no mass is lost for good
        far /= far.sum()
        next_far, like = _step(far, a, b, n)
        p = next_far if size > 1 and like >= _step(two, a, b, n)[1] else two
    return p, rounds, False


def turnbull(df: DataFrame, low: str, high: str, rounds: int = 5000, tolerance: float = 1e-10, one_task: int = ONE_TASK) -> DataFrame:
    """A row an innermost interval: low, high, its mass, the survival behind it, rounds taken and whether they converged.

    See innermost() for the rows that count. Mass outside these intervals would only lower the likelihood. Converged
    means that an expectation step moves no more than `tolerance` of the mass. Up to `one_task` distinct runs of cells
    are solved by a task; beyond, every step is aggregations over cells and runs (without extrapolation, so it takes
    more rounds). No interval gives no row.
    """
    cells, ranges = innermost(df, low, high)
    n_cells, n_ranges = cells.count(), ranges.count()
    if not n_cells:
        return df.sparkSession.createDataFrame([], CELLS)
    if n_ranges <= one_task and n_cells <= one_task:
        both = ranges.select(F.lit(0).alias("one"), "a", "b", "n").groupBy("one").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list("n").alias("n"))  # at most one_task of them

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    p, k, done = solve(np.asarray(row["a"]), np.asarray(row["b"]), np.asarray(row["n"], float), n_cells, rounds, tolerance)
                    yield pd.DataFrame({"cell": np.arange(n_cells), "mass": p, "survival": np.maximum(0.0, 1 - np.cumsum(p)), "rounds": k, "converged": done})

        masses = both.mapInPandas(run, "cell long, mass double, survival double, rounds int, converged boolean")
        return cells.join(masses, "cell").select("low", "high", "mass", "survival", "rounds", "converged")
    total = float(ranges.agg(F.sum("n")).first()[0])
    state = dealt_by(cells.select("cell", F.lit(1.0 / n_cells).alias("p")), ["cell"])
    taken, done = 0, False
    for taken in range(1, rounds + 1):
        upto = running_in(state, ["cell"], {"u": F.col("p")}).select("cell", "u")
        at_a, at_b = (upto.select((F.col("cell") + k).alias(c), F.col("u").alias(f"u_{c}")) for c, k in (("a", 1), ("b", 0)))
        held = ranges.join(at_b, "b").join(at_a, "a", "left").withColumn("q", F.col("n") / F.greatest(F.col("u_b") - F.coalesce("u_a", F.lit(0.0)), F.lit(1e-300)))
        turns = held.select(F.col("a").alias("cell"), "q").union(held.select(F.col("b") + 1, -F.col("q"))).groupBy("cell").agg(F.sum("q").alias("q"))
        share = running_in(state.join(turns, "cell", "left").withColumn("q", F.coalesce("q", F.lit(0.0))), ["cell"], {"w": F.col("q")})
        state = written_rows(share.select("cell", "_part", F.col("p").alias("was"), (F.col("p") * F.greatest(F.col("w"), F.lit(0.0)) / total).alias("p")))
        if state.agg(F.sum(F.abs(F.col("p") - F.col("was")))).first()[0] < tolerance:
            done = True
            break
    upto = running_in(state.drop("was"), ["cell"], {"u": F.col("p")})
    return cells.join(upto, "cell").select("low", "high", F.col("p").alias("mass"), F.greatest(1 - F.col("u"), F.lit(0.0)).alias("survival"), F.lit(taken).alias("rounds"), F.lit(done).alias("converged"))
