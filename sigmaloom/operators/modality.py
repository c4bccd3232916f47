"""One peak or more: Hartigan's dip, and a screen of histogram peaks before capability is read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import running, with_levels

#: Rank buckets of a series. A series of no more values is taken as it is; of a longer one the first and last distinct
#: value of every bucket stay, which moves its distribution function, and so the dip, by no more than 1 / BUCKETS.
BUCKETS = 1_000_000
FEWEST_DIP, FEWEST_SCREEN = 4, 30
#: Size of the uniform samples for p; for longer series the dip is scaled by the square root of the sizes' ratio.
SIMULATED = 1000


def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Vertices of the greatest convex minorant of points in order."""
    out: list[int] = []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        while len(out) > 1 and (y[out[-1]] - y[out[-2]]) * (a - x[out[-2]]) >= (b - y[out[-2]]) * (x[out[-1]] - x[out[-2]]):
            out.pop()
        out.append(i)
    return out


def _beyond(x: np.ndarray, line: np.ndarray, points: np.ndarray, hull: list[int]) -> float:
    """The largest height of points over the curve through line at the hull's vertices."""
    return float(np.max(points[hull[0] : hull[-1] + 1] - np.interp(x[hull[0] : hull[-1] + 1], x[hull], line[hull]), initial=0.0))


def dip(x: np.ndarray, below: np.ndarray, upto: np.ndarray) -> float:
    """Hartigan's dip of distinct rising values with the shares of values below them and up to them.

    Between the ends of a modal interval the convex minorant of what is below and the concave majorant of what is up to
    each value are drawn, and the interval shrinks to where they are farthest apart. Outside it the function's
    distance from its own minorant or majorant counts. Half the largest distance is the dip.
    """
    low, high, most = 0, len(x) - 1, float(np.max(upto - below))
    while low < high:
        xs, a, b = x[low : high + 1], below[low : high + 1], upto[low : high + 1]
        minor, major = _hull(xs, a), _hull(xs, -b)
        under, over = np.interp(xs, xs[minor], a[minor]), np.interp(xs, xs[major], b[major])
        gap_minor, gap_major = over[minor] - a[minor], b[major] - under[major]
        apart = max(gap_minor.max(), gap_major.max())
        if apart <= most:
            break
        if gap_minor.max() >= gap_major.max():
            left = minor[int(np.argmax(gap_minor))]
            right = next((k for k in major if k >= left), major[-1])
        else:
            right = major[int(np.argmax(gap_major))]
            left = next((k for k in reversed(minor) if k <= right), minor[0])
        outer = max(_beyond(xs, a, b, [k for k in minor if k <= left]), _beyond(xs, -b, -a, [k for k in major if k >= right]))
        if (left, right) == (0, len(xs) - 1):
            most = max(most, outer)
            break
        most, low, high = max(most, outer), low + left, low + right
    return most / 2


def dip_test(df: DataFrame, value: str, by: list[str] | None = None, replicates: int = 0, seed: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """A row a series: n, dip, and with replicates the share p of uniform samples whose dip is no smaller.

    Nulls and values that are not finite are left out; a series of fewer than 4 values, or of one distinct value, has
    dip 0 and no p. See BUCKETS and SIMULATED for long series.
    """
    by = by or []
    keys = "".join(f"`{c}` {t}, " for c, t in df.select(*by).dtypes)
    x = F.col(value).cast("double")
    counts = df.select(*by, x.alias("_x")).where("_x > double('-inf') and _x < double('inf')").groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("n"))
    upto = with_levels(running(counts, by, ["_x"], {"_u": F.col("_c")}), sizes, by)
    bucket = F.when(F.col("n") <= buckets, F.col("_u")).otherwise(F.floor(F.col("_u") * (buckets / F.col("n"))))
    ends = upto.groupBy(*by, "n", bucket.alias("_b")).agg(*[f(F.struct("_x", "_c", "_u")).alias(f"_{k}") for k, f in (("first", F.min), ("last", F.max))])
    points = ends.select(*by, "n", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_p")).select(*by, "n", "_p.*")

    def measure(part: pd.DataFrame) -> pd.DataFrame:  # at most two values a bucket
        rows, n = part.sort_values("_x"), int(part["n"].iloc[0])
        u, c = rows["_u"].to_numpy(float), rows["_c"].to_numpy(float)
        d = dip(rows["_x"].to_numpy(), (u - c) / n, u / n) if n >= FEWEST_DIP and len(rows) > 1 else 0.0
        return pd.DataFrame([[*part[by].iloc[0].tolist(), n, d]], columns=[*by, "n", "dip"])

    found = points.withColumn("_one", F.lit(1)).groupBy(*by, "_one").applyInPandas(measure, keys + "n long, dip double")
    if not replicates:
        return found
    keys_of = found.select("n").distinct().where(F.col("n") >= FEWEST_DIP).select(F.least("n", F.lit(SIMULATED)).alias("_m")).distinct()

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m, k in zip(batch["_m"].tolist(), batch["_k"].tolist(), strict=True):
                draws = np.sort(np.random.default_rng([seed, int(m), int(k)]).random(int(m)))
                places = np.arange(int(m) + 1) / m
                yield pd.DataFrame({"_m": [m], "_s": [dip(draws, places[:-1], places[1:]) * math.sqrt(m)]})

    draws = keys_of.select("_m", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_k")).repartition("_m", "_k")
    null = draws.mapInPandas(simulate, "_m long, _s double")
    scored = found.withColumns({"_m": F.least("n", F.lit(SIMULATED)), "_own": F.col("dip") * F.sqrt("n")})
    exceeded = with_levels(scored.select(*by, "_m", "_own"), null.groupBy("_m").agg(F.collect_list("_s").alias("_null")), ["_m"], how="left")  # `replicates` numbers a size
    share = (F.size(F.filter("_null", lambda s: s >= F.col("_own") - 1e-12)) + 1) / (replicates + 1)
    return with_levels(found, exceeded.select(*by, F.when(F.col("_null").isNotNull() & (F.col("_own") > 0), share).alias("p_value")), by)


def bimodality_screen(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A row a series: n, bins, peaks of its histogram and a status: suspected, clear or insufficient_n.

    Bins are the square root of the values, from 8 to 40. A bin is a peak if no neighbour is higher and one is lower (at
    the ends if its neighbour is lower). Two peaks with another bin between them are suspected if the lowest bin from
    one to the other has no more than 60 percent of the smaller peak. Fewer than 30 finite values are too few; a
    constant series has one peak. Only counts of bins, 40 a series, go through the windows.
    """
    by = by or []
    x = F.col(value).cast("double")
    held = df.select(*by, x.alias("_x")).where("_x > double('-inf') and _x < double('inf')")
    facts = held.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    facts = facts.withColumn("bins", F.least(F.greatest(F.ceil(F.sqrt("n")), F.lit(8)), F.lit(40)).cast("int"))
    usable = facts.where((F.col("n") >= FEWEST_SCREEN) & (F.col("_b") > F.col("_a")))
    place = F.least(F.floor((F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * F.col("bins")), F.col("bins") - 1).cast("int")
    counts = with_levels(held, usable, by).groupBy(*by, "bins", place.alias("bin")).agg(F.count("*").alias("_n"))
    grid = usable.select(*by, "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    full = with_levels(grid, counts.drop("bins"), [*by, "bin"], how="left").withColumn("c", F.coalesce("_n", F.lit(0)))
    w = Window.partitionBy(*by).orderBy("bin")  # at most 40 rows a series
    full = full.withColumns({"l": F.lag("c").over(w), "r": F.lead("c").over(w)})
    c, left, right = F.col("c"), F.coalesce("l", F.lit(-1)), F.coalesce("r", F.lit(-1))
    inner = (c >= left) & (c >= right) & ((c > left) | (c > right)) & F.col("l").isNotNull() & F.col("r").isNotNull()
    ends = (F.col("l").isNull() & (c > right)) | (F.col("r").isNull() & (c > left))
    marked = full.withColumn("peak", (c > 0) & (inner | ends))
    lists = marked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "c", "peak"))).alias("_h"))
    peaks = F.filter("_h", lambda h: h["peak"])

    def split(a, b):
        valley = F.array_min(F.transform(F.slice("_h", a["bin"] + 1, b["bin"] - a["bin"] + 1), lambda h: h["c"]))
        return (b["bin"] >= a["bin"] + 2) & (valley * 5 <= F.least(a["c"], b["c"]) * 3)

    two = F.exists(peaks, lambda a: F.exists(peaks, lambda b: split(a, b)))
    told = lists.select(*by, F.size(peaks).alias("_peaks"), two.alias("_two"))
    few = F.col("n") < FEWEST_SCREEN
    return with_levels(facts, told, by, how="left").select(
        *by, "n", F.when(~few & F.col("_peaks").isNotNull(), F.col("bins")).alias("bins"), F.when(few, 0).otherwise(F.coalesce("_peaks", F.lit(1))).alias("peaks"),
        F.when(few, "insufficient_n").when(F.col("_two"), "suspected").otherwise("clear").alias("status"),
    )
