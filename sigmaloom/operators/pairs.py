"""Statistics of all pairs of values without their pairs: shifts between samples, and Kendall's rank correlation.

Pairs are counted over sorted values: from running sums for differences within a bound, and over blocks of a grid of
ranks for discordant pairs. Work is that of a few sorts, whatever the number of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_cdf, normal_quantile
from ..plans.ordered import running, written_rows

#: Thresholds of a counting round, and pairs of distinct values that are listed once a bracket holds no more.
CUTS, LISTED = 16, 2_000_000
#: Rows of a block of the grid of ranks.
BLOCK = 100_000


def _within(x: DataFrame, y: DataFrame, cuts: list[float]) -> list[tuple[int, int]]:
    """For each cut how many pairs of rows, and how many of distinct values, have y >= x - cut, that is x - y <= cut."""
    moved = x.select(F.posexplode(F.array(*[F.col("v") - F.lit(c) for c in cuts])).alias("t", "v"), "c").select("v", "t", F.col("c").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(0).cast("long").alias("ny"))
    still = y.select("v", F.lit(len(cuts)).alias("t"), F.lit(0).cast("long").alias("cx"), F.col("c").alias("cy"), F.lit(1).cast("long").alias("ny"))
    both = running(moved.unionByName(still), [], [F.desc("v"), F.desc("t")], {"rows": F.col("cy"), "values": F.col("ny")})  # values of y from v up
    found = both.where(F.col("t") < len(cuts)).groupBy("t").agg(F.sum(F.col("cx") * F.col("rows").cast("decimal(38,0)")), F.sum("values")).collect()
    counts = {t: (int(p), int(d)) for t, p, d in found}
    return [counts.get(t, (0, 0)) for t in range(len(cuts))]


def differences_at(x: DataFrame, y: DataFrame, ranks: list[int], listed: int = LISTED) -> dict[int, float]:
    """The differences x - y at the given places (from 1) among all, sorted; x and y have distinct values v and counts c.

    A bracket around each place is cut by counts until it holds few pairs of distinct values or no width; these are
    listed by a join on buckets as wide as the bracket, and the place is counted out.
    """
    ends = [t.agg(F.min("v"), F.max("v"), F.sum("c"), F.count("*")).first() for t in (x, y)]
    (a, b, n, kn), (c, d, m, km) = ends
    lowest, highest = a - d, b - c
    # a bracket (low, high] with the pairs up to low, and of distinct values up to low and high
    scale = max(map(abs, (a, b, c, d, 1e-300)))
    edges = {lowest - scale * 2.0**-30: (0, 0), highest + scale * 2.0**-30: (n * m, kn * km)}  # beyond the rounding of any difference
    out: dict[int, float] = {}
    for k in sorted(set(ranks)):
        while True:
            low = max(t for t, (p, _) in edges.items() if p < k)
            high = min(t for t, (p, _) in edges.items() if p >= k)
            if edges[high][1] - edges[low][1] <= listed or high - low <= scale * 2.0**-50:
                break
            cuts = sorted({t for t in (low + (high - low) * j / CUTS for j in range(1, CUTS)) if low < t < high})
            if not cuts:
                break
            edges |= dict(zip(cuts, _within(x, y, cuts), strict=True))
        width = max(high - low, scale * 2.0**-40)
        if edges[high][1] - edges[low][1] > listed:
            out[k] = high  # nothing lies between but the value itself
            continue
        bucket = lambda v: F.floor(v / width)
        left = x.select(F.col("v").alias("xv"), F.col("c").alias("xc"), F.explode(F.sequence(bucket(F.col("v") - high), bucket(F.col("v") - low))).alias("_b"))
        right = y.select(F.col("v").alias("yv"), F.col("c").alias("yc"), bucket(F.col("v")).alias("_b"))
        pairs = left.join(right, "_b").where((F.col("yv") >= F.col("xv") - high) & (F.col("yv") < F.col("xv") - low))
        sizes = pairs.groupBy((F.col("xv") - F.col("yv")).alias("d")).agg(F.sum(F.col("xc") * F.col("yc")).alias("p"))
        at = running(sizes, [], ["d"], {"u": F.col("p")}).where(F.col("u") >= k - edges[low][0]).agg(F.min("d")).first()[0]
        out[k] = float(at)
    return out


def shift_interval(df: DataFrame, value: str, group: str, first, second, confidence: float = 0.95, listed: int = LISTED) -> DataFrame:
    """The Hodges-Lehmann shift of the first sample over the second and its distribution-free interval: n1, n2, estimate, low, high.

    The estimate is the median of all differences; the limits are those at floor(n1 n2 / 2 - z sigma), counted from 0,
    from either end, with the tie-corrected deviation of the rank sum. Nulls and values that are not finite are left
    out; an empty sample gives no row, one too small for the confidence has the extreme differences as limits.
    """
    schema = "n1 long, n2 long, estimate double, low double, high double"
    v = F.col(value).cast("double")
    held = df.where((v > float("-inf")) & (v < float("inf")) & F.col(group).isin(first, second)).select(v.alias("v"), (F.col(group) == first).alias("g"))
    counts = written_rows(held.groupBy("v", "g").agg(F.count("*").alias("c")))
    x, y = (counts.where(F.col("g") == side).select("v", "c") for side in (True, False))
    n, m = (t.agg(F.sum("c")).first()[0] for t in (x, y))
    if not n or not m:
        return df.sparkSession.createDataFrame([], schema)
    ties = counts.groupBy("v").agg(F.sum("c").cast("double").alias("c")).agg(F.sum(F.col("c") ** 3 - F.col("c"))).first()[0]
    total, pairs = n + m, n * m
    sigma = math.sqrt(max(0.0, pairs / 12 * (total + 1 - ties / (total * (total - 1)))))
    tail = max(0, math.floor(pairs / 2 - normal_quantile(1 - (1 - confidence) / 2) * sigma))
    middle = [(pairs + 1) // 2, pairs // 2 + 1]
    found = differences_at(x, y, [*middle, tail + 1, pairs - tail], listed)
    return df.sparkSession.createDataFrame([(n, m, (found[middle[0]] + found[middle[1]]) / 2, found[tail + 1], found[pairs - tail])], schema)


def discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """The sum of products of weights over pairs in opposite order; whole numbers."""
    order = np.lexsort((y, x))
    y, w = np.unique(y[order], return_inverse=True)[1], w[order].astype(object if float(w.sum()) ** 2 > 2**62 else np.int64)
    total = 0
    for bit in range(max(1, int(y.max(initial=0)).bit_length()) - 1, -1, -1):
        group = y >> (bit + 1)
        at = np.argsort(group, kind="stable")
        g, upper, weight = group[at], (y[at] >> bit) & 1, w[at]
        ones = np.cumsum(weight * upper)
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        before = np.concatenate([[0], ones])[start]  # those of groups ahead
        total += int((weight * (1 - upper) * (ones - np.repeat(before, np.diff(np.append(start, len(g)))))).sum())
    return total


def _blocks(points: DataFrame, name: str, size: int) -> DataFrame:
    """points with _b<name>: an order-keeping block of values of at most about 2 * size rows; a value of more has an odd one of its own."""
    sizes = points.groupBy(name).agg(F.count("*").alias("_c"))
    before = running(sizes, [], [name], {"_u": F.col("_c")})
    return points.join(before.select(name, (2 * F.floor((F.col("_u") - F.col("_c")) / size) + (F.col("_c") > size).cast("long")).alias(f"_b{name}")), name)


def discordant_pairs(points: DataFrame, size: int = BLOCK) -> int:
    """Pairs of rows of points(x, y, w; distinct x and y, w rows each) that x and y order in opposite ways.

    Values are cut into blocks along either axis. Pairs that differ in both blocks are those of the coarse grid, which
    is counted the same way; the rest share a block, where they are counted in memory: by x block, by y block, less those
    counted twice, which share both. A value with more rows than a block has pairs with nothing in its own block.
    """
    n = points.count()
    size = max(size, math.ceil(4 * math.sqrt(n)))  # so the coarse grid has less than a tenth of the points
    if n <= size:
        rows = points.select("x", "y", "w").toPandas()  # at most `size` rows
        return discordant(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["w"].to_numpy())
    placed = written_rows(_blocks(_blocks(points, "x", size), "y", size))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [str(discordant(part["x"].to_numpy(), part["y"].to_numpy(), part["w"].to_numpy()))]})

    def inside(*blocks: str) -> int:
        held = placed
        for b in blocks:
            held = held.where(F.col(b) % 2 == 0)
        return int(held.select(*blocks, "x", "y", "w").groupBy(*blocks).applyInPandas(count, "d string").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0] or 0)

    coarse = written_rows(placed.groupBy(F.col("_bx").alias("x"), F.col("_by").alias("y")).agg(F.sum("w").alias("w")))
    shared = inside("_bx") + inside("_by") - inside("_bx", "_by")
    return discordant_pairs(coarse, size) + shared


def kendall(df: DataFrame, first: Column, second: Column, size: int = BLOCK) -> DataFrame:
    """Kendall's tau-b of two columns: n, concordant, discordant, tau_b, and z and p of no association, corrected for ties.

    Rows in which either is null or nan are left out. A column of one value leaves tau_b, z and p null.
    """
    held = df.select(first.cast("double").alias("x"), second.cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    points = written_rows(held.groupBy("x", "y").agg(F.count("*").alias("w")))
    big = "decimal(38,0)"

    def ties(*by: str) -> tuple[int, int, int, int]:
        c = F.col("_c").cast(big)
        s = points.groupBy(*by).agg(F.sum("w").alias("_c"))
        got = s.agg(F.sum("_c"), F.sum(c * (c - 1)), F.sum((F.col("_c").cast("double") * (F.col("_c") - 1) * (2 * F.col("_c") + 5))), F.sum((F.col("_c").cast("double") * (F.col("_c") - 1) * (F.col("_c") - 2)))).first()
        return tuple(v or 0 for v in got)

    (n, tx, vx, ux), (_, ty, vy, uy), (_, both, _, _) = ties("x"), ties("y"), ties("x", "y")
    down = discordant_pairs(points, size) if n else 0
    n0, tx, ty, both = n * (n - 1) // 2, int(tx) // 2, int(ty) // 2, int(both) // 2
    up = n0 - tx - ty + both - down
    tau = z = p = None
    if n > 2 and n0 > tx and n0 > ty:
        tau = (up - down) / math.sqrt((n0 - tx) * (n0 - ty))
        variance = (n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + (2.0 * tx) * (2.0 * ty) / (2 * n * (n - 1)) + float(ux) * float(uy) / (9 * n * (n - 1) * (n - 2))
        z = (up - down) / math.sqrt(variance)
        p = 2 * normal_cdf(-abs(z))
    return df.sparkSession.createDataFrame([(int(n), up, down, tau, z, p)], "n long, concordant long, discordant long, tau_b double, z double, p_value double")
