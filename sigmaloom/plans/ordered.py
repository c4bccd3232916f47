"""Bounded windows over one long ordered series without bringing it into one task."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _scratch(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sigmaloom-")  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ordered-{uuid.uuid4().hex}"


def ranked(df: DataFrame, order: str) -> DataFrame:
    """df with `rank`, 1, 2 and so on by the order column (unique): range-partitioned, then shifted by partition.

    The sorted rows are written to the shared folder first, so ranks stay the same if a task runs again.
    """
    spark = df.sparkSession
    path = _scratch(spark)
    df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftrightunsigned("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a partition
    return rows.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_at") - F.col("_part") * (1 << 33) + 1).drop("_part", "_start", "_at")


def running(df: DataFrame, by: list[str], order: list, sums: dict) -> DataFrame:
    """df with running sums, each row's own value included, of columns in an order within by, for series of any length.

    order: columns that tell the rows of a series apart. The rows are range-partitioned by series and order and
    written once; a window then spans the rows of one part of a series, and what is before the part comes from
    sums of the parts. sums: from a new column's name to the column that is summed.
    """
    spark = df.sparkSession
    path = _scratch(spark)
    keys = [*map(F.col, by), *(F.col(o) if isinstance(o, str) else o for o in order)]
    names = list(sums)
    dealt = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(*keys)
    dealt.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    inside = Window.partitionBy("_part", *by).orderBy(*keys[len(by) :]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in names})
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.parquet(path).groupBy(*by, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])  # a row a part of a series
    parts = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by], *[F.sum(f"_t_{n}").over(before).alias(f"_a_{n}") for n in names])
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    out = rows.join(parts, same, "left").withColumns({n: F.col(n) + F.coalesce(F.col(f"_a_{n}"), F.lit(0)) for n in names})
    return out.select(*[c for c in df.columns if c not in sums], *names)


def written_rows(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = _scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_levels(df: DataFrame, levels: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df joined with a row of levels for each level of by (null is a level); without by, levels has one row."""
    if not by:
        return df.crossJoin(F.broadcast(levels))
    named = levels.select(*[F.col(c).alias(f"_level_{c}") for c in by], *[c for c in levels.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_level_{c}"))
    return df.join(named, same, how).drop(*[f"_level_{c}" for c in by])


def quantiles(df: DataFrame, column, by: list[str] | None, places: dict[str, float], rule: str = "n-1") -> DataFrame:
    """Exact quantiles by level, linear at p(n-1), or at p(n+1) kept within the ends (rule n+1), from counts of distinct values.

    A row of (by, _n, quantiles); levels without values have none. No task holds the values of a level.
    """
    by = by or []
    x = F.col(column) if isinstance(column, str) else column
    counts = df.where(x.isNotNull()).groupBy(*by, x.cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    upto = running(counts, by, ["_x"], {"_u": F.col("_c")})
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    n, picks, out = F.col("_n"), [], []
    for k, p in enumerate(places.values()):
        place = p * (n - 1) if rule == "n-1" else F.least(F.greatest(p * (n + 1), F.lit(1.0)), n.cast("double")) - 1
        low = F.floor(place)
        picks += [F.min(F.when(F.col("_u") > low, F.col("_x"))).alias(f"_l{k}"), F.min(F.when(F.col("_u") > F.least(low + 1, n - 1), F.col("_x"))).alias(f"_h{k}"), F.max(place - low).alias(f"_f{k}")]
    for k, name in enumerate(places):
        out.append((F.col(f"_l{k}") + F.col(f"_f{k}") * (F.col(f"_h{k}") - F.col(f"_l{k}"))).alias(name))
    return with_levels(upto, sizes, by).groupBy(*by, "_n").agg(*picks).select(*by, "_n", *out)


def blocked(df: DataFrame, order: str, before: int, after: int, rows: int | None = None, by: list[str] | None = None) -> tuple[DataFrame, Window]:
    """(rows with _home, window) for frames that reach at most `before` rows back and `after` rows ahead.

    Every series is cut into blocks by rank; a block also holds its neighbours' rows within reach, as guests
    (_home false), which give correct frames to the rows at home and are dropped by the caller. Blocks have
    `rows` rows; by default the table is dealt to a few blocks a core, of 2,000 to 100,000 rows.
    """
    by = by or []
    held = running(df, by, [order], {"rank": F.lit(1)}) if by else ranked(df, order)
    if rows is None:
        rows = max(2_000, before, after, min(100_000, held.count() // (3 * df.sparkSession.sparkContext.defaultParallelism) + 1))
    block = F.floor((F.col("rank") - 1) / rows)
    first, last = F.floor((F.col("rank") - 1 - after) / rows), F.floor((F.col("rank") - 1 + before) / rows)
    held = held.withColumn("_own", block).withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return held.withColumn("_home", F.col("_block") == F.col("_own")), Window.partitionBy(*by, "_block").orderBy("rank")


def in_blocks(df: DataFrame, order: str, by: list[str] | None, before: int, after: int, make, ranks: bool = False) -> DataFrame:
    """df with the columns that make(window) gives, for frames of at most `before` rows back and `after` ahead in a series.

    With ranks the column rank stays, which counts the rows of a series from 1.
    """
    held, window = blocked(df, order, before, after, by=by)
    return held.withColumns(make(window)).where("_home").drop("_home", "_own", "_block", *(() if ranks else ("rank",)))


def forgotten_after(rate: float, left: float = 1e-17) -> int:
    """Steps until a recursion that keeps `rate` of its state a step keeps no more than `left` of it."""
    if not 0 <= rate < 1:
        raise ValueError("the recursion does not forget")
    return 1 if rate == 0 else math.ceil(math.log(left) / math.log(rate))


def folded(df: DataFrame, order: str, by: list[str], values: list[str], function, columns: str, reach: int, after: int = 0) -> DataFrame:
    """df with columns from a recursion along every series, in blocks that are folded side by side.

    function(x, at) gets the values of consecutive rows as an array, a row a row, from place `at` of the
    series on, and returns a dict of arrays as long. reach: rows after which the recursion has forgotten where
    it began; a block starts that far ahead of its own rows. after: rows beyond its own that a block sees.
    """
    held, _ = blocked(df, order, reach, after, by=by)
    rows = held.withColumns({v: F.col(v).cast("double") for v in values if v not in (*by, order)})
    rows = rows.repartition(*by, "_block").sortWithinPartitions(*by, "_block", "rank")
    names = [n.split()[0] for n in columns.split(", ")]
    kept = [c for c in rows.columns if c not in ("_home", "_own", "_block", "rank", *names)]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes) + ", " + columns

    def fold(block: pd.DataFrame) -> pd.DataFrame:
        made = function(block[values].to_numpy(float), int(block["rank"].iloc[0]) - 1)
        return block[kept].assign(**made)[block["_home"].to_numpy()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None  # the last block may go on in the next batch
        for batch in batches:
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            if not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            for c in (*by, "_block"):
                now, then = rows[c].iloc[1:].to_numpy(), rows[c].iloc[:-1].to_numpy()
                new[1:] |= (now != then) & ~(pd.isna(now) & pd.isna(then))
            starts = [0, *np.flatnonzero(new).tolist()]
            done = [fold(rows.iloc[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            if done:
                yield pd.concat(done, ignore_index=True)
            left = rows.iloc[starts[-1] :]
        if left is not None:
            yield fold(left)

    return rows.mapInPandas(run, schema)


def block_arrays(df: DataFrame, value: str, order: str, by: list[str], before: int, rows: int | None = None) -> DataFrame:
    """(by, _block, _at, _own, _y): every series cut into runs of its values, a row of arrays a run, written once.

    _y holds the values of a run and up to `before` values ahead of it, _at the number of values of the series ahead
    of _y, _own how many at the end of _y are the run's. Nulls of value are left out. Jobs that pass over a series
    again and again read these rows and send back sums.
    """
    spark = df.sparkSession
    held = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_y"))
    if rows is None:
        rows = max(2_000, before, min(100_000, held.count() // (3 * spark.sparkContext.defaultParallelism) + 1))
    held = running(held, by, [order], {"_i": F.lit(1)})
    first, last = F.floor((F.col("_i") - 1) / rows), F.floor((F.col("_i") - 1 + before) / rows)
    dealt = held.select(*by, "_i", "_y", F.explode(F.sequence(first, last)).alias("_block"))
    runs = dealt.groupBy(*by, "_block").agg(F.sort_array(F.collect_list(F.struct("_i", "_y"))).alias("_v"), F.max("_i").alias("_last"))
    own = F.col("_last") - F.col("_block") * rows
    runs = runs.where(own > 0).select(*by, "_block", (F.col("_v")[0]["_i"] - 1).alias("_at"), own.alias("_own"), F.transform("_v", lambda v: v["_y"]).alias("_y"))
    return written_rows(runs)


def summed_arrays(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, column): the elementwise sums of arrays of one length a level, added up as they stream by."""
    schema = "".join(f"`{c}` {t}, " for c, t in rows.select(*by).dtypes) + f"{column} array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            for values in batch[[*by, column]].itertuples(index=False):
                now = tuple(None if pd.isna(v) else v for v in values[:-1])
                if now != key or total is None:
                    if total is not None:
                        yield pd.DataFrame([[*key, total]], columns=[*by, column])
                    key, total = now, np.zeros(len(values[-1]))
                total += values[-1]
        if total is not None:
            yield pd.DataFrame([[*key, total]], columns=[*by, column])

    dealt = rows.repartition(*by) if by else rows.repartition(1)  # a row a task that saw the level
    return dealt.sortWithinPartitions(*by).mapInPandas(run, schema) if by else dealt.mapInPandas(run, schema)


def value_blocks(df: DataFrame, value, by: list[str] | None = None, rows: int = 50_000) -> DataFrame:
    """(by, _part, _x, _c, _u): the distinct values of every series in order, in arrays of a bounded number of them.

    _c counts a value and _u it and all smaller ones. Nulls and values that are not finite are left out. A series
    of n rows has about n / rows parts; part k begins where k * rows values are below.
    """
    by = by or []
    x = F.col(value) if isinstance(value, str) else value
    counts = df.select(*by, x.cast("double").alias("_x")).where("_x > double('-inf') and _x < double('inf')").groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    upto = running(counts, by, ["_x"], {"_u": F.col("_c")})
    parts = upto.groupBy(*by, F.floor((F.col("_u") - F.col("_c")) / rows).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_x", "_c", "_u"))).alias("_v"))
    return written_rows(parts.select(*by, "_part", *[F.col(f"_v.{n}").alias(n) for n in ("_x", "_c", "_u")]))


def dealt_by(df: DataFrame, order: list) -> DataFrame:
    """df with _part, its range partition by the order, written once: what running_in sums over."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    return written_rows(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))


def running_in(df: DataFrame, order: list, sums: dict | None = None, back: dict | None = None) -> DataFrame:
    """df, whose _part comes from dealt_by, with sums up to each row and, for `back`, from each row on, its own included.

    Rows of one part alone are in a window; what is before or behind comes from a row a part. Sums can follow upon sums
    without dealing again.
    """
    sums, back = sums or {}, back or {}
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    inside = Window.partitionBy("_part").orderBy(*keys)
    each = {**sums, **back}
    rows = df.withColumns({f"_v_{n}": c for n, c in each.items()})
    totals = rows.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in each])
    parts = Window.orderBy("_part")  # a row a part
    before, behind = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before if n in sums else behind), F.lit(0)).alias(f"_a_{n}") for n in each])
    up, down = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({n: F.sum(f"_v_{n}").over(up if n in sums else down) for n in each})
    return rows.join(F.broadcast(totals), "_part").select(*[c for c in df.columns if c not in each], *[(F.col(n) + F.col(f"_a_{n}")).alias(n) for n in each])
