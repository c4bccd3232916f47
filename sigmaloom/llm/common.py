"""What the operators of this subpackage share: intermediate tables, tiling of hot groups, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share.

    The folder is the session's spark.checkpoint.dir; a temporary folder stands in only where the
    setting is absent (tests in local mode).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sigmaloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tiled(df: DataFrame, key: str, item: str, tile_rows: int, weight: str | None = None) -> DataFrame:
    """Deal the rows of each key into tiles so that no task holds more than about two tiles of a key.

    Adds tile_a, tile_b and tile: a key of up to tile_rows rows, or of that sum of the column `weight` if one is
    named, has the one tile pair (0, 0). A larger key is cut into p tiles by a hash of `item`, and each row goes to the p pairs that hold its own tile, so
    that every two rows of a key meet in exactly one pair (rows of one tile meet in the pair (t, t); the
    pair (a, b) is for rows of a against rows of b).
    """
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = df.groupBy(key).agg(size.alias("_n")).where(F.col("_n") > tile_rows)
    parts = sizes.select(key, F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int").alias("_p"))
    dealt = df.join(parts, key, "left")
    tile = F.when(F.col("_p").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(7), item), F.col("_p")).cast("int"))
    dealt = dealt.withColumn("tile", tile).withColumn(
        "_other", F.explode(F.when(F.col("_p").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_p") - 1)))
    )
    return (
        dealt.withColumn("tile_a", F.least("tile", "_other"))
        .withColumn("tile_b", F.greatest("tile", "_other"))
        .drop("_p", "_other")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table (a, b longs) -> (node, component), the smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and one join, until the edges stop
    changing. Each round is written to the shared folder. Nodes without edges do not appear.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    if now.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops), "components")
