"""Classification and regression trees with exact splits, level by level.

A level is one aggregation: for every open node and predictor the responses are summed by distinct value, the sums run
along the values, and the best split of a node is a maximum over them. No rows move between levels: a row's node is an
expression of the splits so far.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running
from .regression import complete

MOST_CLASSES = 64
#: Gains are told apart to so many decimals; the first predictor and the smallest value win among equals.
DECIMALS = 10
TREE = "node long, parent long, depth int, n long, impurity double, prediction string, variable string, threshold double, gain double, is_leaf boolean"


def node_of(splits: dict[int, tuple[str, float]]) -> Column:
    """The node a row falls into: 1 at the top, 2k and 2k + 1 below node k, the first for values up to its threshold."""
    node = F.lit(1).cast("long")
    for depth in range(max((k.bit_length() for k in splits), default=0)):
        step = node
        for k, (variable, threshold) in splits.items():
            if k.bit_length() == depth + 1:
                step = F.when(node == k, F.when(F.col(variable).cast("double") <= threshold, 2 * k).otherwise(2 * k + 1)).otherwise(step)
        node = step
    return node


def _impurity(sums: list, classes: bool):
    """Of a node's sums: Gini's share-weighted impurity times n, or the sum of squares around the mean."""
    if classes:
        n = reduce(add, sums)
        return n - reduce(add, [s * s for s in sums]) / n
    n, s, ss = sums
    return ss - s * s / n


def fit_tree(df: DataFrame, response: str, predictors: list[str], classify: bool = True, max_depth: int = 5, min_leaf: int = 5) -> tuple[DataFrame, DataFrame]:
    """(tree, rows): a row a node, and df's complete rows with their node and predicted value.

    Splits are halfway between neighbouring distinct values and leave at least min_leaf rows on either side; a node is
    split by the largest gain in Gini impurity (or in squares) if there is any, down to max_depth. impurity is a node's
    own, gain what its split saves, as a share of its rows (of squares for regression). A leaf predicts its most frequent
    class, the first in order among equals, or its mean. Rows with a missing or infinite predictor or a missing response
    are left out. At most 64 classes; fewer than 2 * min_leaf rows give a tree without rows. Sums of distinct values are
    exact, so a level of a column of real numbers moves about a row a row of df and predictor.
    """
    spark = df.sparkSession
    rows = complete(df, predictors).where(F.col(response).isNotNull())
    for c in predictors:
        rows = rows.where(F.abs(F.col(c).cast("double")) < float("inf"))
    y = F.col(response)
    labels: list = []
    if classify:
        labels = sorted((r[0] for r in rows.select(response).distinct().limit(MOST_CLASSES + 1).collect()), key=str)
        if len(labels) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
        parts = [F.sum(F.when(y == v, 1).otherwise(0)) for v in labels]
    else:
        v = y.cast("double")
        parts = [F.count("*"), F.sum(v), F.sum(v * v)]
    names = [f"_s{k}" for k in range(len(parts))]
    tops = rows.agg(*parts).first() if parts else None
    total = 0 if tops is None or tops[0] is None else sum(tops) if classify else tops[0]
    if total < 2 * min_leaf:
        return spark.createDataFrame([], TREE), rows.withColumns({"node": F.lit(None).cast("long"), "predicted": F.lit(None).cast("string")}).limit(0)
    known: dict[int, list] = {1: [float(t) for t in tops]}  # at most 2 ** max_depth nodes
    splits: dict[int, tuple[str, float]] = {}
    gains: dict[int, float] = {}
    n_of = lambda s: sum(s) if classify else s[0]
    open_ = [1]
    for _ in range(max_depth):
        open_ = [k for k in open_ if n_of(known[k]) >= 2 * min_leaf and _impurity(known[k], classify) > 1e-12]
        if not open_:
            break
        at = rows.withColumn("_node", node_of(splits)).where(F.col("_node").isin(open_))
        pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("x")) for j, c in enumerate(predictors)])).alias("_p")
        counts = at.select("_node", y, pairs).groupBy("_node", F.col("_p.j").alias("_j"), F.col("_p.x").alias("_x")).agg(*[p.cast("double").alias(n) for p, n in zip(parts, names, strict=True)])
        upto = running(counts, ["_node", "_j"], ["_x"], {f"_l{k}": F.col(n) for k, n in enumerate(names)})
        whole = [F.coalesce(*[F.when(F.col("_node") == k, F.lit(known[k][i])) for k in open_]) for i in range(len(names))]
        left = [F.col(f"_l{i}") for i in range(len(names))]
        right = [w - s for w, s in zip(whole, left, strict=True)]
        n_left, n_right = (reduce(add, s) if classify else s[0] for s in (left, right))
        gain = F.round(_impurity(whole, classify) - _impurity(left, classify) - _impurity(right, classify), DECIMALS)
        best = upto.where((n_left >= min_leaf) & (n_right >= min_leaf)).groupBy("_node").agg(F.max(F.struct(gain.alias("gain"), (-F.col("_j")).alias("j"), (-F.col("_x")).alias("x"), *[s.alias(f"l{i}") for i, s in enumerate(left)])).alias("b"))
        chosen = [r for r in best.collect() if r.b.gain > 0]  # a row an open node
        if not chosen:
            break
        wanted = reduce(lambda a, b: a | b, [(F.col("_node") == r._node) & (F.col("_j") == -r.b.j) & (F.col("_x") > -r.b.x) for r in chosen])
        above = {r["_node"]: r["x"] for r in counts.where(wanted).groupBy("_node").agg(F.min("_x").alias("x")).collect()}
        open_ = []
        for r in chosen:
            k, low = r._node, -r.b.x
            splits[k], gains[k] = (predictors[-r.b.j], (low + above[k]) / 2), r.b.gain
            known[2 * k] = [r.b[f"l{i}"] for i in range(len(names))]
            known[2 * k + 1] = [w - s for w, s in zip(known[k], known[2 * k], strict=True)]
            open_ += [2 * k, 2 * k + 1]
    told = lambda s: str(labels[s.index(max(s))]) if classify else str(s[1] / s[0])
    table = [
        (k, k // 2 or None, k.bit_length() - 1, int(n_of(s)), _impurity(s, classify) / (n_of(s) if classify else 1.0), told(s), *splits.get(k, (None, None)), gains[k] / n_of(s) if k in gains and classify else gains.get(k), k not in splits)
        for k, s in sorted(known.items())
    ]
    leaves = {k: told(s) for k, s in known.items() if k not in splits}
    node = F.col("node")
    predicted = F.coalesce(*[F.when(node == k, F.lit(v)) for k, v in leaves.items()])
    return spark.createDataFrame(table, TREE), rows.withColumn("node", node_of(splits)).withColumn("predicted", predicted)


def importance(tree: DataFrame) -> DataFrame:
    """The share of all gains, weighted by rows, that each variable's splits have."""
    parts = tree.where("not is_leaf").groupBy("variable").agg(F.sum(F.col("gain") * F.col("n")).alias("_g"))
    return parts.crossJoin(F.broadcast(parts.agg(F.sum("_g").alias("_all")))).select("variable", (F.col("_g") / F.col("_all")).alias("importance"))
