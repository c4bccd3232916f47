"""Principal components, k-means and discriminants from sums that Spark makes."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regression import complete


def _moments(rows: DataFrame, x: list[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance) in one aggregation."""
    p = len(x)
    r = rows.agg(F.count("*"), *[F.avg(c) for c in x], *[F.covar_samp(x[i], x[j]) for i in range(p) for j in range(i, p)]).first()
    m, at = np.zeros((p, p)), p + 1
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = r[at]
            at += 1
    return r[0], np.array(r[1 : p + 1], float), m


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Each column's largest component positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])


def pca(df: DataFrame, columns: list[str], correlation: bool = True) -> DataFrame:
    """Eigenvalues, shares and loadings, a row a component and column."""
    _, _, m = _moments(complete(df, columns), [F.col(c).cast("double") for c in columns])
    if correlation:
        s = np.sqrt(np.diag(m))
        m = m / np.outer(s, s)
    values, vectors = np.linalg.eigh(m)
    order = values.argsort()[::-1]
    values, vectors = values[order], _oriented(vectors[:, order])
    rows = [(k + 1, float(v), float(v / values.sum()), float(values[: k + 1].sum() / values.sum()), c, float(vectors[i, k] * np.sqrt(max(v, 0.0)))) for k, v in enumerate(values) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, cumulative double, variable string, loading double")


def pca_scores(df: DataFrame, columns: list[str], components: int = 2) -> DataFrame:
    """df's complete rows with scores pc1.. of standardised columns, T squared of these and the squared rest Q."""
    rows, x = complete(df, columns), [F.col(c).cast("double") for c in columns]
    _, mean, m = _moments(rows, x)
    s = np.sqrt(np.diag(m))
    values, vectors = np.linalg.eigh(m / np.outer(s, s))
    order = values.argsort()[::-1]
    values, vectors = values[order], _oriented(vectors[:, order])
    z = [(c - float(a)) / float(b) for c, a, b in zip(x, mean, s, strict=True)]
    scores = [reduce(add, [z[i] * float(vectors[i, k]) for i in range(len(z))]) for k in range(components)]
    out = rows.withColumns({f"pc{k + 1}": c for k, c in enumerate(scores)})
    t2 = reduce(add, [F.col(f"pc{k + 1}") ** 2 / float(values[k]) for k in range(components)])
    return out.withColumn("t2", t2).withColumn("q", reduce(add, [c * c for c in z]) - reduce(add, [F.col(f"pc{k + 1}") ** 2 for k in range(components)]))


def kmeans(df: DataFrame, columns: list[str], order: str, k: int, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows with cluster, centres) by Lloyd's steps from the first k complete rows in order.

    A step is one aggregation; a cluster without rows keeps its centre.
    """
    rows, x = complete(df, columns), [F.col(c).cast("double") for c in columns]
    centres = np.array([[float(r[c]) for c in columns] for r in rows.orderBy(order).limit(k).collect()])
    if not len(centres):
        return rows.withColumn("cluster", F.lit(None).cast("int")), df.sparkSession.createDataFrame([], "cluster int, n long, variable string, centre double")

    def nearest() -> Column:
        far = F.array(*[reduce(add, [(c - float(v)) ** 2 for c, v in zip(x, centre, strict=True)]) for centre in centres])
        return (F.array_position(far, F.array_min(far)) - 1).cast("int")

    for _ in range(rounds):
        sums = rows.groupBy(nearest().alias("cluster")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(x)]).collect()  # k rows
        new = centres.copy()
        for r in sums:
            new[r.cluster] = [r[f"a{i}"] for i in range(len(x))]
        if np.array_equal(new, centres):
            break
        centres = new
    n = {r.cluster: r.n for r in sums}
    table = [(c, n.get(c, 0), name, float(centres[c][i])) for c in range(len(centres)) for i, name in enumerate(columns)]
    return rows.withColumn("cluster", nearest()), df.sparkSession.createDataFrame(table, "cluster int, n long, variable string, centre double")


def discriminant(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """df's complete rows with `predicted` by linear discriminants: pooled covariance, priors by size."""
    rows, x, p = complete(df, columns).where(F.col(label).isNotNull()), [F.col(c).cast("double") for c in columns], len(columns)
    sums = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(p)]).collect()  # a row a class
    sums = sorted((r for r in sums if r.n > 1), key=lambda r: str(r[label]))
    total = sum(r.n for r in sums)
    pooled = sum((r.n - 1) * np.array([[r[f"c{i}_{j}"] for j in range(p)] for i in range(p)]) for r in sums) / (total - len(sums))
    inverse = np.linalg.pinv(pooled)
    scores = []
    for r in sums:
        m = np.array([r[f"m{i}"] for i in range(p)])
        w = inverse @ m
        scores.append(F.struct((reduce(add, [c * float(v) for c, v in zip(x, w, strict=True)]) + float(np.log(r.n / total) - m @ w / 2)).alias("s"), F.lit(r[label]).alias("l")))
    return rows.withColumn("predicted", F.array_max(F.array(*scores))["l"])


def confusion(rows: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))
