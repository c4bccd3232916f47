"""Operator 11: importance resampling of documents towards a target distribution.

Features are the runs of 1 to 3 words, hashed into buckets. Two counting passes give each bucket's gain, the
scaled logarithm of its share in the target over its share in the corpus; an array of the gains, of fixed size,
goes to the tasks, and a document's weight is the sum over its features. Scores add Gumbel noise, so that the
highest are a draw without replacement. The cutoff is found by bracketing: a quantile sketch gives two scores
around it, exact counts outside the bracket confirm it or widen it, and only the rows in between are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .wordscan import LETTERS, LOWER, column_bytes, run_crcs, word_blocks, word_crcs

BUCKETS, RUN, MIN_WORDS = 10_000, 3, 20
#: Size of the quantile sketch, which is also the reciprocal of its error in rank.
SKETCH = 10_000


def features(column: pa.Array, buckets: int = BUCKETS, run: int = RUN) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("word" or "feature", text's row, bucket) of all words and features of a column of texts, in blocks."""
    data, offsets = column_bytes(column)
    data = LOWER[data]
    carried = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for starts, ends in word_blocks(data, offsets, LETTERS):
        rows = np.searchsorted(offsets, starts, "right") - 1
        new = len(carried[0])
        crc, sizes, rows = (np.concatenate(x) for x in zip(carried, (word_crcs(data, starts, ends), ends - starts, rows), strict=True))
        yield "word", rows[new:], None
        for n, found in enumerate(run_crcs(crc, sizes, run), 1):
            ends_at = np.arange(n - 1, len(crc))
            own = (ends_at >= new) & (rows[n - 1 :] == rows[: len(rows) - n + 1])  # within a text, and not counted before
            yield "feature", rows[n - 1 :][own], (found[own] % buckets).astype(np.int64)
        carried = tuple(x[max(0, len(crc) - run + 1) :] for x in (crc, sizes, rows))


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): how often the texts hold a feature of the bucket; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for kind, _, found in features(batch.column(0), buckets, run):
                if kind == "feature":
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, column: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """The gain of each bucket, floor(1000 ln(share in target / share in docs)), with one added to every count."""
    counts = []
    for table in (target, docs):
        found = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(table, column, buckets, run).collect():  # no more rows than buckets
            found[bucket] = n
        counts.append(found)
    (t, s), (all_t, all_s) = counts, (float(x.sum()) for x in counts)
    return np.array([math.floor(1000 * math.log((a + 1.0) * (all_s + buckets) / ((b + 1.0) * (all_t + buckets)))) for a, b in zip(t.tolist(), s.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, column: str = "text", keep: list[str] | None = None, run: int = RUN) -> DataFrame:
    """The columns in keep with n_words, n_features and weight of every row of docs."""
    keep = [c for c in (keep or ["doc_id"]) if c not in ("n_words", "n_features", "weight")]
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(*keep, F.col(column).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = shared.value
        for batch in batches:
            words, count, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for kind, at, found in features(batch.column(batch.num_columns - 1), len(each), run):
                if kind == "word":
                    words += np.bincount(at, minlength=batch.num_rows)
                else:
                    count += np.bincount(at, minlength=batch.num_rows)
                    weight += np.bincount(at, each[found], batch.num_rows).astype(np.int64)  # whole numbers below 2**53
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (words, count, weight))], [*keep, "n_words", "n_features", "weight"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes), "n_words long, n_features long, weight long"])
    return rows.mapInArrow(score, schema)


def noise(id_column: str = "doc_id", seed: int = 42) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256(`seed:id`); a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`, 1, 2 and so on in an order without ties: sorted in range partitions, then shifted by partition."""
    kept = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    kept = kept.withColumn("_part", F.shiftrightunsigned("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a partition
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") - F.col("_part") * (1 << 33) + 1).drop("_part", "_at", "_start")


def bracket(rows: DataFrame, score: str, n: int, k: int, sketch: int = SKETCH) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest of n scores is from low to high, and `above` rows lie over high.

    The sketch proposes, counts over all rows decide; a bracket that misses is widened on that side.
    """
    least, most = rows.agg(F.min(score), F.max(score)).first()
    slack = 2 / sketch
    while True:
        low_p, high_p = max(0.0, 1 - k / n - slack), min(1.0, 1 - k / n + slack)
        low, high = rows.agg(F.percentile_approx(score, [low_p, high_p], sketch)).first()[0]
        low, high = (least if low_p == 0 else low), (most if high_p == 1 else high)
        above, inside = rows.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score).between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        slack *= 8


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS, seed: int = 42, keep: list[str] | None = None, sketch: int = SKETCH) -> DataFrame:
    """(columns in keep, n_words, n_features, weight, score, rank) of every row of docs(doc_id, text).

    Of the N rows with at least min_words words floor(percent N / 100) are drawn, those of the highest score, of
    equals those of the smallest doc_id (null last; equal rows in the order of storage); their rank is 1, 2 and so
    on, that of others null. Repeated rows count and are drawn one by one. Null and empty texts have no features and
    weigh 0; an empty target or corpus leaves the added ones. keep: columns to carry along, doc_id alone if not
    given; one named like a new column is replaced.
    """
    keep = [c for c in dict.fromkeys(["doc_id", *(keep or [])]) if c not in ("score", "rank")]
    found = weighted(docs, gains(docs, target), keep=keep).withColumn("score", F.col("weight") + noise(seed=seed))
    rows = written(found.withColumn("_row", F.monotonically_increasing_id()), "scores")
    enough = F.col("n_words") >= min_words
    n = rows.where(enough).count()
    k = percent * n // 100
    names = [c for c in rows.columns if c != "_row"]
    if not k:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(rows.where(enough).select("score"), "score", n, k, sketch)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    inside = rows.where(enough & F.col("score").between(low, high)).select("score", "doc_id", "_row")
    cut = numbered(inside, order, "_place").where(F.col("_place") == k - above).select("score", "doc_id", "_row").first()
    last = F.lit(cut["doc_id"]).cast(rows.schema["doc_id"].dataType)
    sooner = F.when(F.col("doc_id").eqNullSafe(last), F.col("_row") <= cut["_row"]).when(F.col("doc_id").isNull(), False).when(last.isNull(), True).otherwise(F.col("doc_id") < last)
    drawn = enough & ((F.col("score") > cut["score"]) | ((F.col("score") == cut["score"]) & sooner))
    ranks = numbered(rows.where(drawn), order, "rank")
    return ranks.select(*names, "rank").unionByName(rows.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))
