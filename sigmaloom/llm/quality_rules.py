"""Operator 13: quality rules whose cutoffs keep a promise about false rejections.

Every rule looks at one signal of a text and has a fixed list of cutoffs, from lenient to strict. Rows with a
quality label are the holdout. For each stratum and rule, the false rejections of a cutoff are the good rows it
rejects; an exact binomial (Clopper-Pearson) upper bound of their rate must not pass the rule's share of the risk.
As stricter cutoffs never reject fewer rows, the list is tested from its lenient end at one level, and the levels
of all strata and rules share the error by Bonferroni. So with probability 1 - error no stratum loses more than
`risk` of its good rows to the rules. Of the certified cutoffs that which rejects most bad rows is taken, of equals
the most lenient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import beta_quantile
from .common import written
from .wordscan import NO_SPACE, column_bytes, word_blocks
from .words import BYTE_VALUES, mixed, prefix_hashes, slice_hashes

#: Share of a stratum's good rows that all rules together may reject, and the chance that they reject more in any.
RISK, ERROR = 0.02, 0.05
SYMBOLS = b"#*$%&|<>"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: A rule rejects when 1000 * its first column is beyond (+1: above, -1: below) a cutoff * its second column.
RULES: dict[str, tuple[str, str, int, list[int]]] = {
    "symbols": ("n_symbols", "n_words", 1, [2000, 1000, 500, 300, 200, 100, 50, 20]),
    "long_words": ("word_chars", "n_words", 1, [12000, 10000, 9000, 8000, 7500, 7000, 6500, 6250, 6000, 5750]),
    "short_words": ("word_chars", "n_words", -1, [2000, 2500, 3000, 3500, 3750, 4000, 4250, 4500]),
    "repeated_lines": ("n_dup_lines", "n_lines", 1, [900, 800, 700, 600, 500, 450, 400, 350, 300, 250]),
}


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice; the slices lie in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = int(starts[0])
    return slice_hashes(prefix_hashes(BYTE_VALUES[data[low : int(ends[-1])]]), starts - low, ends - low)


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is equal to another of its row, is equal to an earlier one of its row) for hashes in the order of their places."""
    order = np.lexsort((np.arange(len(rows)), hashes, rows))
    same = np.zeros(len(rows), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    earlier = np.zeros(len(rows), bool)
    earlier[order] = same
    shared = np.zeros(len(rows), bool)
    shared[order] = same | np.append(same[1:], False)
    return shared, earlier


def text_signals(column: pa.Array) -> dict[str, np.ndarray]:
    """The signals of each text of a column; a null text has none of anything.

    Words and lines are compared by 64-bit hashes of all their bytes.
    """
    data, offsets = column_bytes(column)
    n = len(offsets) - 1
    out = {c: np.zeros(n, np.int64) for c in SIGNALS}
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    lines, ends = bounds[:-1], bounds[1:]
    blank = np.ones(len(lines), bool)
    words, rows = [], []
    for starts, stops in word_blocks(data, offsets, NO_SPACE):
        if not len(starts):
            continue
        at = np.searchsorted(offsets, starts, "right") - 1
        low, high = int(starts[0]), int(stops[-1])
        inside = np.zeros(high - low + 1, np.int64)
        chars = (data[low:high] & 0xC0) != 0x80
        np.cumsum(chars & NO_SPACE[data[low:high]], out=inside[1:])
        out["n_words"] += np.bincount(at, minlength=n)
        out["word_chars"] += np.bincount(at, inside[stops - low] - inside[starts - low], n).astype(np.int64)
        blank[np.searchsorted(lines, starts, "right") - 1] = False
        words.append(_hashes(data, starts, stops))
        rows.append(at)
    symbols = np.flatnonzero(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    out["n_symbols"] += np.bincount(np.searchsorted(offsets, symbols, "right") - 1, minlength=n)
    lines, ends = lines[~blank], ends[~blank]
    of = np.searchsorted(offsets, lines, "right") - 1
    out["n_lines"] += np.bincount(of, minlength=n)
    step = max(1, len(lines) // max(1, len(data) // (1 << 20)))  # some lines, about a megabyte of them
    found = [_hashes(data, lines[k : k + step], ends[k : k + step]) for k in range(0, len(lines), step)]
    _, earlier = _repeats(of, np.concatenate([*found, np.zeros(0, np.uint64)]))
    out["n_dup_lines"] += np.bincount(of[earlier], minlength=n)
    words, rows = np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate([*rows, np.zeros(0, np.int64)])
    if len(words) > 2:
        windows = mixed(words[:-2] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(words[2:])))
        own = np.flatnonzero(rows[:-2] == rows[2:])
        shared, _ = _repeats(rows[own], windows[own])
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[own[shared] + k] = True
        out["n_repeat_words"] += np.bincount(rows[covered], minlength=n)
    return out


def signals(docs: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id if not given) and the signals of every row of docs; columns so named are replaced."""
    keep = [c for c in (keep or ["doc_id"]) if c not in SIGNALS]
    rows = docs.select(*keep, F.col(column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_signals(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[c]) for c in SIGNALS)], [*keep, *SIGNALS])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes), *(f"{c} long" for c in SIGNALS)]))


def base_failed(min_words: int = 50, most_repeated: int = 50) -> Column:
    """Too few words, or more than so many percent of them in repeated windows of three words."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def level(rule: str) -> Column:
    """How many of the rule's cutoffs, from the strict end, reject the row."""
    a, b, sign, cutoffs = RULES[rule]
    value = 1000 * F.col(a)
    return sum((((value > c * F.col(b)) if sign > 0 else (value < c * F.col(b))).cast("int") for c in cutoffs), F.lit(0))


def label_table(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) once for every doc_id with one quality of 0 or 1; contrary labels and nulls count as none."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    return rows.agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")


@F.pandas_udf(DoubleType())
def upper_bound(wrong: pd.Series, n: pd.Series, error: pd.Series) -> pd.Series:
    """Exact upper bound of a rate at which `wrong` of n were seen; 1 where there is nothing to see."""
    return pd.Series([1.0 if k >= m else beta_quantile(1 - e, k + 1, m - k) for k, m, e in zip(wrong, n, error, strict=True)], dtype=float)


def certified(found: DataFrame, labels: DataFrame, strata: list[str], risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(strata, rule, place, cutoff, n_good, good_out, bad_out, bound, certified, chosen): every cutoff of every rule.

    found has signals, strata and doc_id. Rows that fail the base rules are left out, as the rules never see them.
    Strata without good labels certify nothing.
    """
    known = found.where(~base_failed()).join(label_table(labels), "doc_id")
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES])).alias("_r")
    counts = known.select(*strata, "quality", rules).groupBy(*strata, "_r.rule", "_r.level").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    counts = counts.withColumnRenamed("rule", "_rule")  # a row a stratum, rule and level
    n_strata = known.select(*strata).distinct().count()
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k).alias("place"), F.lit(c).alias("cutoff"), F.lit(len(x[3]) - k).alias("least")) for r, x in RULES.items() for k, c in enumerate(x[3])])
    sums = counts.select("*", F.explode(F.filter(steps, lambda s: s["rule"] == F.col("_rule"))).alias("s"))
    out = F.col("level") >= F.col("s.least")
    each = sums.groupBy(*strata, F.col("s.rule").alias("rule"), F.col("s.place").alias("place"), F.col("s.cutoff").alias("cutoff")).agg(
        F.sum("good").alias("n_good"), F.coalesce(F.sum(F.when(out, F.col("good"))), F.lit(0)).alias("good_out"), F.coalesce(F.sum(F.when(out, F.col("bad"))), F.lit(0)).alias("bad_out")
    )
    each = each.withColumn("bound", upper_bound("good_out", "n_good", F.lit(error / max(1, len(RULES) * n_strata))))
    each = each.withColumn("certified", F.col("bound") <= risk / len(RULES))
    best = Window.partitionBy(*strata, "rule").orderBy(F.desc("certified"), F.desc("bad_out"), "place")  # a row a cutoff
    return each.withColumn("chosen", F.col("certified") & (F.col("bad_out") > 0) & (F.row_number().over(best) == 1))


def apply_rules(docs: DataFrame, labels: DataFrame, strata: list[str] | None = None, risk: float = RISK, error: float = ERROR, column: str = "text") -> DataFrame:
    """(doc_id, strata, signals, base_failed, failed, kept) of every row of docs: failed lists the rules that reject it.

    strata: columns of docs (lang if not given), null being a stratum of its own; none of them may be named like a
    signal. A row without doc_id has no label but is judged. Null and empty texts have no words and fail the base
    rules. Repeated rows are judged, and if labelled counted, one by one. Where a stratum's labels certify no cutoff
    of a rule, that rule rejects nothing there.
    """
    strata = ["lang"] if strata is None else strata
    found = written(signals(docs, column, ["doc_id", *strata]), "signals")
    table = certified(found, labels, strata, risk, error).where("chosen")
    names = [f"_s_{c}" for c in strata]
    chosen = table.groupBy(*[F.col(c).alias(n) for c, n in zip(strata, names, strict=True)]).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    chosen = written(chosen, "cutoffs")  # a row a stratum, of a few cutoffs
    same = F.lit(True)
    for c, n in zip(strata, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    rows = found.join(chosen, same, "left").withColumn("base_failed", base_failed())
    beyond = []
    for rule, (a, b, sign, _) in RULES.items():
        cut = F.col("_cutoffs")[rule]
        value = sign * (1000 * F.col(a) - cut * F.col(b))
        beyond.append(F.when(value > 0, F.lit(rule)))
    rows = rows.withColumn("failed", F.array_compact(F.array(*beyond)))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return rows.select("doc_id", *strata, *SIGNALS, "base_failed", "failed", kept.alias("kept"))
