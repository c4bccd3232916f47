"""Operator 2: benchmark decontamination by suffix arrays over the training words.

The training table is cut into shards (runs of documents within a task). A shard's suffix array holds its
word suffixes in order; those whose first two words begin no benchmark suffix cannot match one and are left
out before sorting. Every benchmark suffix that starts a window is binary-searched in every shard; the
range found gives the window's places, and consecutive windows on a diagonal give longest verbatim matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import word_hashes

WINDOW = 10
#: Benchmark bytes that one pass broadcasts, and training words of a shard.
PASS_BYTES, SHARD_WORDS = 8 << 20, 1 << 20

MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
FOUND = {"_n_words": "long", "_n_hit": "long", "_hits": "binary", "_matches": "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"}


class TestWindows:
    """The benchmark suffixes that start a window, as ranks in the benchmark's own vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        words = [word_hashes(text.encode()) for _, text in items]
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        blocks = [np.zeros((0, window), np.int64)]
        of, at, size = [], [], []
        for k, w in enumerate(words):
            m = min(window, len(w))
            if m:
                ranks = np.searchsorted(self.vocabulary, w).astype(np.int64) + 1
                found = np.lib.stride_tricks.sliding_window_view(ranks, m)
                blocks.append(np.pad(found, ((0, 0), (0, window - m))))
                of.append(np.full(len(found), k))
                at.append(np.arange(len(found)))
                size.append(np.full(len(found), m))
        self.rows = np.concatenate(blocks)
        self.of, self.at, self.size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (of, at, size))
        single = self.size == 1
        self.singles = np.unique(self.rows[single, 0])
        second = self.rows[:, 1] if window > 1 else np.zeros(len(self.rows), np.int64)
        self.pair = self.rows[:, 0] << 32 | second
        self.pairs = np.unique(self.pair[~single])

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """1 + rank of each word in the vocabulary, 0 if it is not there."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def search(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence of a window in a shard's ranks."""
        window = self.rows.shape[1]
        ranks = np.concatenate([ranks, np.zeros(window + 1, np.int64)])
        place = np.flatnonzero(ranks)
        pair = ranks[place] << 32 | ranks[place + 1]
        keep = np.zeros(len(place), bool)
        for wanted, have in ((self.pairs, pair), (self.singles, ranks[place])):
            if len(wanted):
                keep |= wanted[np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)] == have
        place = place[keep]
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        suffixes = ranks[place[:, None] + np.arange(window)]
        order = np.lexsort(suffixes.T[::-1])
        array, suffixes = place[order], suffixes[order]
        first = suffixes[:, 0] << 32 | (suffixes[:, 1] if window > 1 else 0)
        single = self.size == 1
        lo = np.searchsorted(first, np.where(single, self.rows[:, 0] << 32, self.pair), "left")
        hi = np.searchsorted(first, np.where(single, (self.rows[:, 0] + 1) << 32, self.pair + 1), "left")
        places, windows = [], []
        for t in np.flatnonzero(hi > lo):
            a, b = int(lo[t]), int(hi[t])
            for c in range(2, int(self.size[t])):
                column, word = suffixes[a:b, c], self.rows[t, c]
                a, b = a + int(np.searchsorted(column, word, "left")), a + int(np.searchsorted(column, word, "right"))
                if a == b:
                    break
            if a < b:
                places.append(array[a:b])
                windows.append(np.full(b - a, t))
        return (np.concatenate(places), np.concatenate(windows)) if places else (np.zeros(0, np.int64),) * 2


def _runs(tests: TestWindows, places: np.ndarray, windows: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, doc word, item word, words) of the maximal runs of consecutive windows on a diagonal."""
    item, at = tests.of[windows], tests.at[windows]
    order = np.lexsort((at, places - at, item))
    item, at, places, size = item[order], at[order], places[order], tests.size[windows][order]
    new = np.ones(len(order), bool)
    new[1:] = (item[1:] != item[:-1]) | (places[1:] - at[1:] != places[:-1] - at[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return [(int(item[f]), int(places[f]), int(at[f]), int(at[e] - at[f] + size[e])) for f, e in zip(first, last, strict=True)]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES, keep: list[str] | None = None, every: bool = False) -> DataFrame:
    """docs with _n_words, _n_hit, _hits (a packed bit a word) and _matches (item, places, length in words).

    The benchmark (item_id, text) is taken in passes of about pass_bytes, one if it is small; each pass
    broadcasts its items and adds to the new columns without a shuffle. Items without text or words match
    nothing; one without id has matches with a null id. Documents without words get 0, no bits and no matches. All columns of
    docs stay, or those in keep; columns of docs named like the new ones are replaced. _matches has the
    longest match of each item, the first of equals, or with every all of them (an item of one word then has
    as many as the word occurs).
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in FOUND]
    now = docs.select(*names)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_bytes))
    now = now.withColumns({c: F.lit(None).cast(kind) for c, kind in FOUND.items()})
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        tests = spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part), key=lambda i: (i[0] is not None, i[0] or "", i[1])))
        after = now.select(*[c for c in now.columns if c in FOUND or c in (keep or names)]) if k == passes - 1 else now
        now = now.mapInArrow(_scan(tests, window, after.columns, every), after.schema)
    return now


def _scan(tests, window: int, columns: list[str], every: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestWindows(tests.value, window)
        for batch in batches:
            at, texts = 0, batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            while at < batch.num_rows:
                words, n = [], 0
                while at + len(words) < batch.num_rows and n < SHARD_WORDS:
                    words.append(word_hashes(texts[at + len(words)].as_py() or b""))
                    n += len(words[-1]) + 1
                part = batch.slice(at, len(words))
                at += len(words)
                yield _shard(test, part, words, every).select(columns)

    return scan


def _shard(test: TestWindows, part: pa.RecordBatch, words: list[np.ndarray], every: bool) -> pa.RecordBatch:
    gap = np.zeros(1, np.uint64)
    joined = np.concatenate([x for w in words for x in (w, gap)])
    start = np.cumsum([0, *(len(w) + 1 for w in words)])
    ranks = test.ranks(joined)
    ranks[start[1:] - 1] = 0  # between documents
    places, windows = test.search(ranks)
    delta = np.zeros(len(joined) + 1, np.int32)
    np.add.at(delta, places, 1)
    np.add.at(delta, places + test.size[windows], -1)
    hit = np.cumsum(delta[:-1]) > 0
    found: dict[int, list[dict]] = {}
    doc = np.searchsorted(start, places, "right") - 1
    for d in np.unique(doc).tolist():
        mine = doc == d
        runs = _runs(test, places[mine] - start[d], windows[mine])
        if not every:
            longest: dict[int, tuple[int, int, int, int]] = {}
            for run in runs:
                if run[0] not in longest or run[3] > longest[run[0]][3]:
                    longest[run[0]] = run
            runs = longest.values()
        found[d] = [dict(zip(("item_id", "doc_word", "item_word", "n_words"), (test.ids[i], *rest), strict=True)) for i, *rest in runs]
    before_hits, before = part.column(part.schema.get_field_index("_hits")), part.column(part.schema.get_field_index("_matches"))
    hits, n_hit, matches = [], [], []
    for d, w in enumerate(words):
        bits = np.packbits(hit[start[d] : start[d] + len(w)]).tobytes()
        if (old := before_hits[d].as_py()) is not None:
            bits = (np.frombuffer(bits, np.uint8) | np.frombuffer(old, np.uint8)).tobytes()
        hits.append(bits)
        n_hit.append(int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()) if d in found or old else 0)
        matches.append((before[d].as_py() or []) + found.get(d, []))
    n_words = pa.array([len(w) for w in words], pa.int64())
    columns = {**dict(zip(part.schema.names, part.columns, strict=True)), "_n_words": n_words, "_n_hit": pa.array(n_hit, pa.int64()), "_hits": pa.array(hits, pa.binary()), "_matches": pa.array(matches, MATCHES)}
    return pa.RecordBatch.from_arrays([columns[c] for c in part.schema.names], part.schema.names)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES, every: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items, matches, contaminated) of docs(doc_id, text); items in order, as strings.

    Words of an item without id count as hit, though it is not among the items.
    """
    found = find_matches(docs.select("doc_id", "text"), benchmark, window, pass_bytes, keep=["doc_id"], every=every)
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("_matches", lambda m: m["item_id"]))))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), items.alias("items"), F.col("_matches").alias("matches"), (F.size("_matches") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any benchmark window, with their columns."""
    return find_matches(docs, benchmark, window).where(F.size("_matches") == 0).select(*docs.columns)
