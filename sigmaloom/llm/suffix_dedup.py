"""Operator 3: removal of long repeated byte strings through a logarithmic family of sampled suffix arrays.

A string of `match` bytes is judged by content alone, so suffixes are sampled by content: of every window of
`match` bytes the leftmost k-gram of least hash is its anchor, and a suffix array holds the suffixes at
anchors, ordered by the fingerprint of their first k bytes, equal ones as one entry with its count. Two
equal windows have equal anchors, so no match is missed. An entry also has fingerprints of its context, the
bytes of all windows that have this anchor: `lo` and `hi`, the least and greatest.

The table comes in batches. A new batch gets its suffix array, is merge-scanned against each level of the
family (both sorted and bucketed by the key, so the join moves no rows), and becomes a level of size 1; two
levels of equal size merge before the next batch comes. What the scans return are the keys that occur more
than once. If all occurrences of a key have one context, every window of theirs repeats.

Otherwise the distinct contexts of a key are refined as in suffix sorting by doubling, from coarse to fine. A
window is named by t, the bytes it has before the anchor. Ranges of t are halved twice a round, and in a range
contexts are ordered by their core, the bytes that all windows of the range share. A context alone with its
core has no repeat there and leaves the range. Contexts with equal bytes over all of the range repeat in all
of it, and one of them stays to be compared. What is left goes to the quarters of the range, until ranges are
single windows. A round has about one row a context, however many contexts a key has, and groups them with
partial aggregation, so a frequent key needs no other way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .words import BYTE_VALUES, prefix_hashes, slice_hashes

MATCH, GRAM, BATCHES = 200, 40, 8
#: Bytes hashed at once.
CHUNK = 1 << 20
ENTRIES = "ref binary, start long, windows int, lead int, key long, ctx long"
SPAN_LIST = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def anchors(texts: list[bytes], match: int = MATCH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, anchor's place in the first, key, context) of every anchor of texts, in arrays by chunks.

    A text longer than a chunk is cut into overlapping pieces; each window is in one piece.
    """
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - match + 1), CHUNK):
            piece = text[at : at + CHUNK + match - 1]
            if len(piece) < match:
                continue
            if held and held + len(piece) > CHUNK:
                yield _chunk_anchors(pieces, match, gram)
                pieces, held = [], 0
            pieces.append((k, at, piece))
            held += len(piece)
    if pieces:
        yield _chunk_anchors(pieces, match, gram)


def _chunk_anchors(pieces: list[tuple[int, int, bytes]], match: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(sizes) - sizes
    prefix = prefix_hashes(BYTE_VALUES[data])
    at = np.arange(len(data) - gram + 1)
    grams = slice_hashes(prefix, at, at + gram)
    order = (grams >> np.uint64(22) << np.uint64(22)) | at.astype(np.uint64)  # least hash, then leftmost
    span, width = 1, match - gram + 1
    while 2 * span <= width:
        order = np.minimum(order[:-span], order[span:])
        span *= 2
    if span < width:
        order = np.minimum(order[: len(order) - (width - span)], order[width - span :])
    anchor = (order & np.uint64((1 << 22) - 1)).astype(np.int64)  # of the window at each place
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + match <= (begins + sizes)[piece]
    windows = np.flatnonzero(inside)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[windows[1:]] != anchor[windows[:-1]]) | (piece[windows[1:]] != piece[windows[:-1]])
    runs = np.flatnonzero(new)
    first, count = windows[runs], np.diff(np.append(runs, len(windows)))
    spot = anchor[first]
    context = slice_hashes(prefix, first, first + count + match - 1) ^ (((spot - first) << 20) + count).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    of = piece[first]
    start = first - begins[of] + np.array([a for _, a, _ in pieces])[of]
    return np.array([k for k, _, _ in pieces])[of], start, count, spot - first, grams[spot].view(np.int64), context.view(np.int64)


class Tables:
    """Temporary tables in the warehouse, dropped as soon as they have served."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def write(self, df: DataFrame, bucket: tuple[str, ...] = (), split: str | None = None) -> str:
        name = f"sigmaloom_{uuid.uuid4().hex}"
        writer = df.write.format("parquet")
        if bucket:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            writer = writer.bucketBy(parts, *bucket).sortBy(*bucket)
        if split:
            writer = writer.partitionBy(split)
        self.names.append(name)
        writer.saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names or tuple(self.names):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if name in self.names:
                self.names.remove(name)


def sampled_suffixes(docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """An entry (ref, start, windows, lead, key, ctx) for every anchor of docs(ref, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for text, start, count, lead, key, ctx in anchors([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], match, gram):
                    columns = [part.column(0).take(pa.array(text)), pa.array(start), pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(key), pa.array(ctx)]
                    yield pa.RecordBatch.from_arrays(columns, ["ref", "start", "windows", "lead", "key", "ctx"])

    return docs.select("ref", "text").mapInArrow(run, ENTRIES)


class SuffixFamily:
    """The logarithmic family: levels of sizes 1, 2, 4 and so on, in batches."""

    def __init__(self, tables: Tables):
        self.tables, self.spark = tables, tables.spark
        self.levels: list[tuple[int, str]] = []

    def add(self, entries: DataFrame) -> DataFrame:
        """Take in a batch; the keys (key, lo, hi) that repeat in it or between it and a level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge()
        array = entries.groupBy("key").agg(F.min("ctx").alias("lo"), F.max("ctx").alias("hi"), F.count("*").alias("n"))
        name = self.tables.write(array, bucket=("key",))
        new = self.spark.table(name)
        found = new.where("n > 1").select("key", "lo", "hi")
        for _, level in self.levels:
            both = new.alias("x").join(self.spark.table(level).alias("y"), "key")
            found = found.union(both.select("key", F.least("x.lo", "y.lo").alias("lo"), F.greatest("x.hi", "y.hi").alias("hi")))
        self.levels.append((1, name))
        return written(found, "repeated-keys")

    def _merge(self) -> None:
        (size, a), (_, b) = self.levels[-2:]
        x, y = self.spark.table(a).alias("x"), self.spark.table(b).alias("y")
        n = F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))
        both = x.join(y, "key", "full").select("key", F.least("x.lo", "y.lo").alias("lo"), F.greatest("x.hi", "y.hi").alias("hi"), n.alias("n"))
        self.levels[-2:] = [(2 * size, self.tables.write(both, bucket=("key",)))]
        self.tables.drop(a, b)


def repeated_spans(docs: DataFrame, match: int = MATCH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(ref, spans) of the rows of docs(ref, text) that hold a string of `match` bytes which also starts elsewhere.

    spans: an array of (a, b), byte a up to byte b, that together cover all such strings; their number is
    bounded by the length of a text, as rows alike in ref have each once.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    try:
        entries = sampled_suffixes(docs, match, gram).withColumn("batch", F.pmod(F.xxhash64("ref"), F.lit(batches)).cast("int"))
        stored = tables.write(entries, split="batch")
        family = SuffixFamily(tables)
        found = reduce(DataFrame.union, [family.add(spark.table(stored).where(F.col("batch") == k)) for k in range(batches)])
        keys = written(found.groupBy("key").agg((F.min("lo") == F.max("hi")).alias("pure")), "keys")  # so that Spark can split a frequent key in the join
        hits = written(spark.table(stored).join(keys, "key").drop("batch"), "repeated-entries")
        tables.drop()
        mixed = hits.where("not pure")
        member = F.struct("ref", "start", "windows", "lead")
        classes = written(mixed.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(member).alias("m")), "contexts")
        shown = classes.select("m.ref", F.struct("key", "ctx", (F.col("n") == 1).alias("open"), "m.start", "m.windows", "m.lead").alias("c"))
        contexts = _contexts(docs.join(shown.groupBy("ref").agg(F.collect_list("c").alias("c")), "ref"), match).dropDuplicates(["key", "ctx"])
        kept = _refined(spark.table(tables.write(contexts, bucket=("key", "ctx"))), match, gram)
    finally:
        tables.drop()
    last = F.col("start") + F.col("windows") - 1 + match
    pure = hits.where("pure").select("ref", F.col("start").alias("a"), last.alias("b"))
    copies = mixed.join(classes.where("n > 1").select("key", "ctx"), ["key", "ctx"]).select("ref", F.col("start").alias("a"), last.alias("b"))
    anchor = F.col("m.start") + F.col("m.lead")
    single = classes.where("n = 1").join(kept, ["key", "ctx"]).select("m.ref", (anchor - F.col("most")).alias("a"), (anchor - F.col("least") + match).alias("b"))
    spans = pure.union(copies).union(single)
    return spans.groupBy("ref").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _contexts(rows: DataFrame, match: int) -> DataFrame:
    """(key, ctx, open, low, high, data) of the contexts in rows(text, c): their windows have low to high bytes before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for text, contexts in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    out += [(c["key"], c["ctx"], c["open"], c["lead"] - c["windows"] + 1, c["lead"], text[c["start"] : c["start"] + c["windows"] + match - 1]) for c in contexts]
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "ctx", "open", "low", "high", "data"])

    return rows.select("text", "c").mapInArrow(run, "key long, ctx long, open boolean, low int, high int, data binary")


def _refined(contexts: DataFrame, match: int, gram: int) -> DataFrame:
    """(key, ctx, least, most) of the open ones of contexts that have windows which repeat: fewest and most bytes before the anchor.

    contexts: (key, ctx, open, low, high, data), bucketed by key and ctx. Bytes are compared by fingerprints
    of 128 bits, and of 64 more where a core is equal.
    """
    width, asked, settled = 1, None, []
    while 4 * width <= match - gram + 1:
        width *= 4
    while width:
        if asked is None:
            rows = contexts.withColumn("from", F.col("low")).withColumn("to", F.col("high"))
        else:
            reach = [F.greatest("low", F.col("cell") * before).alias("from"), F.least("high", F.col("cell") * before + (before - 1)).alias("to")]
            rows = contexts.drop("open").join(asked, ["key", "ctx"]).select("key", "ctx", "open", "low", "high", "data", *reach)
        rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / width).cast("int"), F.floor(F.col("to") / width).cast("int"))))
        rows = rows.withColumn("t1", F.greatest("low", F.col("cell") * width)).withColumn("t2", F.least("high", F.col("cell") * width + (width - 1)))
        core = F.substring("data", F.col("high") - F.col("cell") * width + 1, F.lit(match + 1 - width))
        whole = F.substring("data", F.col("high") - F.col("t2") + 1, F.col("t2") - F.col("t1") + match)
        prints = [F.xxhash64("cell", core).alias("core1"), F.xxhash64(F.lit(width), core, "cell").alias("core2"), F.xxhash64("t1", "t2", whole).alias("whole")]
        rows = written(rows.select("key", "ctx", "open", "cell", "t1", "t2", *prints), "cells")
        alike = rows.groupBy("core1", "core2", "whole").agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min(F.struct("key", "ctx", "cell")).alias("m"))
        alike = written(alike, "alike-cells")
        again = alike.where("n > 1 and open").select("core1", "core2", "whole")
        settled.append(rows.where("open").join(again, ["core1", "core2", "whole"], "left_semi").select("key", "ctx", "t1", "t2"))
        still = F.col("open") & (F.col("n") == 1)
        cores = alike.groupBy("core1", "core2").agg(F.count("*").alias("kinds"), F.max(still).alias("any")).where("kinds > 1 and any")
        split = alike.join(cores.select("core1", "core2"), ["core1", "core2"], "left_semi")
        asked = split.select("m.key", "m.ctx", "m.cell", still.alias("open"))
        before, width = width, width // 4
    return reduce(DataFrame.union, settled).groupBy("key", "ctx").agg(F.min("t1").alias("least"), F.max("t2").alias("most"))


def removed_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    delta = np.zeros(n + 1, np.int32)
    if spans:
        np.add.at(delta, [s["a"] for s in spans], 1)
        np.add.at(delta, [s["b"] for s in spans], -1)
    return np.cumsum(delta[:-1]) > 0


def _with_spans(docs: DataFrame, match: int, gram: int, batches: int) -> DataFrame:
    """docs with _ref, 128 bits that stand for doc_id and text, and _spans. Rows alike in both share their spans."""
    marks = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id")]
    known = docs.withColumn("_ref", F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in marks))))
    spans = repeated_spans(known.select(F.col("_ref").alias("ref"), "text"), match, gram, batches)
    return known.join(spans.select(F.col("ref").alias("_ref"), F.col("spans").alias("_spans")), "_ref", "left")


def remove_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of docs(doc_id, text); kept is the rest of the bytes.

    Every byte covered by a string of `match` bytes that also starts anywhere else goes, in all places,
    judged on the input. Texts are UTF-8 bytes; null and empty texts have none. Of repeated rows each
    counts as a document, so long ones go whole. Other columns are ignored.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = np.frombuffer(text or b"", np.uint8)
                    gone = removed_mask(len(data), spans)
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                    out.append((len(data), int(gone.sum()), runs, data[~gone].tobytes() if runs else text or b""))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), match, gram, batches)
    return rows.select("doc_id", "text", "_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_texts(docs: DataFrame, match: int = MATCH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """docs without the repeated strings in their texts, all columns kept; n_chars, if there, counts what is left.

    A character of which only some bytes are repeated stays. Documents of which nothing but white space is
    left go, if anything was removed; others stay, null and empty texts too.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            out = []
            for text, spans in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text or b"", np.uint8)
                gone = removed_mask(len(data), spans)
                if len(data):
                    heads = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, len(data))))
                out.append(None if text is None else data[~gone].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])

    others = [c for c in docs.columns if c != "text"]
    rows = _with_spans(docs, match, gram, batches).withColumn("_cut", F.col("_spans").isNotNull())
    schema = "text string, " + ", ".join(f"`{c}` {t}" for c, t in rows.select(*others, "_cut").dtypes)
    cut = rows.select("text", "_spans", *others, "_cut").mapInArrow(run, schema).where("not _cut or length(trim(text)) > 0")
    if "n_chars" in others:
        cut = cut.withColumn("n_chars", F.when(F.col("_cut"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
