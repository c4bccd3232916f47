"""Operator 5: SimHash near-duplicates through a Gray-order hierarchical index.

Of distance + c blocks of bits, fingerprints at up to `distance` differing bits agree on c at least. Each
distinct fingerprint is therefore indexed once for every choice of c blocks, and rows that share the bits of
these blocks form a group; c follows the number of fingerprints, so that groups stay small. Within a group
fingerprints are sorted by Gray rank, runs of them are nodes that keep the bits all members share (a mask and
their values) and that their upper node does not have, and runs of nodes are upper nodes. A search starts at
the upper nodes, carries the differences from shared bits down, and leaves whole nodes out once these exceed
the distance. Only a spanning forest of the links found in a group leaves its task.

Pairs of a given shingle Jaccard differ in too many bits for such blocks: at 0.8 in about 10 of 64, and for
nearly all of them in up to 20. keep_first_similar therefore extends the fingerprint by further words of SimHash
bits and indexes it once for each of several random sets of bits, whose size and number follow from the number of
fingerprints and the recall. The groups are searched by the same index, and the exact Jaccard of the shingle
sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, tiled, written

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Members of a node, rows of a group that one task compares, and rows and pairs in memory at once.
FANOUT, TILE_ROWS, BUFFER_ROWS, FRONTIER = 8, 4096, 400_000, 2_000_000
#: Fingerprints of a group that are expected at most, were their bits random.
GROUP_ROWS = 256
#: Near-duplicate stages: words of a shingle and least Jaccard; words of a fingerprint; bits of its first word and of
#: all that a linked pair may differ in (over 4 deviations more than at 0.8); and shingles of a group that one task compares.
STAGE_SHINGLE, JACCARD, PRINT_WORDS, MOST_BITS, MOST_WIDE_BITS, TILE_SHINGLES = 5, 0.8, 3, 24, 56, 1 << 21
#: Share of bits in which a pair at 0.8 differs, one deviation more than its mean of 0.15, and the chance to miss it;
#: rows of a group that are expected, were bits random, and pairs looked at together.
PAIR_SHARE, MISS, WIDE_GROUP_ROWS, PAIRS_AT_ONCE = 0.175, 0.003, 512, 250_000

BYTE_PLACES = np.arange(8, dtype=np.int64) * 256
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's word shingles in order; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(joined))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)


def majority_bits(h: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes."""
    by_byte = np.bincount((h.view(np.uint8).reshape(-1, 8) + BYTE_PLACES).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((by_byte @ BYTE_BITS).ravel() * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    return majority_bits(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (default doc_id) with `fingerprint`, a signed long. Null texts count as empty."""
    keep = [c for c in (keep or ["doc_id"]) if c != "fingerprint"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", fingerprint long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints = [fingerprint(t or b"", shingle) for t in part.column(len(keep)).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.array(prints, np.uint64).view(np.int64))], [*keep, "fingerprint"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """The hierarchical index of the groups of one buffer; group and codes are sorted by (group, Gray rank)."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # shared bits that the upper node lacks, values, first child
        shared, values = np.full(len(codes), ~np.uint64(0)), codes
        while True:
            n = len(values)
            first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
            starts = np.flatnonzero(first)
            place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            runs = np.flatnonzero(place % FANOUT == 0)
            if len(self.levels) and len(runs) == n:  # every group is one node
                break
            all_shared = np.bitwise_and.reduceat(shared, runs)
            same = np.bitwise_and.reduceat(values, runs) | ~np.bitwise_or.reduceat(values, runs)
            shared, group = all_shared & same, group[runs]
            values = values[runs] & shared
            self.levels.append((shared, values, np.append(runs, n)))
        self.top_group = group
        above = [np.repeat(upper, np.diff(children)) for upper, _, children in self.levels]  # of each level's children
        self.leaf_bits = ~above[0]
        self.levels = [(s & ~above[k + 1] if k + 1 < len(above) else s, v, c) for k, (s, v, c) in enumerate(self.levels)]

    def pairs(self, codes: np.ndarray, query: np.ndarray, top: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) at up to distance, of the queries and the top nodes paired with them."""
        node, differ = top, np.zeros(len(top), np.uint8)
        for shared, values, children in reversed(self.levels):
            differ = differ + np.bitwise_count((codes[query] ^ values[node]) & shared[node])
            near = differ <= distance
            query, node, differ = query[near], node[near], differ[near]
            counts = children[node + 1] - children[node]
            offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            query, node, differ = np.repeat(query, counts), np.repeat(children[node], counts) + offsets, np.repeat(differ, counts)
        near = (node < query) & (differ + np.bitwise_count((codes[query] ^ codes[node]) & self.leaf_bits[node]) <= distance)
        return query[near], node[near]


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs (a, b) in a table of roots (each the smallest place of its set)."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def group_forest(group: np.ndarray, codes: np.ndarray, distance: int, wide: np.ndarray | None = None, wide_distance: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for members linked to another of their group; rows may come in any order of codes.

    wide: further words of the fingerprints, a row each; linked are then only pairs that differ in up to
    wide_distance bits of all words. At such distances nodes prune little, so fewer queries go at once.
    """
    order = np.lexsort((gray_rank(codes), group))
    group, sorted_ = group[order], codes[order]
    index = GrayIndex(group, sorted_)
    lo = np.searchsorted(index.top_group, group, "left")
    tops = np.searchsorted(index.top_group, group, "right") - lo
    if wide is None:
        root, work, at, most = np.arange(len(codes)), np.cumsum(tops), 0, FRONTIER // 64
    else:
        wide = wide[order]
        sizes = np.searchsorted(group, group, "right") - np.searchsorted(group, group, "left")
        root, work, at, most = np.arange(len(codes)), np.cumsum(sizes), 0, PAIRS_AT_ONCE
    while at < len(codes):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + most, "right")))
        query = np.repeat(np.arange(at, end), tops[at:end])
        offset = np.arange(len(query)) - np.repeat(np.cumsum(tops[at:end]) - tops[at:end], tops[at:end])
        a, b = index.pairs(sorted_, query, np.repeat(lo[at:end], tops[at:end]) + offset, distance)
        if wide is not None:
            differ = np.bitwise_count(sorted_[a] ^ sorted_[b]).astype(np.int64)
            for word in wide.T:
                differ += np.bitwise_count(word[a] ^ word[b])
            a, b = a[differ <= wide_distance], b[differ <= wide_distance]
        root = join_roots(root, a, b)
        at = end
    linked = np.flatnonzero(root != np.arange(len(codes)))
    return order[linked], order[root[linked]]


def key_masks(distance: int, rows: int) -> list[int]:
    """The bits of each key of an index of so many fingerprints; two at up to `distance` bits share some key."""
    wanted, c = math.log2(max(1, rows / GROUP_ROWS)), 1
    while 64 * c // (distance + c) < wanted and distance + c < 32:
        c += 1
    edges = [64 * k // (distance + c) for k in range(distance + c + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, c)]


def links(classes: DataFrame, distance: int = DISTANCE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) of ids that span the links of classes(fingerprint, id), one row a fingerprint."""
    signed = [m - (1 << 64) if m >> 63 else m for m in key_masks(distance, classes.count())]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)))
    dealt = tiled(classes.select("fingerprint", "id", F.explode(keys).alias("block")), "block", "fingerprint", tile_rows)

    def search(rows: np.ndarray) -> pa.RecordBatch:
        a, b = group_forest(rows[:, 0], np.ascontiguousarray(rows[:, 2]).view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 1]), pa.array(rows[b, 1])], ["a", "b"])

    return _search_groups(dealt, ["id", "fingerprint"], search, "a long, b long", BUFFER_ROWS)


def _search_groups(dealt: DataFrame, columns: list[str], search, schema: str, buffer_rows: int) -> DataFrame:
    """What search gives for the rows (group, columns ...), all longs, of whole groups of tiled rows."""
    dealt = dealt.select(F.xxhash64("block", "tile_a", "tile_b").alias("grp"), *columns)
    dealt = dealt.repartition("grp").sortWithinPartitions("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([column.to_numpy() for column in batch.columns], axis=1))
            if sum(map(len, held)) >= buffer_rows:
                rows = np.concatenate(held)
                last = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))  # the last group may go on
                if last:
                    yield search(rows[:last])
                held = [rows[last:]]
        if held and len(rows := np.concatenate(held)):
            yield search(rows)

    return dealt.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of docs(doc_id, text).

    Documents link at up to `distance` differing bits; component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows keep their rows. A null
    doc_id gets its text's component. Other columns are ignored.
    """
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "fingerprints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "fingerprint-classes")
    member = components(links(classes.where("id is not null"), distance))
    named = classes.join(member, classes.id == member.node, "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicate component, with their columns.

    Rows that repeat that doc_id stay together; rows without doc_id stay.
    """
    found = near_duplicates(docs, shingle, distance)
    kept = found.where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*docs.columns)


def wide_print(hashes: np.ndarray) -> list[int]:
    """The words of an extended SimHash as signed longs: majority bits of the hashes, then of mixtures of them."""
    out = []
    for k in range(PRINT_WORDS):
        out.append(majority_bits(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(k)
        hashes ^= hashes >> np.uint64(33)
    return np.array(out, np.uint64).view(np.int64).tolist()


def random_keys(rows: int) -> list[list[int]]:
    """Masks over the words of a fingerprint, one list for each key of an index of so many fingerprints.

    A key has as many bits as make groups of WIDE_GROUP_ROWS of random fingerprints; there are as many keys as
    leave a pair that differs in PAIR_SHARE of its bits without a common key with a chance of MISS.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / WIDE_GROUP_ROWS)))
    number = math.ceil(math.log(MISS) / math.log(1 - (1 - PAIR_SHARE) ** bits)) if bits else 1
    rng, out = np.random.default_rng(SEED), []
    for _ in range(number):
        chosen = rng.choice(64 * PRINT_WORDS, bits, replace=False).tolist()
        masks = [sum(1 << (b % 64) for b in chosen if b // 64 == word) for word in range(PRINT_WORDS)]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def set_mark(shingles: np.ndarray) -> int:
    """A signed 64-bit hash that stands for a sorted set of shingle hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def similar_roots(sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    """Root of each set's component by links of pairs at jaccard or more; pairs already joined are not compared."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order.tolist()])
    prints = np.array([majority_bits(sets[k]) for k in order.tolist()], np.uint64)
    names, flat = np.unique(np.concatenate([sets[k] for k in order.tolist()]), return_inverse=True)
    edges = np.append(0, np.cumsum(sizes))
    root, inside = np.arange(len(sets)), np.zeros(len(names), bool)
    for i in range(len(sets)):
        end = int(np.searchsorted(sizes, sizes[i] / jaccard * (1 + 1e-9), "right"))
        near = (root[i + 1 : end] != root[i]) & (np.bitwise_count(prints[i + 1 : end] ^ prints[i]) <= MOST_BITS)
        js = np.flatnonzero(near) + i + 1
        if not len(js):
            continue
        own = flat[edges[i] : edges[i + 1]]
        inside[own] = True
        starts = np.append(0, np.cumsum(sizes[js]))
        places = np.arange(starts[-1]) + np.repeat(edges[js] - starts[:-1], sizes[js])
        hits = np.append(0, np.cumsum(inside[flat[places]]))
        inside[own] = False
        shared = hits[starts[1:]] - hits[starts[:-1]]
        linked = js[shared * (1 + jaccard) >= jaccard * (sizes[i] + sizes[js]) - 1e-6]
        if len(linked):
            root[np.isin(root, root[linked])] = root[i]
    out = np.empty(len(sets), np.int64)
    out[order] = order[root]
    return out


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, n, print) of docs(doc_id, text): what stands for a text's set of shingles, its size and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [np.unique(shingle_hashes(t or b"", shingle)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                columns = [pa.array([set_mark(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
                prints = pa.array([wide_print(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, prints], ["doc_id", "mark", "n", "print"])

    return docs.mapInArrow(run, "doc_id long, mark long, n long, print array<long>")


def candidate_groups(classes: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(centre, mark): the components of close fingerprints within each group of the index over classes(mark, print).

    Two close fingerprints that share a key have a centre, the component's least mark, in common.
    """
    words = [f"_p{k}" for k in range(PRINT_WORDS)]
    prints = classes.select("mark", *[F.col("print")[k].alias(w) for k, w in enumerate(words)])
    masks = random_keys(classes.count())
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(words, mask, strict=True)]) for k, mask in enumerate(masks)])
    dealt = tiled(prints.select("mark", *words, F.explode(keys).alias("block")), "block", "mark", tile_rows)

    def search(rows: np.ndarray) -> pa.RecordBatch:
        prints = np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
        member, root = group_forest(rows[:, 0], np.ascontiguousarray(prints[:, 0]), MOST_BITS, prints[:, 1:], MOST_WIDE_BITS)
        centre = rows[:, 1].copy()
        np.minimum.at(centre, root, rows[member, 1])
        tops = np.unique(root)
        centres, marks = np.concatenate([centre[root], centre[tops]]), np.concatenate([rows[member, 1], rows[tops, 1]])
        return pa.RecordBatch.from_arrays([pa.array(centres), pa.array(marks)], ["centre", "mark"])

    return _search_groups(dealt, ["mark", *words], search, "centre long, mark long", BUFFER_ROWS // 4).distinct()


def similar_links(classes: DataFrame, docs: DataFrame, shingle: int, jaccard: float, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Edges (a, b) of marks that span the links of classes(mark, id, n, print); texts are read from docs(doc_id, text).

    Groups of candidates above tile_shingles are compared tile by tile, none is cut.
    """
    groups = written(candidate_groups(classes), "similar-groups")
    dealt = tiled(groups.join(classes.drop("print"), "mark"), "centre", "mark", tile_shingles, "n")
    dealt = dealt.select(F.xxhash64("centre", "tile_a", "tile_b").alias("grp"), "mark", "id")
    dealt = dealt.join(docs.where("doc_id is not null"), F.col("id") == F.col("doc_id")).select("grp", "mark", "text")
    dealt = dealt.repartition("grp").sortWithinPartitions("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        now = None

        def flush() -> pa.RecordBatch:
            marks = np.fromiter(held, np.int64, len(held))
            root = similar_roots(list(held.values()), jaccard)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(marks[moved]), pa.array(marks[root[moved]])], ["a", "b"])

        for batch in batches:
            for group, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                if group != now and held:
                    yield flush()
                    held.clear()
                now = group
                found = np.unique(shingle_hashes(text.as_py() or b"", shingle))
                if set_mark(found) == mark:  # not another text of a repeated doc_id
                    held[mark] = found
        if held:
            yield flush()

    return dealt.mapInArrow(run, "a long, b long")


def keep_first_similar(docs: DataFrame, shingle: int = STAGE_SHINGLE, jaccard: float = JACCARD, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component by Jaccard of word shingles, with their columns.

    Documents link where the sets of their shingles have a Jaccard of `jaccard` or more; texts without words
    link with each other. Rows that repeat a kept doc_id stay together; rows without doc_id stay.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = written(_profiles(texts, shingle), "similar-profiles")
    classes = profiles.where("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("print").alias("print"))
    classes = written(classes, "similar-classes")
    member = components(similar_links(classes, texts, shingle, jaccard, tile_shingles))
    named = classes.join(member, classes.mark == member.node, "left").select("id", F.coalesce("component", "mark").alias("component"))
    first = named.groupBy("component").agg(F.min("id").alias("_kept"))
    kept = first.select("_kept").union(docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("_kept"))).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi").select(*docs.columns)
