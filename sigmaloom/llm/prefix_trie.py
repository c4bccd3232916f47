"""Operator 12: the prefix trie of conversations, from vertical bitmaps.

Conversations are cut into shards by rank of conv_id and their turns into blocks of positions. In each shard and
block an index goes from (position, turn) to the bitset of conversations that have the turn there; depth first, a
node's bitset meets the postings of the next position, which gives its children, their popcounts and the lists of
conversations that end. Nodes of different shards are one where the digests of their paths are equal: a path's
digest is the XOR of 128-bit hashes of its (position, turn) pairs, so a block needs only the digest before it.

What is summed over a subtree is had without walking it. Each node belongs to its smallest member; what a
conversation c owns is then the end of its path, from some depth on. Leaves below a node are its members that own
one. Of the words that are saved below it, each member but the smallest gives those from the node to where its own
part begins, so two numbers a conversation, summed over the members, are enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .resample import numbered

#: Conversations of a shard and positions of a block: a task's index has no more rows than their product.
SHARD, BLOCK = 2048, 512
NODE = "shard long, block long, low long, a long, b long, pa long, pb long, depth long, n long, conv_id long, before long, ends binary"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): the turns of every conversation, pos from 1, with 128 bits of digest and word counts.

    Turns are ordered by turn (null first), then by role and digest, so repeated and tied rows have one defined
    order whatever the partitions. A null role or text is an empty one. Rows without conv_id are in no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"),
        F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("words"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("a"), F.asc("b")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(dealt.select("conv_id", "a", "b", "words", F.monotonically_increasing_id().alias("_at")), "turns").withColumn("_part", F.shiftrightunsigned("_at", 33))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part that holds some of it
    parts = kept.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = parts.select("conv_id", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(starts, ["conv_id", "_part"]).select("conv_id", (F.col("_at") - F.col("_first") + F.col("_start") + 1).alias("pos"), "a", "b", "words")


def with_shared_heads(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """turns where each conversation c begins with the first h turns of c - c % every instead of its own first h.

    h is the CRC-32 of c in decimal modulo heads. What the other conversation lacks is not made up.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("_base"), h.alias("_h"))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "_base")
    taken = written(ids.join(first, "_base").where("pos <= _h").select(*turns.columns), "heads")
    n_taken = taken.groupBy("conv_id").agg(F.count("*").alias("_taken"))
    own = turns.withColumn("_h", h).where("pos > _h").join(n_taken, "conv_id", "left")
    return taken.unionByName(own.withColumn("pos", F.col("pos") - F.col("_h") + F.coalesce("_taken", F.lit(0))).select(*turns.columns))


def block_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard and block, in the order of the search; a row of depth -1 lists its conversations in that order.

    rows: a row a turn, and one of pos -1 a conversation with the digest and the words before the block; `more` tells
    there whether the conversation goes on behind it.
    """
    shard, block = int(rows["shard"].iloc[0]), int(rows["block"].iloc[0])
    conv, pos, a, b, words, more = (rows[c].to_numpy() for c in ("conv_id", "pos", "a", "b", "words", "more"))
    order = np.lexsort((pos, conv))
    conv, pos, a, b, words, more = (x[order] for x in (conv, pos, a, b, words, more))
    start = np.flatnonzero(pos == -1)
    ids, n = conv[start], len(start)
    size = np.diff(np.append(start, len(conv)))
    of = np.repeat(np.arange(n), size)
    level = np.arange(len(conv)) - start[of]
    goes_on = more[start].astype(bool)
    path_a, path_b, upto = np.empty_like(a), np.empty_like(b), np.empty_like(words)
    for s, m in zip(start.tolist(), size.tolist(), strict=True):
        path_a[s : s + m], path_b[s : s + m] = np.bitwise_xor.accumulate(a[s : s + m]), np.bitwise_xor.accumulate(b[s : s + m])
        upto[s : s + m] = np.cumsum(words[s : s + m])
    by_turn = np.lexsort((b, a, level))
    new = np.ones(len(conv), bool)
    new[1:] = (level[by_turn][1:] != level[by_turn][:-1]) | (a[by_turn][1:] != a[by_turn][:-1]) | (b[by_turn][1:] != b[by_turn][:-1])
    posting = np.empty(len(conv), np.int64)
    posting[by_turn] = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(conv))

    def bitset(members: np.ndarray) -> int:
        bits = np.zeros(n, bool)
        bits[members] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    postings = {k: bitset(of[by_turn[first[k] : first[k + 1]]]) for k in np.flatnonzero(np.diff(first) > 1).tolist()}
    longest = int(size.max())
    alive = [bitset(np.flatnonzero(size > k)) for k in range(longest + 1)]
    at, low, count, ends, done = [], [], [], {}, []

    def stop(c: int, row: int) -> None:
        done.append(c)
        if not goes_on[c]:
            ends.setdefault(row, []).append(int(ids[c]))

    def children(bits: int, k: int) -> Iterator[tuple[int, int]]:
        """The nodes of level k below one whose conversations that go on are `bits`."""
        while bits:
            c = (bits & -bits).bit_length() - 1
            here = postings.get(int(posting[start[c] + k]), 1 << c) & bits
            bits ^= here
            yield here, k

    stack = list(children(alive[0], 0))
    while stack:
        bits, k = stack.pop()
        c = (bits & -bits).bit_length() - 1
        row = int(start[c]) + k
        if bits == 1 << c:  # the rest of one conversation is a chain
            tail = np.arange(max(row, start[c] + (block > 0)), start[c] + size[c])
            at.append(tail)
            low.append(np.full(len(tail), len(done)))
            count.append(np.ones(len(tail), np.int64))
            stop(c, int(start[c] + size[c]) - 1)
            continue
        if k or not block:  # the nodes before a later block belong to the one before
            at.append([row])
            low.append([len(done)])
            count.append([bits.bit_count()])
        here = bits & ~alive[k + 1]
        while here:
            last = (here & -here).bit_length() - 1
            stop(last, row)
            here ^= 1 << last
        stack.extend(children(bits & alive[k + 1], k + 1))
    at, low, count = (np.concatenate([*map(np.asarray, x), np.zeros(0, np.int64)]).astype(np.int64) for x in (at, low, count))
    root = level[at] == 0
    above = np.where(root, at, at - 1)
    lists = [np.array(ends[r], "<i8").tobytes() if r in ends else None for r in at.tolist()]
    out = {"low": low, "a": path_a[at], "b": path_b[at], "pa": path_a[above], "pb": path_b[above], "depth": np.where(root, 0, pos[at]), "n": count, "conv_id": conv[at], "before": np.where(root, 0, upto[above]), "ends": lists}
    whole = {c: [0] for c in out} | {"depth": [-1], "ends": [ids[done].astype("<i8").tobytes()]}
    return pd.concat([pd.DataFrame(out), pd.DataFrame(whole)], ignore_index=True).assign(shard=shard, block=block)


def end_lists(nodes: DataFrame) -> DataFrame:
    """(a, b, n_ends, ends_sha256) of nodes at which conversations end; their ids are hashed as they stream by, shard by shard."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, sha, out = None, 0, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                if (a, b) != key:
                    if key:
                        out.append((*key, n, sha.hexdigest()))
                    key, n, sha = (a, b), 0, hashlib.sha256()
                found = np.frombuffer(ids, "<i8").tolist()
                sha.update((("," if n else "") + ",".join(map(str, found))).encode())
                n += len(found)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "n_ends", "ends_sha256"])
                out = []
        if key:
            out.append((*key, n, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "n_ends", "ends_sha256"])

    rows = nodes.where("depth >= 0 and ends is not null").select("a", "b", "ends", "shard")
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "shard").mapInArrow(digest, "a long, b long, n_ends long, ends_sha256 string")


def member_sums(nodes: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """For the nodes of one shard and block the sums of q and leaf over their members, and the q of the smallest."""
    listed = nodes["depth"].to_numpy() == -1
    ids = np.frombuffer(nodes["ends"].to_numpy()[listed][0], "<i8")
    known = own.sort_values("conv_id")
    place = np.searchsorted(known["conv_id"].to_numpy(), ids)
    sums = {c: np.concatenate([[0], np.cumsum(known[c].to_numpy()[place])]) for c in ("q", "leaf")}
    kept = nodes[~listed]
    low, high = kept["low"].to_numpy(), (kept["low"] + kept["n"]).to_numpy()
    least = known["q"].to_numpy()[np.searchsorted(known["conv_id"].to_numpy(), kept["conv_id"].to_numpy())]
    return pd.DataFrame({"a": kept["a"].to_numpy(), "b": kept["b"].to_numpy(), "conv_id": kept["conv_id"].to_numpy(), "least_q": least, "q": sums["q"][high] - sums["q"][low], "leaves": sums["leaf"][high] - sums["leaf"][low]})


def trie(turns: DataFrame, ids: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of turns(conv_id, pos, a, b, words) for all conversations in ids(conv_id), turnless ones too.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) a node. An empty table of
    ids has no node. No task holds more than shard * block turns, so neither a long conversation nor one turn that all
    conversations share gathers anywhere; the ids that end at one node are hashed in order, as a stream.
    """
    placed = written(numbered(ids.select("conv_id").distinct(), [F.asc("conv_id")], "rank").select("conv_id", F.floor((F.col("rank") - 1) / shard).alias("shard")), "shards")
    rows = turns.select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("a"), F.xxhash64("pos", "b", "a").alias("b"), "words", F.floor(F.col("pos") / block).alias("block"))
    rows = written(rows.join(placed, "conv_id"), "placed")
    parts = rows.groupBy("conv_id", "shard", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("words").alias("words"))
    none = placed.select("conv_id", "shard", *[F.lit(0).cast("long").alias(c) for c in ("block", "a", "b", "words")])  # every conversation has a first block
    parts = parts.unionByName(none).groupBy("conv_id", "shard", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("words").alias("words"))
    each = Window.partitionBy("conv_id").orderBy("block")  # a row a block
    upto = each.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    entries = written(
        parts.select(
            "conv_id", "shard", "block", F.lit(-1).cast("long").alias("pos"), *[F.coalesce(f(c).over(upto), zero).alias(c) for f, c in ((F.bit_xor, "a"), (F.bit_xor, "b"), (F.sum, "words"))],
            F.lead("block").over(each).isNotNull().alias("more"), F.sum("words").over(each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        ), "entries",
    )
    held = rows.withColumn("more", F.lit(False)).unionByName(entries.drop("total"))
    nodes = written(held.groupBy("shard", "block").applyInPandas(block_nodes, NODE), "nodes")
    merged = nodes.where("depth >= 0").groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("depth", "pa", "pb", "before")], F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    tree = written(merged.join(end_lists(nodes), ["a", "b"], "left"), "tree")
    owned = tree.groupBy("conv_id").agg(F.min_by("before", "depth").alias("q"), F.max((F.coalesce("n_ends", zero) == F.col("n_convs")).cast("long")).alias("leaf"))
    own = entries.join(owned, "conv_id", "left").select("shard", "block", "conv_id", F.coalesce("q", "total").alias("q"), F.coalesce("leaf", zero).alias("leaf"))
    sums = nodes.groupBy("shard", "block").cogroup(own.groupBy("shard", "block")).applyInPandas(member_sums, "a long, b long, conv_id long, least_q long, q long, leaves long")
    empty = F.lit(None)
    told = sums.select("a", "b", F.struct("conv_id", "least_q").alias("least"), "q", "leaves", zero.alias("children"))
    told = told.unionByName(tree.where("depth > 0").select(F.col("pa").alias("a"), F.col("pb").alias("b"), empty.cast(told.schema["least"].dataType).alias("least"), zero.alias("q"), zero.alias("leaves"), F.lit(1).cast("long").alias("children")))
    told = told.groupBy("a", "b").agg(F.min("least").alias("least"), F.sum("q").alias("q"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"))
    parents = tree.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("_parent"))
    saved = F.col("q") - F.col("least.least_q") - (F.col("n_convs") - 1) * F.col("before")
    return tree.join(told, ["a", "b"]).join(parents, ["pa", "pb"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("_parent")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text); what trie() returns."""
    turns = written(numbered_turns(conversations), "numbered")
    return trie(turns, turns.select("conv_id"), shard, block)
