"""Operators 11 to 13 against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("sigmaloom.llm")
from sigmaloom.llm import prefix_trie, quality_rules, resample, wordscan  # noqa: E402

WORDS = ["a", "Bc", "d9", "été", "x" * 63, "y" * 64, "z" * 300, "q", "rs"]


def _texts(n, seed):
    rng = random.Random(seed)
    return [None, "", "!!", "ONE", *(" ".join(rng.choice(WORDS) + rng.choice(["", ",", "\n"]) for _ in range(rng.choice([1, 3, 20, 60]))) for _ in range(n))]


def _features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_runs_of_words_have_their_crc_also_over_blocks(block, monkeypatch):
    monkeypatch.setattr(wordscan.word_blocks, "__defaults__", (block,))
    texts = ["", "left out", *_texts(30, 1), "w" * 5000 + " v"]
    column = pa.array(texts).slice(2)
    found = [[] for _ in column]
    words = np.zeros(len(column), int)
    for kind, rows, buckets in resample.features(column):
        if kind == "word":
            words += np.bincount(rows, minlength=len(column))
        else:
            for r, b in zip(rows.tolist(), buckets.tolist(), strict=True):
                found[r].append(b)
    for k, text in enumerate(texts[2:]):
        own, features = _features(text)
        assert words[k] == len(own) and sorted(found[k]) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features)


def _resampled(docs, target, percent):
    all_s, all_t = [0] * 10_000, [0] * 10_000
    for texts, counts in ((docs, all_s), (target, all_t)):
        for _, text in texts:
            for f in _features(text)[1]:
                counts[zlib.crc32(f.encode()) % 10_000] += 1
    s, t = float(sum(all_s)), float(sum(all_t))
    out = []
    for i, text in docs:
        words, features = _features(text)
        weight = sum(math.floor(1000 * math.log((all_t[b] + 1.0) * (s + 10_000) / ((all_s[b] + 1.0) * (t + 10_000)))) for b in (zlib.crc32(f.encode()) % 10_000 for f in features))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    drawn = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    k = percent * len(drawn) // 100
    ranks = [(x[:4], r + 1 if r < k else None) for r, x in enumerate(drawn)]
    return sorted([(*x, r) for x, r in ranks] + [(*x[:4], None) for x in out if not x[4]], key=repr)


@pytest.mark.parametrize("percent,sketch", [(5, 10_000), (50, 10), (100, 100), (0, 10)])
def test_resample_equals_brute_force(spark, percent, sketch):
    docs = [(k, t) for k, t in enumerate(_texts(200, 2))] + [(None, "a " * 30), (7, "a bc " * 20), (8, None)]
    target = [(0, "a bc a bc q"), (1, None)]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, weight string")
    got = resample.resample(frame, spark.createDataFrame(target, "item_id long, text string"), percent, keep=["score"], sketch=sketch)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.drop("n_words").collect()), key=repr) == _resampled(docs, target, percent)


def test_resample_of_equal_rows_empty_tables_and_missing_brackets(spark):
    schema = "doc_id long, text string"
    same = spark.createDataFrame([(1, "a b " * 15)] * 40, schema)
    none = spark.createDataFrame([], schema)
    got = resample.resample(same, none, 25).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 40
    assert resample.resample(none, same).count() == 0
    scores = spark.range(1000).selectExpr("cast(id * id as long) as score")
    for k in (1, 2, 500, 999, 1000):
        low, high, above = resample.bracket(scores, "score", 1000, k, 50)
        cut = (1000 - k) ** 2
        assert low <= cut <= high and above == sum(x * x > high for x in range(1000)) < k


def _trie(conversations):
    """Nodes of {conv_id: list of turns} by brute force."""
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^ \t-\r]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(conversations[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _conversations(seed, n):
    rng = random.Random(seed)
    made = {}
    for c in range(-3, n):
        turns = [("user" if k % 2 else None, rng.choice(["hi there", "", None, "a\tb  c", "é"])) for k in range(rng.choice([1, 2, 2, 3, 5, 9]))]
        made[c] = list(made[rng.choice(list(made))]) if made and rng.random() < 0.4 else turns
    made[n] = [("user", "x y")] * 40
    made[n + 1] = [("user", "x y")] * 39 + [("user", "z")]
    return made


@pytest.mark.parametrize("shard,block", [(2048, 512), (3, 4), (1, 2), (50, 7)])
def test_trie_equals_brute_force_in_any_shards_and_blocks(spark, shard, block):
    made = _conversations(3, 30)
    rows = [(c, k * 10 if k else None, r, t, "extra") for c, turns in made.items() for k, (r, t) in enumerate(turns)] + [(None, 1, "user", "none", "")]
    random.Random(1).shuffle(rows)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, depth string"), shard, block)
    assert sorted(map(tuple, got.collect()), key=repr) == _trie({c: [(r or "", t or "") for r, t in turns] for c, turns in made.items()})


def test_shared_heads_and_conversations_left_without_turns(spark):
    made = {c: [("u", f"t{c} {k}") for k in range(1 + c % 3)] for c in [*range(1, 45), 60, 61, 62, 63, 64]}
    rows = [(c, k, r, t) for c, turns in made.items() for k, (r, t) in enumerate(turns)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = prefix_trie.trie(prefix_trie.with_shared_heads(turns), turns.select("conv_id"), 4, 3)
    want = {}
    for c, own in made.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = made.get(c - c % 20, [])[:h] + own[h:]
    assert any(not w for w in want.values())
    assert sorted(map(tuple, got.collect()), key=repr) == _trie(want)


def test_tied_and_repeated_turns_have_one_order_and_an_empty_table_no_node(spark):
    rows = [(1, 5, r, t) for r in ("b", "a", None) for t in ("p", "q", None, "p")]
    seen = set()
    for parts in (1, 4, 16):
        frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(parts, "text")
        seen.add(tuple(sorted(map(tuple, prefix_trie.numbered_turns(frame).select("pos", "a", "b").collect()))))
    assert len(seen) == 1 and len(next(iter(seen))) == 12
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def _signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)]


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_signals_equal_brute_force(block, monkeypatch):
    monkeypatch.setattr(wordscan.word_blocks, "__defaults__", (block,))
    rng = random.Random(4)
    texts = [None, "", "\n\n", " \t", "a", "a\na\n\na", "é" * 3000, "a b c a b c d", "x y z"]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\x0b", "中"]) for _ in range(rng.choice([5, 40, 300]))) for _ in range(60)]
    found = quality_rules.text_signals(pa.array(["cut", *texts], pa.string()).slice(1))
    for k, text in enumerate(texts):
        assert [int(found[c][k]) for c in quality_rules.SIGNALS] == _signals(text), text


def _labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(3000):
        good, lang = rng.random() < 0.85, "en" if k < 2500 else None
        words = [rng.choice("abcdefghij") * 5 + str(rng.random()) for _ in range(60)]
        rows.append((k, " ".join(words) + ("" if good else " #" * rng.randrange(1, 60)), lang))
        labels.append((k, int(good)))
    rows += [(None, "w " * 70, "en"), (9000, None, "xx"), (9001, "", "xx"), (9002, " ".join(map(str, range(80))) + " #" * 50, "xx"), (5, rows[5][1], "en")]
    labels += [(10, 1 - labels[10][1]), (None, 1), (11, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_certified_cutoffs_keep_their_bound(spark):
    docs, labels = _labelled(spark)
    table = quality_rules.certified(quality_rules.signals(docs, keep=["doc_id", "lang"]), labels, ["lang"], risk=0.04).collect()
    assert {r["lang"] for r in table} == {"en", None}
    for r in table:
        n = r["n_good"]
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(r["good_out"] + 1))
        assert r["certified"] == (tail <= 0.05 / 8 and r["good_out"] < r["n_good"]), r
    chosen = {(r["lang"], r["rule"]): r for r in table if r["chosen"]}
    assert chosen["en", "symbols"]["good_out"] == 0 and chosen["en", "symbols"]["bad_out"] > 300
    assert not [c for c in chosen if c[0] is None], "425 good rows can't bear a bound of 1 percent"


def test_rules_reject_only_where_they_are_certified(spark):
    docs, labels = _labelled(spark)
    found = quality_rules.apply_rules(docs, labels, risk=0.04).collect()
    rows = {r["doc_id"]: r for r in found}
    assert len(found) == docs.count() and rows[9000]["base_failed"] and rows[9001]["base_failed"] and rows[None]["base_failed"]
    assert rows[9002]["kept"], "a language without labels loses nothing to the rules"
    assert not [r for r in found if r["lang"] is None and r["failed"]]
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()} - {10}
    en = [r for r in found if r["lang"] == "en" and r["doc_id"] is not None]
    assert sum(r["kept"] for r in en if r["doc_id"] not in bad) >= 0.96 * sum(r["doc_id"] not in bad for r in en)
    assert sum(not r["kept"] for r in en if r["doc_id"] in bad) > 0.8 * sum(r["doc_id"] in bad for r in en)
    empty = quality_rules.apply_rules(docs.limit(0), labels)
    assert empty.count() == 0 and quality_rules.apply_rules(docs.limit(5), labels.limit(0)).count() == 5
