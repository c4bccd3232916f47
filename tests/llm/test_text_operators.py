"""Operators 1, 2, 3, 5, 7 and 8 against brute force on small tables with nulls, empty texts, copies and extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sigmaloom.llm")
import public_tokenizers  # noqa: E402
import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sigmaloom.llm import byte_bpe, common, decontam, langid, simhash, suffix_dedup, token_output  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fingerprint string, spans int, _n_words int, score string, kept int"


def _documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["tha", "er", "ing", "é", "on", "ß", "de", "漢"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ".", ","]) for _ in range(n))
    shared, base = prose(60), prose(120)
    texts = [prose(rng.randint(1, 150)) for _ in range(40)]
    texts += [prose(20) + " " + shared + " " + prose(30), shared, prose(5) + shared[3:250] + prose(9), "x" + shared + "y"]
    texts += [base, base, base + " end", base.replace("er", "xx", 1), base[:150]]
    texts += [None, None, "", " ", "a", "A", "12 34", "ab" * 400, "z" * 1000, "\n\t \x0b", "don't  STOP   it's 3½ ｘ", "<|endoftext|> \x00 𝕏"]
    return [(i, t, "en", None, None, "x", "y", 1, 2, "s", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_documents(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in _documents()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_byte_bpe_equals_tiktoken_and_decodes(docs, texts, empty):
    import tiktoken

    vocabulary = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(vocabulary), special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary).collect()
    assert len(out) == len(texts)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode() and r.n_tokens == len(r.ids) // 4
    assert byte_bpe.encode(empty, vocabulary, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_on_random_texts():
    import tiktoken

    vocabulary = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = byte_bpe.read_ranks(vocabulary)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, rng = byte_bpe.RankEncoder(ranks, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("a bé  \n\t 'sté,!.ſİΣς漢字́ 12³_½ª\x00\x1c 👍ñ--") for _ in range(rng.randint(0, 30)))
        assert encoder.text(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes()


def test_byte_bpe_cuts_only_where_a_match_begins():
    """A vocabulary with a piece of white space, which a cut at the wrong place would miss."""
    ranks = {bytes([b]): b for b in range(256)} | {b"\n ": 256}
    encoder = byte_bpe.RankEncoder(ranks, public_tokenizers.PATTERN)
    assert np.frombuffer(encoder.text("a\n \nb"), "<u4").tolist() == [97, 256, 10, 98]


def test_token_store_round_trip(docs, texts, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary, tokenizer = open(path).read(), Tokenizer.from_file(path)
    out = {r.doc_id: r for r in token_output.token_output(docs, vocabulary).collect()}
    start = 0
    for doc in sorted(texts):
        ids = tokenizer.encode(texts[doc], add_special_tokens=False).ids + [1]
        r = out[doc]
        assert (r.start, r.n_tokens) == (start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert token_output.token_output(empty, vocabulary).count() == 0
    store = f"file://{tmp_path}/store"
    token_output.write_token_store(docs.union(docs.where("doc_id = 3")), store, vocabulary, 1)
    few = token_output.read_token_store(spark, store, [3, 50]).collect()
    assert sorted(r.doc_id for r in few) == [3, 3, 50]
    assert len({zlib.crc32(bytes(r.ids)) for r in few if r.doc_id == 3}) == 1
    odd = [(None, "a b"), (-(2**63), "c"), (None, None), *[(7, f"copy {k}") for k in range(50)]]
    rows = token_output.token_output(spark.createDataFrame(odd, "doc_id long, text string"), vocabulary).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, -(2**63)] + [7] * 50
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_byte_bpe_decodes_in_the_pass_that_encodes(spark, docs):
    vocabulary = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    both = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded=True)
    apart = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    assert sorted(both.select(*apart.columns).collect()) == sorted(apart.collect())
    from sigmaloom.llm import queries

    plan = queries.op8_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1, "a second Python worker a core takes memory"


def test_chunk_encoder_equals_the_library_on_random_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(3)
    encoder = token_output.ChunkEncoder(open(path).read(), 1)
    pieces = ["a", "B", "É", "é", "İ", "Σ", "K", "'s", "'T", " ", ". ", "..", ",", "<|endoftext|>", "<|ENDOFTEXT|>", "\u0301", "\n", "\u00a0", "1", "漢", "ſ", "¿", "”", "-", "\x1c"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.texts([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, encoder.id_type).tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def test_chunk_encoder_composes_marks_before_it_lowers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), token_output.ChunkEncoder(open(path).read(), 1)
    texts = [c + m + "a, " + c + m for c in "jJhHtTwWyYeE" for m in "\u030c\u0331\u0308\u030a"]  # some compose as lower case alone
    for text, ids in zip(texts, encoder.texts([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, encoder.id_type).tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def test_chunk_encoder_takes_other_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, text = Tokenizer.from_file(path), "Two  spaces, Case and\nlines."
    (ids,) = token_output.ChunkEncoder(open(path).read(), 1).texts([text.encode()])
    assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def _words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("pass_bytes", [8 << 20, 200])
def test_decontamination(docs, texts, empty, spark, pass_bytes):
    picked = [texts[40][30:300], texts[44], "A", "12 34", texts[10].upper(), "", None, texts[44]]
    items = [(i, t) for i, t in enumerate(picked)] + [(None, texts[5]), (100, "no such words at all in any of these texts here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontam.contamination(docs, benchmark, pass_bytes=pass_bytes).collect()}
    tests = [(None if i is None else str(i), _words(t or "")) for i, t in items]  # words of an item without id count, it is not named
    for doc, text in texts.items():
        words = _words(text)
        hit, found = set(), set()
        for item, w in tests:
            m = min(10, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                for p in range(len(words) - m + 1):
                    if words[p : p + m] == w[k : k + m]:
                        hit |= set(range(p, p + m))
                        found |= {item} - {None}
        r = out[doc]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(words), len(hit), sorted(found), bool(hit))
        for match in r.matches:
            w = dict(tests)[match.item_id]
            assert words[match.doc_word : match.doc_word + match.n_words] == w[match.item_word : match.item_word + match.n_words]
    many = docs.sparkSession.createDataFrame([(1, "the " * 50 + "end")], "doc_id long, text string")
    single = docs.sparkSession.createDataFrame([("a", "the"), ("b", "the end")], "item_id string, text string")
    for every, n in ((False, 2), (True, 51)):
        (r,) = decontam.contamination(many, single, every=every).collect()
        assert (r.n_hit, r["items"], len(r.matches)) == (51, ["a", "b"], n)
    kept = decontam.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in texts if not out[d].contaminated}
    assert decontam.contamination(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, benchmark.limit(0)).collect())


def _brute_repeats(texts, match):
    data = {d: t.encode() for d, t in texts.items()}
    times = Counter(t[i : i + match] for t in data.values() for i in range(len(t) - match + 1))
    out = {}
    for d, t in data.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - match + 1):
            if times[t[i : i + match]] > 1:
                gone[i : i + match] = True
        out[d] = gone
    return data, out


def _patchwork():
    """Texts of passages of 150 to 400 letters, cut at random places and put between random letters."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(rng.randint(150, 400)) for _ in range(6)]
    out = {}
    for d in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = passages[min(rng.randrange(6), rng.randrange(6))]
            a = rng.choice([0, 0, rng.randint(0, 60)])
            parts += [noise(rng.choice([0, 1, 5, 90])), p[a : len(p) - rng.choice([0, 0, rng.randint(0, 60)])]]
        out[d] = "".join([*parts, noise(rng.choice([0, 30]))])
    return out


@pytest.mark.parametrize("case", ["few", "many"])
def test_suffix_dedup(spark, docs, texts, empty, case):
    if case == "many":
        texts = _patchwork()
        docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(4)
    data, gone = _brute_repeats(texts, 200)
    for r in suffix_dedup.remove_repeats(docs).collect():
        mask = gone[r.doc_id]
        assert bytes(r.kept) == np.frombuffer(data[r.doc_id], np.uint8)[~mask].tobytes()
        assert (r.n_bytes, r.n_removed) == (len(mask), int(mask.sum()))
        assert r.n_spans == int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_keeps_columns_and_whole_characters(docs, texts):
    cut = suffix_dedup.cut_texts(docs)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r.text for r in cut.collect()}
    data, gone = _brute_repeats(texts, 200)
    for doc, text in rows.items():
        if not gone[doc].any():
            assert (text or "") == texts[doc]
        else:
            assert len(text.encode()) >= (~gone[doc]).sum()
    assert all(gone[d].any() for d in texts if d not in rows)


def _fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_simhash(docs, texts, empty):
    prints = {d: _fingerprint(t) for d, t in texts.items()}
    want = _components(texts, [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in texts if want[d] == d}
    assert simhash.near_duplicates(empty).count() == 0


def _shingles(text, size=5):
    words = text.lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.mark.parametrize("tile_shingles", [1 << 21, 400])
def test_keep_first_similar_finds_pairs_from_a_jaccard_of_08(spark, tile_shingles):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for k in range(120):  # the second text of a pair lacks words at its end
        base = [rng.choice(words) for _ in range(204)]
        cut = round(200 * (1 - (0.7 + 0.05 * (k % 6))))
        texts += [" ".join(base), " ".join(base[: len(base) - cut])]
    base = [rng.choice(words) for _ in range(104)]
    texts += [" ".join(base + [f"end{k}"] * (k % 3)) + f" x{k}" for k in range(60)]  # a large group of near copies
    texts += ["", None, "two words", "Two  words", "two word", "say " * 400 + texts[0]]
    docs = spark.createDataFrame([(len(texts) - i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")], "doc_id long, text string, kept string").repartition(3)
    sets = {len(texts) - i: _shingles(t or "") for i, t in enumerate(texts)}
    linked = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    want = _components(sets, linked)
    wide = sum((_fingerprint(texts[-a]) ^ _fingerprint(texts[-b])).bit_count() > 4 for a, b in linked if max(a, b) > 66)
    assert wide > 40  # the distance of op5 is too tight for these
    profiles = simhash._profiles(docs.select("doc_id", "text"), 5).withColumn("one", F.lit(1))
    tiles = common.tiled(profiles, "one", "mark", tile_shingles, "n").agg(F.max("tile_b")).first()[0]
    assert (tiles > 20) == (tile_shingles == 400), "tiles follow the sum of shingles, not the rows"
    kept = simhash.keep_first_similar(docs, tile_shingles=tile_shingles)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {d for d in sets if want[d] == d}
    assert simhash.keep_first_similar(docs.limit(0)).count() == 0


def test_candidates_come_from_the_gray_index_and_pairs_at_08_are_among_them(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_GROUP_ROWS", 8)
    rng, sets = random.Random(6), []
    for _ in range(1200):  # of 200 hashes a set, 178 in common: a Jaccard of 0.80
        a = [rng.getrandbits(64) for _ in range(222)]
        sets += [a[:200], a[22:]]
    prints = [simhash.wide_print(np.array(x, np.uint64)) for x in sets]
    assert prints[0][0] % (1 << 64) == simhash.majority_bits(np.array(sets[0], np.uint64)), "the first word is the SimHash"
    assert len(simhash.random_keys(len(sets))) > 20
    classes = spark.createDataFrame([(k, p) for k, p in enumerate(prints)], "mark long, print array<long>").repartition(3)
    for tile_rows in (4096, 5):
        found = simhash.candidate_groups(classes, tile_rows).collect()
        centres = {}
        for r in found:
            centres.setdefault(r.mark, set()).add(r.centre)
        met = sum(bool(centres.get(k, set()) & centres.get(k + 1, set())) for k in range(0, len(sets), 2))
        assert met >= 0.99 * 1200 and all(r.centre // 2 == r.mark // 2 for r in found), (met, len(found))


def test_pipeline_drops_near_copies_at_08(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(304)]
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(base[:250]), "en", "s", 1), (3, " ".join(base[:220]) + " other", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).collect()] == [1]


def test_gray_index_keys_meet_all_pairs_at_any_size():
    rng = random.Random(2)
    for rows in (10, 10**6, 10**9, 10**12):
        masks = simhash.key_masks(4, rows)
        assert min(m.bit_count() for m in masks) >= min(math.log2(rows / 256), 30) - 5
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any((a ^ b) & m == 0 for m in masks)


@pytest.mark.parametrize("n,groups", [(1500, 30), (2500, 3), (200, 1)])
def test_gray_index_finds_all_links(n, groups):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = codes[rng.integers(0, n, n // 2)].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64)
    codes[: n // 2] = near
    group = rng.integers(0, groups, n)
    root = simhash.join_roots(np.arange(n), *simhash.group_forest(group, codes, 4))
    a, b = np.nonzero((np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4) & (group[:, None] == group[None, :]))
    assert (root == simhash.join_roots(np.arange(n), a, b)).all()


def test_simhash_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(300)})
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    from sigmaloom.llm.common import components

    classes = spark.createDataFrame(signed, "fingerprint long, id long")
    got = {r.node: r.component for r in components(simhash.links(classes, 4, tile_rows=16)).collect()}
    want = _components(range(len(prints)), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert all(got.get(i, i) == want[i] for i in range(len(prints)))


def test_language_id(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(table)
    got = langid.identify(table, model, ["doc_id", "lang"]).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    for doc, text in {r[0]: r[1] for r in _documents()}.items():
        assert (again[doc] == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}


def test_language_id_never_reads_labels_of_held_out_rows(spark):
    rows = [(i, "the words of this " * 3, "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "xx", "s", 1) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.lang_pred for r in langid.identify(table, langid.fit(table)).collect()} == {"en"}




def test_language_sample_holds_every_language(spark):
    rows = [(4, "une langue que le monde parle et qui est belle", "fr")] * 1500
    rows += [(10 + i, f"these are the english words number {i}", "en") for i in range(50)] + [(100 + i, f"dies sind die deutschen worte nummer {i}", "de") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(table, langid.fit(table)).collect()}
    assert (4, "fr") in got and sum(lang == "en" for d, lang in got if 10 <= d < 60) > 45 and sum(lang == "de" for d, lang in got if d >= 100) > 45


def test_language_stage_uses_the_prediction_and_keeps_what_it_cannot_judge(spark, sf_dir):
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(6)
    other = lambda: " ".join("".join(rng.choice("бвгджзклмнпрстфхцчшщаеиоуыюя") for _ in range(rng.randint(2, 9))) for _ in range(200))
    foreign = spark.createDataFrame([(10**9 + i, other(), None, "x", 1) for i in range(20)], table.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, table.union(foreign), sf_dir).collect()}
    labelled = [r.doc_id for r in table.where(langid.held_out() & F.col("lang").isNotNull() & F.col("text").rlike("[a-z]")).collect()]
    assert len(labelled) > 100 and set(labelled) <= kept
    assert len(kept & {r.doc_id for r in table.collect()}) >= 0.99 * table.count() and sum(d >= 10**9 for d in kept) <= 12  # all 20 stayed before
    unlabelled = spark.createDataFrame([(1, "some words", None, "x", 1), (2, "漢字", None, "x", 1), (3, "12 !", None, "x", 1), (4, None, None, "x", 1)], table.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, unlabelled, sf_dir).collect()) == [1, 2]
