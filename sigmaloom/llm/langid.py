"""Operator 1: language identification in two steps, the family first and then the languages within it.

Features of a text are hashed byte trigrams of its letters (A-Z lower-cased, other ASCII as blanks), damped
by a square root and scaled to length 1. Families are told apart by one-versus-one linear support vector
machines, and so are the languages of each family. Machines are fitted on a bounded sample, a pair to a task, by
dual coordinate descent on the hinge loss.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Hashed features, and the expected number of sample texts of a language.
FEATURES, SAMPLE = 2048, 1000
UNKNOWN = "und"
#: Held-out rows from which on their scores tell what is too unsure to keep.
HELD_OUT_ROWS = 100
#: Families of common language codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur", "or", "as"),
    "semitic": ("ar", "he", "mt", "am"),
}
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), lang)


def features(text: bytes, size: int = FEATURES) -> np.ndarray:
    """Scaled counts of a text's hashed trigrams; zeros if it has none."""
    counts = np.zeros(size)
    for at in range(0, len(text), _CHUNK):
        data = _LOWER[np.frombuffer(text[max(0, at - 2) : at + _CHUNK], np.uint8)]
        data = np.where(_LETTER[data], data, 32).astype(np.uint32)
        if at + _CHUNK >= len(text):
            data = np.append(data, np.uint32(32))
        if at == 0:
            data = np.append(np.uint32(32), data)
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        codes = codes[(data[1:-1] != 32)]  # around a letter
        counts += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - size.bit_length() + 1), minlength=size)
    counts = np.sqrt(counts)
    norm = np.sqrt(counts @ counts)
    return counts / norm if norm else counts


def train_part(docs: DataFrame) -> DataFrame:
    """The rows to learn from: text and lang present, and crc32 of doc_id as text, modulo 4, not 2."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, per_language: int) -> tuple[list[str], DataFrame]:
    """(languages, sample of (lang, features)): of each language about per_language rows of smallest hash, repeated ones once."""
    place = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 40))
    rows = train_part(docs.select("doc_id", "text", "lang")).withColumn("place", place)
    sizes = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()}
    if not sizes:
        return [], rows
    # of a language at least the row of least hash
    bound = {lang: max(r.least, min(1 << 40, (1 << 40) * per_language // r.n)) for lang, r in sizes.items()}
    chosen = rows.where(F.col("place") <= F.create_map(*[F.lit(x) for pair in bound.items() for x in pair])[F.col("lang")])
    chosen = chosen.dropDuplicates(["lang", "place"]).select("lang", "text")  # repeated rows once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = [features(t.as_py()).astype("<f4").tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    return sorted(sizes), written(chosen.mapInArrow(run, "lang string, x binary"), "language-sample")


def support_vectors(x: np.ndarray, label: np.ndarray, rounds: int, penalty: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, of a linear machine with hinge loss for labels 1 and -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    most, norms = 1 / (penalty * len(x)), (x * x).sum(axis=1)
    weights, dual, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)).tolist():
            row, y = x[i], label[i]
            new = min(max(dual[i] - (y * (row @ weights) - 1) / norms[i], 0.0), most)
            if new != dual[i]:
                weights += (new - dual[i]) * y * row
                dual[i] = new
    return weights


def fit(docs: DataFrame, per_language: int = SAMPLE, rounds: int = 15) -> dict:
    """A model of the languages in docs(doc_id, text, lang): families, and a machine for each pair to decide.

    Learns from train_part(docs) alone. Languages are those of its rows; none: every text is unknown. Each
    language has a text in the sample at least.
    """
    languages, sample = _sample(docs, per_language)
    families: dict[str, list[str]] = defaultdict(list)
    for lang in languages:
        families[family_of(lang)].append(lang)
    model = {"families": dict(families), "machines": {}}
    sides = [(a, b, families[a], families[b]) for a, b in combinations(sorted(families), 2)]
    sides += [(a, b, [a], [b]) for members in families.values() for a, b in combinations(members, 2)]
    if not sides:
        return model
    spark = docs.sparkSession
    dealt = [(lang, a, b, label) for a, b, *both in sides for label, members in zip((1, -1), both, strict=True) for lang in members]
    pairs = spark.createDataFrame(dealt, "lang string, a string, b string, label int")  # a row for a language and a pair it takes part in

    def train(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("label", "ascending"), ("x", "ascending")])
        x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f4").reshape(rows.num_rows, -1).astype(np.float64)
        weights = support_vectors(x, rows["label"].to_numpy(), rounds)
        return pa.table({"a": [rows["a"][0].as_py()], "b": [rows["b"][0].as_py()], "weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})

    machines = sample.join(F.broadcast(pairs), "lang").groupBy("a", "b").applyInArrow(train, "a string, b string, weights array<double>")
    for m in machines.collect():
        model["machines"][m.a, m.b] = (np.array(m.weights[:-1]), m.weights[-1])
    return model


def _choose(x: np.ndarray, options: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """(option, confidence) of each row of x by votes of the pairs' machines; ties go to the larger margins."""
    votes, worst = np.zeros((len(x), len(options))), np.full((len(x), len(options)), np.inf)
    for a, b in combinations(range(len(options)), 2):
        weights, bias = machines[options[a], options[b]]
        margin = x @ weights + bias
        squashed = np.tanh(margin) / (2 * len(options))
        votes[:, a] += (margin >= 0) + squashed
        votes[:, b] += (margin < 0) - squashed
        worst[:, a], worst[:, b] = np.minimum(worst[:, a], margin), np.minimum(worst[:, b], -margin)
    best = votes.argmax(axis=1)
    margin = worst[np.arange(len(x)), best]
    return best, np.where(np.isinf(margin), 1.0, 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50))))


def predict(model: dict, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """(language, score from 0 to 1) of each text; (und, 0) for texts that are null or have no letter."""
    known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t.decode()))]
    out = [(UNKNOWN, 0.0)] * len(texts)
    if not known or not model["families"]:
        return out
    x = np.stack([features(texts[k]) for k in known])
    families = sorted(model["families"])
    family, sure = _choose(x, families, model["machines"])
    for f, name in enumerate(families):
        rows = np.flatnonzero(family == f)
        if len(rows):
            members = model["families"][name]
            lang, within = _choose(x[rows], members, model["machines"])
            for r, m, s in zip(rows.tolist(), lang.tolist(), (within * sure[rows]).tolist(), strict=True):
                out[known[r]] = (members[m], s)
    return out


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (default doc_id) with lang_pred and score, from the whole texts alone. No shuffle.

    Repeated rows stay; columns named lang_pred or score are replaced.
    """
    keep = [c for c in (keep or ["doc_id"]) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = predict(shared.value, part.column(part.num_columns - 1).cast(pa.binary()).to_pylist())
                columns = [pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def least_score(docs: DataFrame, model: dict) -> float:
    """The least score of the held-out rows of docs(doc_id, text, lang) that have a lang and a letter; 0 if these are few."""
    known = docs.where(held_out() & F.col("lang").isNotNull())
    seen = identify(known, model).where(F.col("lang_pred") != UNKNOWN).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    return float(seen.least) if seen.n >= HELD_OUT_ROWS else 0.0


def identified_only(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """The rows of docs whose text is in one of the languages learnt, with their columns.

    A text without a letter goes, and so does one whose score, of family and language together, is below that
    of every held-out row with a known language. Where there is nothing to learn from, texts with a letter stay.
    """
    model = fit(docs, per_language)
    if not model["families"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model, docs.columns)
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score(docs, model))
    return found.where(sure).select(*docs.columns)
