"""Operator 8: byte-level BPE through a sentencepiece model written directly from a rank vocabulary.

Each byte b stands as the character U+0100 + b, so a token is a string without white space. The model's
pieces are <unk> and the tokens in rank order, scored by the negative rank: sentencepiece then merges the
adjacent pair of lowest rank first, the leftmost of equals, as rank-based encoders do. Normalisation is the
identity. Ids are rank + 1 in the model and ranks outside it.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's table from a chunk of text to its ids, beyond which it starts anew.
CACHE_ENTRIES = 600_000
BYTE_CHARS = [chr(0x100 + b) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: bytes, float, or a varint for int and bool."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(int(value))


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialized sentencepiece BPE model of the vocabulary; ranks must be 0, 1, 2 and so on."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    unknown, normal, bpe = 2, 1, 2  # kinds of piece and of model in sentencepiece's format
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate({b: c for b, c in enumerate(BYTE_CHARS)}).encode()
        out.append(_field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(24, False) + _field(35, False)
    trainer += _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class RankEncoder:
    """Encodes texts by ranks; each match of the pattern separately, each distinct one once in a while."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model or sentencepiece_model(ranks))
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        rest = []
        for word in new:
            if (rank := self.ranks.get(word.encode())) is not None:  # a whole token stands for itself
                self.words[word] = struct.pack("<I", rank)
            else:
                rest.append(word)
        mapped = [w.encode().decode("latin-1").translate(MAPPED) for w in rest]
        for word, ids in zip(rest, self.processor.encode(mapped, num_threads=1), strict=True):
            self.words[word] = (np.array(ids, "<u4") - np.uint32(1)).tobytes()

    def text(self, text: str) -> bytes:
        """The ranks of a text as little-endian unsigned 32-bit integers.

        A single space between two characters that are no white space begins a match, so a text in which
        every space stands so is cut there first.
        """
        first, *rest = text.split(" ")
        chunks = [first, *[" " + c for c in rest]]
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        if any(not (bare := c.removeprefix(" ")) or bare[0].isspace() or bare[-1].isspace() for c in new):
            words = self.find(text)
            self._learn(words)
            out = b"".join(map(self.words.__getitem__, words))
        else:
            if new:
                found = [self.find(c) for c in new]
                self._learn([w for f in found for w in f])
                for chunk, words in zip(new, found, strict=True):
                    self.chunks[chunk] = b"".join(map(self.words.__getitem__, words))
            out = b"".join(map(self.chunks.__getitem__, chunks))
        if len(self.words) > CACHE_ENTRIES or len(self.chunks) > CACHE_ENTRIES:
            self.words.clear()
            self.chunks.clear()
        return out


MAPPED = {b: c for b, c in enumerate(BYTE_CHARS)}


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens): each text's ranks as little-endian unsigned 32-bit integers, no special tokens.

    decoded: also the column decoded, as decode gives it, from the ids while they are at hand.

    Null and empty texts have no ids. Repeated rows stay, other columns are ignored. No shuffle.
    vocabulary: the bytes of a rank file (of fixed size, so it is broadcast). pattern: a regular expression
    in which a space between two characters that are no white space begins a match.
    """
    ranks = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, sentencepiece_model(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, model = shared.value
        enc = RankEncoder(read_ranks(lines), pattern, model)
        tokens = sorted(enc.ranks, key=enc.ranks.__getitem__)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [enc.text(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
                if decoded:
                    columns.append(pa.array([_bytes_of(i, tokens) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long" + ", decoded binary" * decoded)


def _bytes_of(ids: bytes | None, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def decode(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """encoded(doc_id, ids, n_tokens) with the column decoded, the bytes that the ids stand for.

    Null ids give no bytes; an id outside the vocabulary raises IndexError.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shared.value)
        tokens = sorted(ranks, key=ranks.__getitem__)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [_bytes_of(i, tokens) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")
