"""Operator 7: token ids in binary files, one zstandard frame per document, one shared dictionary.

Layout of a token store (a folder that Spark writes and reads, on any file system Spark knows):

* ``dictionary/``  one row: dict_hash (SHA-256 of the dictionary), dict_bytes, id_bytes (2 or 4).
* ``blocks/``      rows of about block_bytes: shard, block, ahead (ids of earlier blocks of the shard), first_doc,
  last_doc, n_docs, n_null (of which the first have no doc_id), n_ids, dict_hash, doc_ids (int64
  little-endian), counts (uint32 ids of each document), offsets (int64, n_docs + 1 places in payload) and
  payload, the documents' frames one after another. A frame holds one document's ids as little-endian
  unsigned integers of id_bytes.
* ``shards/``      rows (shard, start): ids of all documents in earlier shards.

Documents stand in ascending doc_id order over blocks and shards. A reader of one short document needs its
block's index and one frame.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

BLOCK_BYTES = 1 << 20
#: Bounds of the dictionary's training sample and of the dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 2000, 16 << 20, 64 << 10
#: Entries of a worker's table from a chunk of text to its ids, beyond which it becomes the older one of two.
CHUNK_ENTRIES = 300_000

BLOCK_SCHEMA = (
    "shard int, block int, ahead long, first_doc long, last_doc long, n_docs int, n_null int, n_ids long, dict_hash string, "
    "doc_ids binary, counts binary, offsets binary, payload binary"
)

#: Characters that end a chunk and that the pre-tokenizer keeps apart from letters.
PLAIN_ENDS = b".,;:!?#$%&*|()[]-"
#: First bytes of U+0300 to U+037F, combining marks above all.
COMBINING = (b"\xcc", b"\xcd")
#: The normaliser and the pre-tokenizer under which texts are encoded chunk by chunk.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def token_shape(tokenizer_json: str) -> tuple[bool, list[bytes]]:
    """Whether texts can be encoded chunk by chunk, and the added tokens, of a tokenizer."""
    shape = json.loads(tokenizer_json)
    by_chunk = shape.get("normalizer") == WORD_NORMALIZER and shape.get("pre_tokenizer") == WORD_SPLIT and not shape.get("post_processor")
    return by_chunk, [t["content"].encode() for t in shape.get("added_tokens") or ()]


class ChunkEncoder(dict):
    """Ids of whole texts through the tokenizers library; as a dict, from the chunks between white space to their ids.

    White space is dropped by this tokenizer's pattern and no normaliser looks across it, so a text's ids
    are those of its chunks in order, each tokenized when first met. Letters of Latin-1 followed by plain
    punctuation are two pre-tokens; their lower-cased letters go to the model directly. A tokenizer with
    another normaliser or pre-tokenizer encodes texts as they are.
    """

    def __init__(self, tokenizer_json: str, end_id: int, shape: tuple[bool, list[bytes]] | None = None):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.id_type, self.code = (np.dtype("<u2"), "H") if self.tokenizer.get_vocab_size() <= 65536 else (np.dtype("<u4"), "I")
        self.end = self.id_type.type(end_id).tobytes()
        self.by_chunk, self.marks = shape or token_shape(tokenizer_json)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is not None:
            self[chunk] = ids
            return ids
        core = chunk.rstrip(PLAIN_ENDS)
        if core.isalpha():
            if len(core) < len(chunk):
                ids = self[chunk] = self[core] + self[chunk[len(core) :]]
                return ids
            word = core.lower().decode()
        elif (text := core.decode()).isalpha() and max(text) < "\u0100":
            if len(core) < len(chunk):
                ids = self[chunk] = self[core] + self[chunk[len(core) :]]
                return ids
            word = text.lower().encode().decode("latin-1").translate(self.byte_chars)
        else:
            ids = self[chunk] = array(self.code, self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
            return ids
        ids = self[chunk] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
        return ids

    def texts(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The serialized ids of each text, the end id last."""
        get, end = self.__getitem__, self.end
        if not self.by_chunk:
            for e in self.tokenizer.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False):
                yield array(self.code, e.ids).tobytes() + end
            return
        for text in texts:
            if len(self) > CHUNK_ENTRIES:
                self.older = dict(self)
                self.clear()
            text = text or b""
            low = text.lower()
            # added tokens are matched as they stand; some letters compose with a mark only once they are lower case
            as_is = any(m in low for m in self.marks) or any(m in low for m in COMBINING)
            yield b"".join(map(get, (text if as_is else low).split())) + end


_worker_encoders: dict[tuple[int, int], ChunkEncoder] = {}


def worker_encoder(key: tuple[int, int], vocabulary) -> ChunkEncoder:
    """The encoder of this Python worker for a broadcast vocabulary; later tasks find its tables filled."""
    if key not in _worker_encoders:
        _worker_encoders.clear()
        _worker_encoders[key] = ChunkEncoder(vocabulary.value[0], key[1], vocabulary.value[1])
    return _worker_encoders[key]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _spark_encoder(spark: SparkSession, tokenizer_json: str, end_id: int):
    """A broadcast of the vocabulary (a file of fixed size) and a function that gives a worker's encoder."""
    vocabulary = spark.sparkContext.broadcast((tokenizer_json, token_shape(tokenizer_json)))

    key = (zlib.crc32(tokenizer_json.encode()), end_id)
    return lambda: worker_encoder(key, vocabulary)


def train_dictionary(docs: DataFrame, encoder, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A zstandard dictionary from the serialized id arrays of a bounded sample of documents.

    The sample is the sample_docs documents of smallest hash of doc_id, of which arrays are taken until
    SAMPLE_BYTES. Too few to train on: their bytes, cut to DICT_BYTES, are the dictionary; none: empty.
    """
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x for x in enc.texts(texts)], pa.binary())], ["ids"])

    arrays, total = [], 0
    rows = sample.select("text").mapInArrow(serialize, "ids binary").where(F.length("ids") <= SAMPLE_BYTES // 16)
    for row in rows.toLocalIterator():
        total += len(row.ids)
        if total > SAMPLE_BYTES:
            break
        arrays.append(bytes(row.ids))
    if not arrays:
        return b""
    arrays.sort()
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:DICT_BYTES]


def write_token_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int) -> None:
    """Encode docs(doc_id, text) and write a token store at path.

    A null or empty text gives the end id alone. Rows with equal doc_id are kept, each with its own frame;
    a null doc_id sorts first. Other columns are ignored. An empty table gives a store without blocks.
    The texts are dealt once, by ranges of doc_id, before they are encoded.
    """
    spark = docs.sparkSession
    encoder = _spark_encoder(spark, tokenizer_json, end_id)
    dictionary = train_dictionary(docs, encoder)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast(dictionary)
    id_bytes = ChunkEncoder(tokenizer_json, end_id).id_type.itemsize

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, zip_, shard, block = encoder(), _compressor(shared.value), TaskContext.get().partitionId(), 0
        docs_, counts, frames, held, ahead = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)]).astype("<i8")
            known = [d for d in docs_ if d is not None]
            row = {
                "shard": shard, "block": block, "ahead": ahead, "first_doc": min(known, default=None), "last_doc": max(known, default=None),
                "n_docs": len(docs_), "n_null": len(docs_) - len(known), "n_ids": sum(counts), "dict_hash": dict_hash,
                "doc_ids": np.array([d or 0 for d in docs_], "<i8").tobytes(),
                "counts": np.array(counts, "<u4").tobytes(), "offsets": offsets.tobytes(), "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=ARROW_BLOCK)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, raw in zip(part.column(0).to_pylist(), enc.texts(part.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    docs_.append(doc)
                    counts.append(len(raw) // id_bytes)
                    frames.append(zip_.compress(raw))
                    held += len(frames[-1])
                    if held >= BLOCK_BYTES:
                        yield flush()
                        ahead += sum(counts)
                        docs_, counts, frames, held, block = [], [], [], 0, block + 1
        if docs_:
            yield flush()

    spark.createDataFrame([(dict_hash, dictionary, id_bytes)], "dict_hash string, dict_bytes binary, id_bytes int").write.parquet(f"{path}/dictionary")
    tie = F.xxhash64("text").alias("_tie")  # so that rows of one doc_id can be dealt to several ranges
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    dealt.select("doc_id", "text").mapInArrow(pack, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/shards")


ARROW_BLOCK = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("ahead", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("n_null", pa.int32()), ("n_ids", pa.int64()),
     ("dict_hash", pa.string()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("offsets", pa.binary()), ("payload", pa.binary())]
)


def read_token_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of a token store; ids are uint32 little-endian bytes.

    doc_ids: only these documents; their blocks are found by first_doc and last_doc, and only their frames
    are decompressed. A block whose dictionary hash is not the store's raises ValueError.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(head.dict_bytes)).hexdigest() != head.dict_hash:
        raise ValueError("the store's dictionary does not match its hash")
    shared, dict_hash, id_type = spark.sparkContext.broadcast(bytes(head.dict_bytes)), head.dict_hash, np.dtype(f"<u{head.id_bytes}")
    wanted = None if doc_ids is None else set(doc_ids)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, start long").parquet(f"{path}/shards")  # a row for each task that wrote
    if wanted is not None:
        blocks = blocks.where(F.exists(F.lit(sorted(wanted)), lambda d: (d >= F.col("first_doc")) & (d <= F.col("last_doc"))))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = _decompressor(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != dict_hash:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: another dictionary's frames")
                docs = np.frombuffer(row["doc_ids"], "<i8")
                counts, offsets = np.frombuffer(row["counts"], "<u4").astype(np.int64), np.frombuffer(row["offsets"], "<i8")
                starts = row["start"] + row["ahead"] + np.cumsum(counts) - counts
                out = []
                for k, doc in enumerate(docs.tolist()):
                    doc = None if k < row["n_null"] else doc
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(unzip.decompress(row["payload"][offsets[k] : offsets[k + 1]]), id_type)
                        if len(ids) != counts[k]:
                            raise ValueError(f"document {doc}: {len(ids)} ids, the index has {counts[k]}")
                        out.append((doc, int(starts[k]), len(ids), ids.astype("<u4").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(F.broadcast(shards), "shard").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def token_output(docs: DataFrame, tokenizer_json: str, end_id: int = 1) -> DataFrame:
    """Write docs to a token store in the shared folder and read it back: (doc_id, start, n_tokens, ids)."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_token_store(docs, path, tokenizer_json, end_id)
    return read_token_store(docs.sparkSession, path)
