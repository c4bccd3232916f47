"""Operator 6: near-duplicate embeddings through randomised-rotation binary codes.

A unit vector o is rotated by a fixed random rotation; its code is the signs of the result, and its
correction factor f is the inner product of o with the code's own unit vector c. For a unit vector q,
<c, q> / f is an unbiased estimate of <o, q>, within sqrt((1 - f^2) / f^2) * EPSILON / sqrt(dim - 1) of it
but for a small probability. Pairs whose upper bound reaches the threshold are recomputed in double
precision; only those found at or above it link.

Candidates are rows that agree on all bits of one of several random sets of further rotation bits. The
number of bits follows the number of vectors, so that a bucket holds about BUCKET_ROWS, and the number of
sets follows from the bits: a pair exactly at the threshold meets in some bucket with probability RECALL or
more. Buckets above TILE_ROWS are compared tile by tile, none is cut. A pair that meets in several buckets
counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, tiled, written
from .simhash import join_roots

THRESHOLD, EPSILON, RECALL = 0.9, 4.0, 0.99
BUCKET_ROWS, TILE_ROWS, SEED = 1024, 2048, 20240511


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of dim dimensions, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction factors) of unit vectors."""
    turned = unit @ turn.T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds) of the inner products of coded vectors (rows) with turned vectors (columns)."""
    dim = turned.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    bound = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * EPSILON / math.sqrt(max(1, dim - 1))
    return (signs @ turned.T.astype(np.float32)) / (math.sqrt(dim) * factor[:, None]), bound[:, None]


def table_shape(rows: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for a number of vectors."""
    bits = max(2, round(math.log2(max(4, rows / BUCKET_ROWS))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - same)))


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the batch's vectors, its last column, that can be scaled to length 1."""
    places, values = [], []
    for k, v in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
        if v is not None and len(v) and None not in v:
            places.append(k)
            values.append(v)
    if not places:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    raw = np.array(values, np.float64)
    good = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
    return np.array(places)[good], raw[good]


def scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1."""
    even = raw / np.abs(raw).max(axis=1, keepdims=True)
    return even / np.sqrt((even * even).sum(axis=1))[:, None]


def bucket_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    planes = np.random.default_rng(SEED + 1).standard_normal((tables * bits, unit.shape[1]))
    return ((unit @ planes.T >= 0).reshape(len(unit), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def coded(classes: DataFrame, dim: int, bits: int, tables: int) -> DataFrame:
    """(id, n, raw, code, factor, keys) of classes(id, n, embedding) of dim components.

    raw is the vector's bytes, as floats if the column holds floats, else as doubles; keys its bucket in each table.
    """
    kind = component_type(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for batch in batches:
            places, raw = _usable(batch)
            if not len(places):
                continue
            unit = scaled(raw)
            code, factor = codes(unit, turn)
            pick = batch.take(pa.array(places))
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (raw.astype(kind), code)]
            keys = pa.array(bucket_keys(unit, bits, tables).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pick.column(0), pick.column(1), *packed, pa.array(factor), keys], ["id", "n", "raw", "code", "factor", "keys"])

    rows = classes.where(F.size("embedding") == dim).select("id", "n", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "id long, n long, raw binary, code binary, factor double, keys array<long>")


def component_type(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


class _Bucket:
    """Rows of one bucket (or of two of its tiles) as arrays."""

    def __init__(self, rows: dict[str, list], turn: np.ndarray, kind: str, bits: int, tables: int):
        self.id, self.n, self.tile = (np.array(rows[c], np.int64) for c in ("id", "n", "tile"))
        self.unit = scaled(np.frombuffer(b"".join(rows["raw"]), kind).reshape(len(self.id), -1).astype(np.float64))
        self.code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(self.id), -1)
        self.factor, self.keys = np.array(rows["factor"]), bucket_keys(self.unit, bits, tables)
        self.turned = self.unit @ turn.T

    def links(self, table: int, two_tiles: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of the pairs of this bucket that link and have not met in an earlier table."""
        found = []
        for at in range(0, len(self.id), 512):
            block = slice(at, at + 512)
            value, bound = estimates(self.code[block], self.factor[block], self.turned)
            i, j = np.nonzero(value + bound >= threshold)
            i += at
            keep = self.tile[i] != self.tile[j] if two_tiles else np.ones(len(i), bool)
            keep &= i < j
            i, j = i[keep], j[keep]
            for part in range(0, len(i), 1 << 15):
                a, b = i[part : part + (1 << 15)], j[part : part + (1 << 15)]
                near = np.einsum("ij,ij->i", self.unit[a], self.unit[b]) >= threshold
                a, b = a[near], b[near]
                first = (self.keys[a, :table] != self.keys[b, :table]).all(axis=1)
                found.append((a[first], b[first]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def links(vectors: DataFrame, kind: str, dim: int, bits: int, tables: int, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, n_links, root) from coded vectors of components of a kind: counts of links, and in separate rows edges (id, root) that span them."""
    rows = vectors.select("id", "n", "raw", "code", "factor", F.posexplode("keys").alias("table", "key")).withColumn("bucket", F.col("table").cast("long") * (1 << 40) + F.col("key")).drop("key")
    dealt = tiled(rows, "bucket", "id", tile_rows).withColumn("grp", F.xxhash64("bucket", "tile_a", "tile_b"))
    names = ["grp", "table", "tile_a", "tile_b", "id", "n", "tile", "raw", "code", "factor"]
    dealt = dealt.select(*names).repartition("grp").sortWithinPartitions("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        held: dict[str, list] = {c: [] for c in names}

        def flush() -> pa.RecordBatch:
            bucket = _Bucket(held, turn, kind, bits, tables)
            i, j = bucket.links(held["table"][0], held["tile_a"][0] != held["tile_b"][0], threshold)
            counts = np.bincount(i, bucket.n[j], len(bucket.id)) + np.bincount(j, bucket.n[i], len(bucket.id))
            root = join_roots(np.arange(len(bucket.id)), i, j)
            some, moved = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
            for c in names:
                held[c].clear()
            ids = np.concatenate([bucket.id[some], bucket.id[moved]])
            roots = [*[None] * len(some), *bucket.id[root[moved]].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([*counts[some].astype(np.int64).tolist(), *[0] * len(moved)], pa.int64()), pa.array(roots, pa.int64())], ["id", "n_links", "root"])

        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(groups)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
                if held["grp"] and held["grp"][0] != groups[a]:
                    yield flush()
                for c, column in zip(names, batch.slice(a, b - a).columns, strict=True):
                    held[c] += column.to_pylist()
        if held["grp"]:
            yield flush()

    return dealt.mapInArrow(run, "id long, n_links long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of embeddings(vec_id, embedding).

    n_links counts the other rows of the same length found at a cosine of threshold or more, component_id is the smallest
    vec_id reachable by links, kept says whether it is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing; the lengths found are taken one after another. Exact
    copies are compared once and counted each. Other columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    dims = [int(r.dim) for r in sizes.orderBy("dim").collect()]
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not dims:
        return none
    plain = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce((F.size("embedding") > 0) & plain, F.lit(False)))
    keyed = rows.withColumn("mark", F.when(F.col("usable"), F.sha2(F.to_json(F.struct("embedding")), 256)))
    classes = keyed.where("usable and vec_id is not null").groupBy("mark").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = written(classes, "vector-classes")
    counted = {r.dim: r.n for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    parts = []
    for dim in dims:
        bits, tables = table_shape(counted.get(dim, 0), threshold)
        vectors = written(coded(classes, dim, bits, tables), "vector-codes")
        parts.append(written(links(vectors, component_type(classes), dim, bits, tables, threshold, tile_rows), "vector-links"))
    found = reduce(DataFrame.union, parts)
    counts = found.where("root is null").groupBy("id").agg(F.sum("n_links").alias("l"))
    member = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("mark", "id", "n").join(counts, "id", "left").join(member, F.col("id") == F.col("node"), "left")
    known = known.select("mark", (F.col("n") - 1 + F.coalesce("l", F.lit(0))).alias("l"), F.coalesce("component", "id").alias("c"))
    joined = keyed.select("vec_id", "mark").join(known, "mark", "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("l", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
