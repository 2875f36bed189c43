"""Embedding near-dedup (operator 4): rotated binary codes with correction factors decide which pairs are computed exactly.

Vectors of equal label and length are compared by cosine. Equal vectors of a label are one class, counted first.
1. Candidates: tables of sign bits of random projections. Two vectors at the threshold agree in a table of k bits with probability
   (1 - angle / pi)^k; there are as many tables as bring the chance to share none below MISS. k grows with the logarithm
   of the number of vectors, so that buckets stay small.
2. pair_units deals classes that share a bucket to units of bounded size; a unit compares a pair exactly once.
3. In a unit each unit vector o has, after a random rotation, the code x of its signs and the stored factor f = <x, o> / |x|.
   <x, q> / (|x| f) is an unbiased estimate of the cosine of o and q; its error is sqrt(1 - cos^2) sqrt(1 - f^2) / f times a
   variable of standard deviation 1 / sqrt(D - 1). A pair whose two estimates, one from either code, both lie within CONFIDENCE
   deviations of what a cosine at the threshold would give is computed again in double precision, and that alone decides.

Results that the cases have: a null label or vector, a vector without components, of length zero, or with a null or non-finite component links
with nothing and is its own component; vectors of different lengths do not link; repeated rows are linked as others; a null id has the
least id of its component, or null if there is none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, written
from .pair_units import compare, memberships, settled

THRESHOLD = 0.98
MISS = 1e-7
MOST_TABLES = 63
CONFIDENCE = 5.0
UNIT_ROWS = 512
UNIT_BYTES = 16 << 20


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(bits a table, tables) for n vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(8, math.ceil(math.log2(max(n, 2)))))
    while (tables := math.ceil(math.log(MISS) / math.log(1 - agree**bits))) > MOST_TABLES:
        bits -= 1
    return bits, tables


def projections(dims: int, count: int) -> np.ndarray:
    return np.random.default_rng(1_000_003 + dims).normal(size=(dims, count))


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix; fixed for a number of dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(7_000_003 + dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def table_values(unit: np.ndarray, label: list[str], bits: int, tables: int) -> np.ndarray:
    """For each unit vector a 64-bit value a table, of its label, length and sign bits."""
    side = (unit @ projections(unit.shape[1], bits * tables) > 0).reshape(len(unit), tables, bits)
    code = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.uint64)
    seeds = np.array([xxhash.xxh3_64_intdigest(f"{unit.shape[1]}:{x}") for x in label], np.uint64)
    x = (code + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) ^ seeds[:, None]
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def vectors(batch) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None where it cannot link."""
    out = []
    for label, value in zip(batch["_label"], batch["_vector"], strict=True):
        v = None
        if label.is_valid and value.is_valid and len(value.values) and not value.values.null_count:
            v = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(v).all() or not v.any():
                v = None
        out.append(v)
    return out


def unit_of(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def signer(bits: int, tables: int):
    def run(batches):
        for batch in batches:
            found, label = vectors(batch), batch["_label"].to_pylist()
            keys, bands = [None] * len(found), [None] * len(found)
            for dims in {len(v) for v in found if v is not None}:
                rows = [r for r, v in enumerate(found) if v is not None and len(v) == dims]
                values = table_values(unit_of(np.stack([found[r] for r in rows])), [label[r] for r in rows], bits, tables).view(np.int64)
                for r, v in zip(rows, values, strict=True):
                    keys[r] = xxhash.xxh3_128_digest((found[r] + 0.0).tobytes() + label[r].encode())
                    bands[r] = v
            blobs = [None if v is None else v.tobytes() for v in found]
            yield pa.RecordBatch.from_pydict({
                "_id": batch["_id"], "key": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
                "vector": pa.array(blobs, pa.binary()), "n_bytes": pa.array([0 if b is None else len(b) for b in blobs], pa.int64()),
            })

    return run


def linker(threshold: float):
    def linked(table: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        vector = np.stack([np.frombuffer(b, np.float64) for b in table["vector"].to_pylist()])  # a bucket has vectors of one length
        unit = unit_of(vector)
        dims = vector.shape[1]
        turned = (unit @ rotation(dims)).astype(np.float32)
        code = np.where(turned > 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dims))
        factor = (code * turned).sum(axis=1)
        spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * CONFIDENCE / math.sqrt(max(dims - 1, 1)) * math.sqrt(1 - threshold**2)
        yes = np.zeros(len(left), bool)
        for at in range(0, len(left), 1 << 16):
            a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", code[a], turned[b]) / factor[a] >= threshold - spread[a] - 1e-4
            near &= np.einsum("ij,ij->i", code[b], turned[a]) / factor[b] >= threshold - spread[b] - 1e-4
            a, b = a[near], b[near]
            yes[at + np.nonzero(near)[0]] = (unit[a] * unit[b]).sum(axis=1) >= threshold
        return yes

    return linked


def with_bands(batches):
    for batch in batches:
        bands = [np.array(b, np.int64).tobytes() for b in batch["bands"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"key": batch["key"], "copies": batch["copies"], "band_values": pa.array(bands, pa.binary()), "vector": batch["vector"]})


def embedding_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """One row a vector: (id_col, n_links, component_id)."""
    rows = table.select(col(id_col).alias("_id"), col(label_col).cast("string").alias("_label"), col(vector_col).cast("array<double>").alias("_vector"))
    id_type = rows.schema["_id"].dataType.simpleString()
    bits, tables = shape(table.count(), threshold)
    signs = written(rows.mapInArrow(signer(bits, tables), f"_id {id_type}, key binary, bands array<bigint>, vector binary, n_bytes bigint"), "vectors")
    valid = signs.where("key IS NOT NULL")
    classes = written(
        valid.groupBy("key").agg(F.count("*").alias("copies"), F.min("_id").alias("least"), F.first("bands").alias("bands"), F.first("vector").alias("vector"), F.first("n_bytes").alias("n_bytes")), "classes"
    )
    units = written(memberships(classes.select("key", "bands", "n_bytes"), unit_rows, UNIT_BYTES), "units")
    payload = (
        classes.hint("shuffle_merge").join(units.select("key").distinct(), "key").select("key", "copies", "bands", "vector")
        .mapInArrow(with_bands, "key binary, copies bigint, band_values binary, vector binary")
    )
    named = settled(classes, compare(units, payload, linker(threshold)))
    linked = valid.select("_id", "key").hint("shuffle_merge").join(named, "key").select("_id", "n_links", "class_id")
    alone = signs.where("key IS NULL").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("class_id"))
    return linked.union(alone).select(F.col("_id").alias(id_col), "n_links", F.col("class_id").alias("component_id"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = vec_id
"""
