"""Hard-negative mining (operator 12) over a vector-approximation file.

Components become integers, floor(scale * x). For each dimension the range of its values is cut into CELLS cells of equal width; a row's
approximation is the cell of each of its components, one byte a dimension. A score, the inner product of two rows, lies within bounds that a table of cells gives: with the
middle m and half width h of a row's cell in each dimension, q.m - |q|.h and q.m + |q|.h for an anchor q. Only a row that may lie in a window by its bounds, and whose upper
bound is not below the k-th best score that is sure by then, is scored exactly in 64-bit integers.

Anchors and rows are dealt to blocks of bounded size by hashes of their numbers, and every block of rows meets every block of anchors in one unit: a stated query set against all
rows, in blocks. A unit returns what may be among an anchor's first, never more than k rows a window; windows in Spark rank those. The first pass finds
an anchor's positives, the second, with the score windows that these give, its negatives.

Results that the cases have: rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of different lengths do
not meet; rows that share an anchor's id are not its positives or negatives; other rows with one id count each by itself; anchor rows alike in all are one anchor; ties are ordered by id; components beyond
LARGEST in size count as that; a positive score of 0 or less has only the window that its own bounds give, which may be empty; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, forget, written

CELLS = 256
LARGEST = 1 << 23
#: A unit's rows, least and most, the bytes of its vectors, its anchors, and units that are aimed at.
LEAST_ROWS, MOST_ROWS, MOST_BYTES, MOST_ANCHORS, UNITS = 4096, 65_536, 16 << 20, 4096, 256
#: Anchors and rows whose bounds are computed at once.
TILE_ANCHORS, TILE_ROWS = 128, 8192
FOUND = "ano bigint, id bigint, score bigint"


def integers(scale: float):
    """Arrow batches of (id, label, vector, anchor) to whole numbers as bytes; rows that take no part are left out."""
    def run(batches):
        for b in batches:
            keep, blobs = [], []
            for k, value in enumerate(b["vector"]):
                if value.is_valid and not value.values.null_count:
                    v = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64)
                    if np.isfinite(v).all():
                        keep.append(k)
                        with np.errstate(over="ignore"):
                            blobs.append(np.clip(np.floor(v * scale), -LARGEST, LARGEST).astype("<i4").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in ("id", "label", "anchor")), pa.array(blobs, pa.binary())], ["id", "label", "anchor", "vector"])

    return run


def matrix(vectors: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<i4").reshape(len(vectors), dims)


def ranges(batches):
    """(dims, d, low, high): the range of each dimension in a batch, by the length of its vectors."""
    for b in batches:
        size = b["dims"].to_numpy(zero_copy_only=False)
        for dims in np.unique(size):
            v = matrix(b["vector"].take(pa.array(np.flatnonzero(size == dims))), int(dims))
            yield pa.RecordBatch.from_pydict({"dims": pa.array(np.full(dims, dims, np.int32)), "d": pa.array(np.arange(dims, dtype=np.int32)), "low": pa.array(v.min(0)), "high": pa.array(v.max(0))})


def approximations(cells: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds a row's cells, a byte a dimension. cells has the low end and the width of a cell for each dimension, by the length of the vectors."""
    def run(batches):
        for b in batches:
            size, codes = b["dims"].to_numpy(zero_copy_only=False), np.empty(b.num_rows, object)
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                low, width = cells[int(dims)]
                found = ((matrix(b["vector"].take(pa.array(at)), int(dims)) - low) // width).astype(np.uint8)
                for k, c in zip(at, found, strict=True):
                    codes[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes.tolist(), pa.binary())], [*b.schema.names, "codes"])

    return run


class First:
    """The first k rows of each (anchor, window) so far: anchors' places, row numbers and scores."""

    def __init__(self, anchors: int, k: int, ids: np.ndarray):
        self.k, self.ids, self.sure = k, ids, np.full(anchors, -np.inf)
        self.anchor, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, anchor: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        anchor, row, score = (np.concatenate(x) for x in ((self.anchor, anchor), (self.row, row), (self.score, score)))
        order = np.lexsort((self.ids[row], -score, anchor))
        anchor, row, score = anchor[order], row[order], score[order]
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.empty(0, np.int64)
        rank = np.arange(len(anchor)) - np.repeat(starts, np.diff(np.r_[starts, len(anchor)]))
        stay = rank < self.k
        last = rank == self.k - 1
        self.sure[anchor[last]] = score[last]
        self.anchor, self.row, self.score = anchor[stay], row[stay], score[stay]


def exact(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows named, in 64-bit integers, a bounded number at once."""
    out, step = np.empty(len(left), np.int64), max(1, (1 << 22) // max(1, a.shape[1]))
    for at in range(0, len(left), step):
        out[at : at + step] = np.einsum("ij,ij->i", a[left[at : at + step]].astype(np.int64), b[right[at : at + step]].astype(np.int64))
    return out


def meeter(cells: dict, k: int, same: bool):
    """A unit of rows and anchors (with `windows`, pairs of a least and a most score) to (ano, id, score) of the rows that may be among the first k of a window."""
    empty = pa.schema([("ano", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]).empty_table()

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        forget()
        out = [empty]
        if anchors.num_rows and rows.num_rows:
            for dims in np.intersect1d(anchors["dims"].to_numpy(), rows["dims"].to_numpy()):
                left, right = (t.filter(pa.compute.equal(t["dims"], pa.scalar(dims, pa.int32()))).combine_chunks() for t in (anchors, rows))
                out.append(met(left, right, int(dims)))
        return pa.concat_tables(out)

    def met(anchors: pa.Table, rows: pa.Table, dims: int) -> pa.Table:
        q, v = matrix(anchors["vector"], dims), matrix(rows["vector"], dims)
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(rows.num_rows, dims)
        low, width = cells[dims]
        middles = low + np.arange(CELLS)[:, None] * width + (width - 1) / 2  # the table: the middle of each cell of each dimension
        reach = np.abs(q).astype(np.float64) @ ((width - 1) / 2)
        ids, labels, own, wanted = (t[c].to_numpy() for t, c in ((rows, "id"), (rows, "label"), (anchors, "id"), (anchors, "label")))
        windows = np.array(anchors["windows"].to_pylist(), np.float64).reshape(len(q), -1, 2)
        firsts = [First(len(q), k, ids) for _ in range(windows.shape[1])]
        every = np.arange(dims)
        for r in range(0, len(v), TILE_ROWS):
            part = slice(r, r + TILE_ROWS)
            middle = middles[codes[part], every].T
            slack = 1e-9 * (np.abs(middle).max(initial=0) + 1)
            for a in range(0, len(q), TILE_ANCHORS):
                some = slice(a, a + TILE_ANCHORS)
                score = q[some].astype(np.float64) @ middle
                about = (reach[some] + slack * np.abs(q[some]).sum(1) + 1e-6)[:, None]
                least, most = score - about, score + about
                meets = ((labels[part][None] == wanted[some][:, None]) == same) & (ids[part][None] != own[some][:, None])
                may = [meets & (most >= windows[some, j, :1]) & (least <= windows[some, j, 1:]) for j in range(len(firsts))]
                chosen = np.zeros(score.shape, bool)
                for j, first in enumerate(firsts):
                    certain = np.where(may[j] & (least >= windows[some, j, :1]) & (most <= windows[some, j, 1:]), least, -np.inf)
                    bar = first.sure[some]
                    if certain.shape[1] >= k:
                        bar = np.maximum(bar, np.partition(certain, -k, axis=1)[:, -k])
                    may[j] &= most >= bar[:, None]
                    chosen |= may[j]
                x, y = np.nonzero(chosen)
                found = exact(q[some], v[part], x, y)
                for j, first in enumerate(firsts):
                    yes = may[j][x, y] & (found >= windows[some, j, 0][x]) & (found <= windows[some, j, 1][x])
                    first.add(x[yes] + a, y[yes] + r, found[yes])
        pairs = np.unique(np.concatenate([np.stack([f.anchor, f.row, f.score]) for f in firsts], axis=1), axis=1) if firsts else np.empty((3, 0), np.int64)
        return pa.table({"ano": anchors["ano"].take(pa.array(pairs[0])), "id": pa.array(ids[pairs[1]], pa.int64()), "score": pa.array(pairs[2])})

    return run


def mine(table: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256, positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, unit_rows: int | None = None, unit_anchors: int = MOST_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that the column `anchor` names and each of its first positives, rows of its label, the first
    rows of other labels whose score is from `low` to `high` percent of the positive's. Ids are whole numbers."""
    spark = table.sparkSession
    rows = table.select(col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), col(vector_col).cast("array<double>").alias("vector"))
    whole = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").mapInArrow(integers(scale), "id bigint, label bigint, anchor boolean, vector binary")
    whole = written(whole.withColumn("dims", F.expr("length(vector) div 4").cast("int")).withColumn("row", F.monotonically_increasing_id()), "whole")
    spread = whole.select("dims", "vector").mapInArrow(ranges, "dims int, d int, low int, high int").groupBy("dims", "d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dims", "d").collect()
    cells = {n: (np.array(lows := [r.low for r in spread if r.dims == n], np.int64), -(-(np.array([r.high for r in spread if r.dims == n], np.int64) - lows + 1) // CELLS)) for n in {r.dims for r in spread}}
    cells[0] = (np.empty(0, np.int64), np.empty(0, np.int64))
    n, size, bytes_ = whole.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.sum(F.length("vector")), F.lit(0))).first()
    blocks = -(-n // unit_rows) if unit_rows else max(-(-n // MOST_ROWS), -(-bytes_ // MOST_BYTES), min(UNITS, -(-n // LEAST_ROWS)))
    blocks, sides = max(1, blocks), max(1, -(-size // unit_anchors))
    coded = whole.select("row", "id", "label", "dims", "vector").mapInArrow(approximations(cells), "row bigint, id bigint, label bigint, dims int, vector binary, codes binary")
    coded = coded.withColumn("r", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))))
    asked = written(whole.where("anchor").select("id", "label", "dims", "vector").distinct().withColumn("ano", F.monotonically_increasing_id()), "anchors")

    def pairs(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        dealt = anchors.withColumn("a", F.pmod(F.xxhash64("ano"), F.lit(sides))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return dealt.groupBy("r", "a").cogroup(coded.groupBy("r", "a")).applyInArrow(meeter(cells, k, same), FOUND)

    def first(df: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    endless = F.array(F.lit(-1 << 62), F.lit(1 << 62))
    best = written(first(pairs(asked.withColumn("windows", endless), positives, True), positives, "ano"), "positives")
    # least and most whole score of a window: low percent rounded up, high percent rounded down
    ends = best.groupBy("ano").agg(F.flatten(F.collect_list(F.array(-F.floor(-F.col("score") * low / 100), F.floor(F.col("score") * high / 100)))).alias("windows"))
    hard = pairs(asked.join(ends, "ano"), negatives, False)
    named = best.select("ano", F.col("id").alias("positive_id"), F.col("rank").alias("nth"), F.col("score").alias("positive_score")).join(asked.select("ano", F.col("id").alias("anchor_id")), "ano")
    met = hard.join(named, "ano").where((F.col("positive_score") * low <= F.col("score") * 100) & (F.col("score") * 100 <= F.col("positive_score") * high))
    return first(met, negatives, "ano", "nth").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(table, F.col("vec_id") % 100 == 0)


OP12_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank, s.other AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) <= 10
"""
