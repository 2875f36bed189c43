"""Packing of token sequences (operator 11): best-fit decreasing over windows of a fixed number of tokens.

1. A text is encoded once, with an end token after it; a document of more than a window is cut into full windows and the rest. A piece is known
   by its document, start, length and checksum from here on: ids are kept only where sequences are to be built.
2. Pieces are dealt by a hash of their row and start to groups of bounded tokens and pieces, each of which holds a sample of all lengths, so a group
   wastes a part of its last window at most where there are short pieces.
3. In a group, pieces go by decreasing length into the open window with the least sufficient room. A segment tree over rooms 0 to `window` tells the
   least room that holds a piece and has an open window in twice as many steps as a room has bits; a new window opens only where none has room.

A sequence needs no padding if its length is the window's or a power of two. Results that the cases have: null and empty texts are one end token;
rows alike in id and text are packed one by one; null ids stay; ties in length are taken in the order of rows; extra columns are ignored; an
empty table gives an empty result; texts are encoded whole, and every id lies in exactly one piece. A document that fits in a window is never cut.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, default_path
from .common import col, text_of, written

WINDOW = 4096
END = 2
#: A group's tokens and pieces, about.
GROUP_TOKENS = 256 * WINDOW
GROUP_PIECES = 100_000
#: Rows, or bytes of ids, of an Arrow batch of pieces at most.
BATCH_ROWS, BATCH_BYTES = 20_000, 4 << 20


class Rooms:
    """Open windows by the room that they have left, under a segment tree whose inner nodes tell whether a leaf below has windows."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.leaves
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def tightest(self, length: int) -> int:
        """The least room of at least `length` that an open window has; -1 if none has."""
        tree, node = self.tree, length + self.leaves
        if not tree[node]:
            while node & 1 or not tree[node + 1]:  # up until there is something to the right
                node >>= 1
                if not node:
                    return -1
            node += 1
            while node < self.leaves:
                node = 2 * node + (not tree[2 * node])
        return node - self.leaves

    def take(self, room: int) -> int:
        """Removes and returns the window that got this room last."""
        window = self.windows[room].pop()
        node = room + self.leaves
        if not self.windows[room]:
            self.tree[node] = 0
            while (node := node >> 1) and not self.tree[2 * node] and not self.tree[2 * node + 1]:
                self.tree[node] = 0
        return window


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """Windows and offsets of pieces in the order given, which is by decreasing length, and the tokens of each window."""
    rooms, used, placed, offsets = Rooms(window), [], [], []
    for n in lengths:
        room = rooms.tightest(n)
        if room < 0:
            w, room = len(used), window
            used.append(0)
        else:
            w = rooms.take(room)
        placed.append(w)
        offsets.append(used[w])
        used[w] += n
        if room > n:
            rooms.put(room - n, w)
    return placed, offsets, used


def cutter(path: str, window: int, end: int, with_ids: bool):
    """Arrow batches of (_row, _id, _text) to pieces."""
    schema = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]
    last = int(end).to_bytes(4, "little")

    def run(batches):
        c = codec(path, library=True)

        def emitted(batch, at, columns):
            rows = pa.array(at)
            return pa.RecordBatch.from_arrays(
                [batch["_row"].take(rows), batch["_id"].take(rows), *(pa.array(v, t) for v, (_, t) in zip(columns, schema, strict=True))], ["_row", "_id", *(n for n, _ in schema)]
            )

        for batch in batches:
            at, columns, size = [], [[] for _ in schema], 0
            for k, text in enumerate(batch["_text"]):
                blob = c.encoded(text.as_py()) + last
                total = len(blob) // 4
                for start in range(0, total, window):
                    part = blob[4 * start : 4 * (start + window)]
                    at.append(k)
                    for column, value in zip(columns, (start, len(part) // 4, zlib.crc32(part), total, part), strict=False):
                        column.append(value)
                    size += len(part) if with_ids else 0
                    if len(at) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield emitted(batch, at, columns)
                        at, columns, size = [], [[] for _ in schema], 0
            if at:
                yield emitted(batch, at, columns)

    return run


def packer(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["start"].to_numpy(), table["_row"].to_numpy(), -lengths))
        placed, offsets, used = best_fit(lengths[order].tolist(), window)
        group = table["_group"][0].as_py()
        out = table.take(pa.array(order)).drop_columns(["_row", "_group"])
        placed, used = np.array(placed, np.int64), np.array(used, np.int64)
        whole = np.where(used & (used - 1) == 0, used, window)
        for name, values in (("sequence_id", placed + (group << 32)), ("offset", np.array(offsets, np.int64)), ("sequence_tokens", used[placed]), ("padded_tokens", whole[placed])):
            out = out.append_column(name, pa.array(values))
        return out

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False,
         group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row a piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens), and `ids`, its token ids as
    little-endian unsigned 32-bit integers, where asked for. path names the vocabulary file, which every executor can read."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), col(id_col).alias("_id"), text_of(docs, text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    ids = ", ids binary" if with_ids else ""
    pieces = written(rows.mapInArrow(cutter(path, window, end, with_ids), f"_row bigint, _id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{ids}"), "pieces")
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-n // group_pieces), -(-tokens // group_tokens))
    out = pieces.withColumn("_group", F.pmod(F.xxhash64("_row", "start"), F.lit(groups))).groupBy("_group").applyInArrow(
        packer(window), f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{ids}, sequence_id bigint, offset bigint, sequence_tokens bigint, padded_tokens bigint"
    )
    return out.withColumnRenamed("_id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id", pad: int = 0) -> DataFrame:
    """The sequences of what pack returned with its ids: (sequence_id, input_ids padded, n_tokens, lengths, docs), the last two by piece in order of offset.

    A sequence is gathered in one row, which a window bounds.
    """
    rows = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids", col(id_col).alias("doc")))).alias("x"), F.max("padded_tokens").alias("padded_tokens"), F.sum("length").alias("n_tokens")
    ).select("sequence_id", "padded_tokens", "n_tokens", F.transform("x", lambda p: p["ids"]).alias("ids"), F.transform("x", lambda p: p["length"]).alias("lengths"), F.transform("x", lambda p: p["doc"]).alias("docs"))

    def run(batches):
        for b in batches:
            whole = [np.frombuffer(b"".join(parts), "<u4").astype(np.int32) for parts in b["ids"].to_pylist()]
            input_ids = pa.array([np.pad(ids, (0, n - len(ids)), constant_values=pad) for ids, n in zip(whole, b["padded_tokens"].to_pylist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["sequence_id"], input_ids, b["n_tokens"], b["lengths"], b["docs"]], ["sequence_id", "input_ids", "n_tokens", "lengths", "docs"])

    kind = rows.schema["docs"].dataType.simpleString()
    return rows.mapInArrow(run, f"sequence_id bigint, input_ids array<int>, n_tokens bigint, lengths array<bigint>, docs {kind}")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
