"""One file from many tasks. A BGZF file is byte for byte that of a single writer: its blocks lie on a grid of decoded bytes, which the sizes of the parts place."""

from __future__ import annotations

import os
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from ..errors import ReadError
from . import codecs, sinks

#: Blocks that a task compresses.
BLOCKS = 1024
#: Bytes that a task copies, and up to which one process does.
COPIED = 64 << 20


def limited(size: int, limit: int | None) -> None:
    if limit is not None and size > limit:
        raise ReadError("Unsupported", detail=f"one file of {size} bytes, above singleFileLimit {limit}; a folder of parts has no limit")


def placed(spark: SparkSession, parts: list[tuple[str, int]], path: str, end: bytes = b"") -> None:
    """Lays parts (file, bytes) end to end in one file. Tasks copy ranges to their places; only a store whose files cannot be written from several places gets all from one process."""
    from pyarrow import fs

    (system, inner), total = sinks.file_system(path), sum(size for _, size in parts)
    temporary = f"{inner}.{uuid.uuid4().hex[:12]}"
    if total <= COPIED or not isinstance(system, fs.LocalFileSystem):
        with sinks.output(path[: len(path) - len(inner)] + temporary if "://" in path and path.endswith(inner) else temporary) as out:
            for file, _ in parts:
                for data in codecs.file_chunks(file):
                    out.write(data)
            out.write(end)
        system.move(temporary, inner)
        return
    tasks, at = [[]], 0
    for file, size in parts:
        for start in range(0, size, COPIED):
            n = min(COPIED, size - start)
            if sum(x[2] for x in tasks[-1]) + n > COPIED:
                tasks.append([])
            tasks[-1].append((file, start, n, at + start))
        at += size

    def copy(batches):
        for b in batches:
            for i in b["id"].to_pylist():
                for file, start, n, to in tasks[i]:
                    with codecs.opened(file) as f, open(temporary, "r+b") as out:
                        f.seek(start)
                        out.seek(to)
                        while n:
                            if not (data := f.read(min(n, codecs.CHUNK))):
                                raise OSError(f"{file} has become shorter")
                            out.write(data)
                            n -= len(data)
            yield b

    os.makedirs(os.path.dirname(inner), exist_ok=True)
    with open(temporary, "wb") as out:
        out.truncate(total)
        out.seek(total)
        out.write(end)
    spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(copy, "id bigint").count()
    system.move(temporary, inner)


def one_file(spark: SparkSession, parts: list[tuple[str, int]], path: str, kind: str, level: int, limit: int | None) -> None:
    """Writes parts of a format that can be concatenated, in order, as one file."""
    limited(sum(size for _, size in parts), limit)
    placed(spark, parts, path, b"" if parts else sinks.Encoder(kind, level).finish())


def decoded_range(parts: list[tuple[str, int]], ends: list[int], start: int, end: int) -> Iterator[bytes]:
    """Bytes of plain parts laid end to end."""
    k = bisect_right(ends, start)
    while start < end:
        file, size = parts[k]
        place = start - (ends[k] - size)
        with codecs.opened(file) as f:
            f.seek(place)
            data = f.read(min(size - place, end - start, 16 * sinks.BLOCK))
        if not data and place < size:
            raise OSError(f"{file} has become shorter")
        yield data
        start, k = start + len(data), k + (place + len(data) == size)


def one_bgzf(spark: SparkSession, parts: list[tuple[str, int]], path: str, level: int, limit: int | None, change: Callable[[int, int, bytes], bytes] | None = None, end: bytes = codecs.BGZF_EOF) -> None:
    """Writes the plain parts (file, bytes), in order, as one BGZF file. Tasks compress runs of whole blocks into files beside it, which are laid end to end.

    change may give other bytes for a block, by its number and that of all.
    """
    total, ends = 0, []
    for _, size in parts:
        total += size
        ends.append(total)
    whole = -(-total // sinks.BLOCK)
    run = BLOCKS * sinks.BLOCK
    made = f"{path}.blocks-{uuid.uuid4().hex[:12]}"

    def compress(batches):
        for b in batches:
            names, sizes = [], []
            for i in b["id"].to_pylist():
                name, held, written, number = f"{made}/{i:012d}-{uuid.uuid4().hex[:8]}", b"", 0, i * BLOCKS

                def block(data: bytes, number: int) -> bytes:
                    out = sinks.bgzf_block(data, level)
                    return change(number, whole, out) if change else out

                with sinks.output(name) as f:
                    for data in decoded_range(parts, ends, i * run, min(total, (i + 1) * run)):
                        held += data
                        for at in range(0, len(held) - sinks.BLOCK + 1, sinks.BLOCK):
                            written += f.write(block(held[at : at + sinks.BLOCK], number))
                            number += 1
                        held = held[len(held) - len(held) % sinks.BLOCK :]
                    if held:
                        written += f.write(block(held, number))
                names.append(name)
                sizes.append(written)
            yield pa.RecordBatch.from_pydict({"id": b["id"], "file": pa.array(names, pa.string()), "size": pa.array(sizes, pa.int64())})

    n = -(-total // run)
    done = sorted(spark.range(0, n, 1, max(1, n)).mapInArrow(compress, "id bigint, file string, size bigint").collect()) if n else []
    try:
        limited(sum(r.size for r in done), limit)
        placed(spark, [(r.file, r.size) for r in done], path, end)
    finally:
        if done:
            sinks.file_system(path)[0].delete_dir(sinks.file_system(made)[1])
