"""The data source `fastq`: batch reader and writer; its stream reader is in `stream`.

Options of the reader: format (single or multiline), compression (auto, plain, gzip, bgzf, zstd), splitSize (bytes of a file that a task aims
at), splittable, bgzfEofCheck, mode (failfast or permissive), startOffset and endOffset (bytes, or BGZF virtual offsets), resync (go on at the
first record at or after startOffset, instead of right there), columns (those to build, all by default), validation, alphabet and quality (content that
makes a read an error), and summary (one row a split instead of its reads: true, qualities to look at these as well, or many for files of several splits only).
Options of the writer: compression (else by the path's extension), level, validation, alphabet, quality, singleFile, singleFileLimit.
Options that are not known are refused.
"""

from __future__ import annotations

import bisect
import dataclasses
import itertools
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import SCHEMA as ERROR_SCHEMA
from ..errors import ReadError, invalid
from . import codecs, framing, sinks

SPLIT = 64 << 20
#: Small splits go to a task in runs: of so many bytes at least, of more where all would be more than so many tasks, of SPLIT at most.
RUN, TASKS = 4 << 20, 256
SEGMENTS = "array<struct<offset:bigint,len:int>>"
COLUMNS = {
    "header": "binary", "seq": "binary", "qual": "binary", "file": "string", "file_no": "int", "split_id": "int", "record": "bigint", "header_offset": "bigint", "seq_offset": "bigint",
    "qual_offset": "bigint", "voffset": "bigint",
}
#: With the option summary: a split's records (an error counts as one), the decoded bytes from its place to the next split's, where offsets count from the split (else 0), bases, line
#: feeds, least and greatest quality where asked for, whether it ends in an error, and where its first record starts (an offset that startOffset takes).
SUMMARY = "file string, file_no int, split_id int, records bigint, bytes bigint, bases bigint, lines bigint, low int, high int, failed boolean, start bigint"
READ_OPTIONS = (
    "path", "format", "compression", "splitsize", "splittable", "bgzfeofcheck", "mode", "startoffset", "endoffset", "resync", "columns", "summary", "validation", "alphabet", "quality",
)
#: Of streams alone: see `stream`.
STREAM_OPTIONS = ("log", "maxfilespertrigger", "follow")
WRITE_OPTIONS = ("path", "compression", "level", "validation", "alphabet", "quality", "singlefile", "singlefilelimit")
#: Rows of an Arrow batch at most.
BATCH = 50_000


def known(options, names: tuple[str, ...]) -> None:
    odd = sorted(k for k in options if k.lower() not in names)
    if odd:
        raise ValueError(f"unknown options of fastq: {', '.join(odd)}; known are {', '.join(names)}")


def flag(options, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() in ("true", "1", "yes")


def sized(path: str) -> list[tuple[str, int]]:
    """The files of a path and their bytes: itself, or what a folder and those below it hold but hidden ones, in order of name; globs and comma lists are followed."""
    from pyarrow import fs

    if "," in path:
        return [f for p in path.split(",") for f in sized(p.strip())]
    system, inner = sinks.file_system(path)
    prefix = path[: len(path) - len(inner)] if "://" in path and path.endswith(inner) else ""
    if any(c in inner for c in "*?[") and isinstance(system, fs.LocalFileSystem):
        import glob

        return sorted((f, os.path.getsize(f)) for f in glob.glob(inner) if os.path.isfile(f))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(prefix + inner, info.size)]
    below = len(inner.rstrip("/")) + 1
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in f.path[below:].split("/")))


def listed(path: str) -> list[str]:
    return [f for f, _ in sized(path)]


def split_size(options: dict) -> int:
    return max(1, next((int(v) for k, v in options.items() if k.lower() == "splitsize"), SPLIT))


def run_bytes(total: int) -> int:
    """Bytes of a file that a task aims at where splits are smaller."""
    return min(SPLIT, max(RUN, total // TASKS))


def most_splits(path: str, options: dict) -> int:
    """A bound on the splits of a path, from the sizes of its files alone."""
    size = split_size(options)
    return sum(-(-n // size) or 1 for _, n in sized(path))


def modified(file: str) -> int:
    """The modification time in nanoseconds; 0 if the file system has none."""
    system, inner = sinks.file_system(file)
    return system.get_file_info(inner).mtime_ns or 0


@dataclass
class Split(InputPartition):
    """A part of a file. Plain: start and end are bytes. BGZF: bytes of the file at or after which the first block counts, or, where exact, virtual offsets.

    Where no record start is found at a cut, the split there is empty and the one before goes on to the next cut: they lie `step` bytes apart,
    up to `total`. limit is the exact end of the last split, if it has one.
    """

    file: str
    kind: str
    split_id: int
    file_no: int = 0
    start: int = 0
    end: int | None = None
    exact_start: bool = True
    exact_end: bool = False
    failed: ReadError | None = None
    step: int = 0
    total: int = 0
    limit: int | None = None


@dataclass
class Run(InputPartition):
    """Splits of a file that one task reads one after another: `count` of them from `first` on, out of `n` whose cuts lie `step` bytes apart from `low` to `high`."""

    file: str
    kind: str
    file_no: int = 0
    low: int = 0
    high: int = 0
    step: int = 0
    start: int = 0
    limit: int | None = None
    resync: bool = False
    failed: ReadError | None = None
    n: int = 1
    first: int = 0
    count: int = 1

    def splits(self) -> Iterator[Split]:
        last = self.n - 1
        for k in range(self.first, self.first + self.count):
            start, end = self.low + k * self.step if k else self.start, self.low + (k + 1) * self.step if k < last else self.limit
            yield Split(self.file, self.kind, k, self.file_no, start, end, k == 0 and not self.resync, k == last and self.limit is not None, self.failed, self.step, self.high, self.limit)

    def cut(self, size: int) -> Iterator[Run]:
        """Runs of about so many bytes."""
        count = max(1, size // self.step) if self.step else 1
        return (dataclasses.replace(self, first=k, count=min(count, self.n - k)) for k in range(0, self.n, count))


class Options:
    def __init__(self, options):
        known(options, READ_OPTIONS + STREAM_OPTIONS)
        self.wrapped = str(options.get("format", "single")).lower() in ("multiline", "multi", "multi-line")
        self.kind = str(options.get("compression", "auto")).lower()
        self.split = max(1, int(options.get("splitSize", SPLIT)))
        self.splittable = flag(options, "splittable", True)
        self.eof_check = flag(options, "bgzfEofCheck", True)
        self.permissive = str(options.get("mode", "failfast")).lower() == "permissive"
        self.start = int(options["startOffset"]) if "startOffset" in options else None
        self.end = int(options["endOffset"]) if "endOffset" in options else None
        self.resync, self.summary = flag(options, "resync", False), str(options.get("summary", "false")).lower()
        self.summary = "" if self.summary in ("false", "0", "no") else self.summary
        level = sinks.level_of(options.get("validation", "none"))
        _, low, high = sinks.encoding(options.get("quality", "phred33"))
        alphabet = sinks.ALPHABETS[options.get("alphabet", "iupac").lower()].encode()
        self.checks = framing.Checks(alphabet if "bases" in level else None, (low, high) if "qualities" in level and low <= high else None)
        asked = [c.strip() for c in str(options.get("columns", "")).split(",") if c.strip()]
        odd = [c for c in asked if c not in COLUMNS]
        if odd:
            raise ValueError(f"unknown columns of fastq: {', '.join(odd)}; known are {', '.join(COLUMNS)}")
        self.columns = tuple(c for c in COLUMNS if not asked or c in asked)
        self.want = ("qual",) * (self.summary == "qualities") if self.summary else tuple(c for c in framing.FIELDS if c in self.columns)

    def schema(self) -> str:
        if self.summary:
            return SUMMARY
        out = [f"{c} {COLUMNS[c]}" for c in self.columns]
        if self.wrapped:
            out += [f"seq_segs {SEGMENTS}", f"qual_segs {SEGMENTS}"]
        if self.permissive:
            out.append(f"error struct<{ERROR_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
        return ", ".join(out)


def laid(file: str, o: Options, file_no: int = 0) -> Run:
    """All splits of a file, by its size and first bytes alone; what is wrong with it is left to the task that meets it."""
    with codecs.opened(file) as f:
        found = codecs.sniff(f.read(codecs.SNIFFED))
    kind = found if o.kind == "auto" else o.kind

    def failed(e: ReadError) -> Run:
        return Run(file, kind, file_no, failed=e)

    if o.kind == "bgzf" and found != "bgzf":
        return failed(invalid("BgzfHeader", 0))
    if kind in ("bzip2", "xz"):
        return failed(ReadError("Unsupported", detail=kind))
    sought = o.start is not None or o.end is not None
    if sought and kind not in ("plain", "bgzf"):
        return failed(ReadError("Unsupported", detail="seek"))
    if kind not in ("plain", "bgzf"):
        return Run(file, kind, file_no)
    total, shift = codecs.size_of(file), 16 if kind == "bgzf" else 0
    low, high = (o.start or 0) >> shift, total if o.end is None else min(o.end >> shift, total)
    n = -(-(high - low) // o.split) if o.splittable and high - low > o.split else 1
    return Run(file, kind, file_no, low, high, o.split, o.start or 0, o.end, o.resync, n=n, count=n)


def planned(file: str, o: Options, file_no: int = 0) -> list[Split]:
    """A file's splits."""
    return list(laid(file, o, file_no).splits())


def dealt(found: list[Run]) -> list[Run]:
    """The splits of all files as runs, one a task: as few tasks as their bytes need, however small the splits are. One empty run if there is none."""
    size = run_bytes(sum(f.high - f.low for f in found))
    return [r for f in found for r in f.cut(size)] or [Run("", "none")]


def plans(files: list[str], o: Options) -> list[Run]:
    """The splits of all files, which are looked into side by side: planning waits for storage, not for the processor."""
    with ThreadPoolExecutor(32) as pool:
        return dealt([f for f in pool.map(lambda k: laid(files[k], o, k), range(len(files))) if o.summary != "many" or f.n > 1])


@dataclass
class Near:
    """What the splits of a run have found so far, of its last cuts and decoded blocks: neighbours ask for the same."""

    cuts: list[tuple] = field(default_factory=list)
    blocks: dict[int, tuple[int, bytes]] = field(default_factory=dict)


class Place:
    """Decoded chunks of a split and where its records start and end. In BGZF, offsets count from the split's first block.

    start is None where no record starts. end becomes known when reading reaches the next cut at which a record start is found: both splits look for
    that start by the same rule, and the one before tells whatever is damaged on its way there.
    """

    def __init__(self, split: Split, o: Options, near: Near | None = None):
        self.split, self.o, self.blocks, self.base, self.decoded, self.span = split, o, [], 0, 0, None
        self.near = near or Near()
        self.end: int | None = None
        self.cut: int | None = None if split.exact_end else split.end
        self.mark: tuple[int, int] | None = None  # in BGZF: the block of the next split and the place in it where its records start
        self.confirmed = False
        self.start = self.bgzf() if split.kind == "bgzf" else self.plain() if split.kind == "plain" else 0

    def plain(self) -> int | None:
        s = self.split
        self.end = s.end if s.exact_end else None
        if s.exact_start:
            return s.start
        if s.split_id:
            found = self.at_cut(s.start)
            self.confirmed = found is not None
            return found
        found, reached = self.synced(self.small_chunks(max(0, s.start - 1)), max(0, s.start - 1), s.start == 0, False)
        self.confirmed = found is not None
        return reached if found is None else found  # where resync gives up, reading on says what is there

    def bgzf(self) -> int | None:
        s = self.split
        if s.split_id:
            found = self.at_cut(s.start)
            self.base, start = found or (0, None)
        else:
            self.base, start = self.virtual(s.start)
            if not s.exact_start:
                data, at = self.decoded_from(self.base, max(0, start - 1)), max(0, start - 1)
                found, reached = self.synced(data, at, start == 0, False)
                self.confirmed = found is not None
                start = reached if found is None else found
        if s.exact_end:
            self.mark = self.virtual(s.end)
            if start is not None and (self.base, start) >= self.mark:
                return None
        return start

    def decoded_from(self, block: int, inside: int, seen: list | None = None) -> Iterator[bytes]:
        """Decoded bytes from a place in a block on; seen gets (decoded place, block) of each block."""
        place = 0
        for here, data in codecs.bgzf_blocks(self.split.file, block, 0, self.near.blocks):
            if seen is not None:
                seen.append((place, here))
            if place + len(data) > inside:
                yield data[max(0, inside - place) :]
            place += len(data)

    def small_chunks(self, at: int) -> Iterator[bytes]:
        """The file's bytes from a place on, by as much as looking for a record start needs at first."""
        return codecs.growing_chunks(self.split.file, at, framing.SURE if self.o.wrapped else framing.SOON)

    def at_cut(self, cut: int):
        """The record start found at a cut between splits; in BGZF (block, place in it). `same` has up to where cuts find the same, which is not looked for again within a run."""
        for low, high, self.same, found in reversed(self.near.cuts):
            if low <= cut <= high:
                return found
        if self.split.kind == "plain":
            found, self.same = self.synced(self.small_chunks(cut - 1), cut - 1, False)[0], self.line
        else:
            found = self.synced_block(cut)
        self.near.cuts.append((cut, cut if self.same is None else self.same, self.same, found))
        del self.near.cuts[:-16]
        return found

    def synced(self, chunks: Iterator[bytes], at: int, at_line: bool, cut: bool = True) -> tuple[int | None, int]:
        """The first record start after the first line end in chunks of the stream from offset `at`, or from `at` on if a line starts there; and the place that was reached.

        At a cut between splits any start will do, so that of a wrapped file is one that is sure.
        """
        self.line: int | None = at if at_line else None
        if not at_line:
            seen = 0
            try:
                for data in chunks:
                    if (k := data.find(b"\n")) >= 0:
                        chunks, at = itertools.chain([data[k + 1 :]], chunks), at + k + 1
                        self.line = at
                        break
                    at, seen = at + len(data), seen + len(data)
                    if seen > framing.SYNC_BYTES:
                        return None, at
                else:
                    return None, at
            except ReadError:
                return None, at
        lead = framing.LEAD if self.o.wrapped and cut else 0
        return framing.Synchroniser(self.o.wrapped, lead=lead).found(chunks, at)

    def synced_block(self, cut: int) -> tuple[int, int] | None:
        """(block, place in it) of the first record start after the first line end from the first block at a cut on: a block does not show the byte before it."""
        block, seen = codecs.next_block(self.split.file, cut, self.near.blocks), []
        self.same = block  # what cuts up to here find as well
        found = None if block is None else self.synced(self.decoded_from(block, 0, seen), 0, False)[0]
        if found is None:
            return None
        place, block = seen[bisect.bisect_right(seen, (found, 1 << 62)) - 1]
        return block, found - place

    def settle(self) -> None:
        """Looks for a record start at the cut that reading has reached. Where there is none, the next cut is the one to reach; where the start lies beyond further cuts, their starts count
        as well if they come before: a split ends where the first of all later ones starts."""
        s, cut = self.split, self.cut
        found = self.at_cut(cut)
        if s.kind == "plain":
            self.end = found if self.end is None else min(self.end, found or self.end)
            ahead = self.end
        else:
            self.mark = found if self.mark is None else min(self.mark, found or self.mark)
            ahead = self.mark and self.mark[0]
        if s.limit is not None and ahead is not None:  # what was found may lie beyond the end that was asked for
            if s.kind == "plain":
                self.end = min(self.end, s.limit)
            else:
                self.mark = min(self.mark, self.virtual(s.limit))
        self.cut = None if self.same is None else cut + s.step * max(1, -(-(self.same + 1 - cut) // s.step))
        if self.cut is not None and (self.cut >= s.total or ahead is not None and self.cut > ahead):
            self.cut = None
        if self.cut is None and ahead is None and s.limit is not None:
            if s.kind == "plain":
                self.end = s.limit
            else:
                self.mark = self.virtual(s.limit)

    def virtual(self, voffset: int) -> tuple[int, int]:
        """(block, place in it) of a virtual offset, if it has such a block and place; the end of the file has the place 0."""
        block, inside, total = voffset >> 16, voffset & 0xFFFF, codecs.size_of(self.split.file)
        if block == total and not inside and total:
            return block, 0
        with codecs.opened(self.split.file) as f:
            size = codecs.block_at(f, block, total)
        if not voffset:
            return 0, 0  # what is wrong with the first block is for the scan to say
        if size is None or inside > codecs.decoded_span(self.split.file, block, block + 1):
            raise invalid("BgzfVirtualOffset", voffset)
        return block, inside

    def chunks(self, offset: int) -> Iterator[bytes]:
        s = self.split
        if s.kind == "plain":
            for data in codecs.file_chunks(s.file, offset, min(codecs.CHUNK, max(s.step, 1 << 16)) if s.step else codecs.CHUNK):
                offset += len(data)
                while self.cut is not None and offset > self.cut:
                    self.settle()
                yield data
        elif s.kind == "bgzf":
            place = 0
            for here, data in codecs.bgzf_blocks(s.file, self.base, 0, self.near.blocks):
                self.blocks.append((place, here))
                while self.cut is not None and here >= self.cut:
                    self.settle()
                if self.mark is not None and here == self.mark[0]:
                    self.end, self.span = place + self.mark[1], place
                if place + len(data) > offset:
                    yield data[max(0, offset - place) :]
                place += len(data)
                self.decoded = place
        else:
            yield from codecs.decoded_chunks(s.file, s.kind)

    def voffsets(self, offsets) -> pa.Array:
        if self.split.kind != "bgzf" or not len(offsets):
            return pa.nulls(len(offsets), pa.int64())
        blocks, offsets = np.array(self.blocks, np.int64), np.asarray(offsets)
        k = np.searchsorted(blocks[:, 0], offsets, side="right") - 1
        return pa.array(blocks[k, 1] << 16 | offsets - blocks[k, 0])

    def records(self) -> Iterator[framing.Records]:
        """The split's records; an error that the container has at its end comes last."""
        if self.start is None:
            return
        while self.cut is not None and self.cut <= (self.start if self.split.kind == "plain" else self.base):
            self.settle()
        if self.mark is not None and self.mark <= (self.base, self.start) and self.split.kind == "bgzf":
            return
        if self.end is not None and self.start >= self.end:
            return
        self.blocks.clear()
        for got in framing.framed(self.chunks(self.start), self.start, self.o.wrapped, lambda: self.end, self.o.want, self.o.checks):
            yield got
            if got.error:
                return
        if self.split.kind == "bgzf" and self.end is None and self.o.eof_check and not codecs.marked(self.split.file):
            yield framing.Records(error=invalid("BgzfMissingEofMarker", self.decoded))

    def absolute(self, e: ReadError) -> ReadError:
        """An error's place in the whole stream: in BGZF the blocks before the split are walked, which only an error does."""
        if self.split.kind != "bgzf" or not self.base or e.kind == "BgzfVirtualOffset":
            return e
        return e.moved(codecs.decoded_span(self.split.file, 0, self.base))

    def bytes_to_next(self) -> int:
        """In BGZF, the decoded bytes up to the block at which the next split that has records starts; 0 where there is none, or where offsets do not count from the split."""
        if self.split.kind != "bgzf" or self.start is None or self.split.exact_end:
            return 0
        if self.span is None:  # an error came before
            while self.cut is not None:
                self.settle()
            self.span = codecs.decoded_span(self.split.file, self.base, self.mark[0]) if self.mark else 0
        return self.span

    def earlier(self) -> tuple[int, ReadError | None]:
        """The records of the file before this split, and the first error there: reads the file again up to here, which only an error in failfast mode does."""
        s, o = self.split, self.o
        if not s.split_id or self.start is None:
            return 0, None
        first = Place(dataclasses.replace(s, split_id=0, start=o.start or 0, end=None, exact_start=not o.resync, exact_end=False, limit=None), o)
        stop = self.start + (codecs.decoded_span(s.file, first.base, self.base) if s.kind == "bgzf" else 0)
        count = 0
        for got in framing.framed(first.chunks(first.start), first.start, o.wrapped, stop, (), o.checks):
            if got.failing:
                return count + got.failing[0][0], first.absolute(got.failing[0][1]).numbered(count + got.failing[0][0] + 1)
            count += len(got)
            if got.error:
                return count, first.absolute(got.error)
        return count, None


def run_batches(run: Run, o: Options) -> Iterator[pa.RecordBatch]:
    near = Near()
    for split in run.splits():
        yield from batches(split, o, near)


def batches(split: Split, o: Options, near: Near | None = None) -> Iterator[pa.RecordBatch]:
    count, place, found = 0, None, {"bases": 0, "lines": 0, "low": None, "high": None, "failed": False, "start": None}
    if split.kind == "none":
        return
    try:
        if split.failed:
            raise split.failed
        place = Place(split, o, near)
        for got in place.records():
            if o.summary:
                summed(found, got, place)
            elif got.failing and not o.permissive:
                raise got.failing[0][1].numbered(count + got.failing[0][0] + 1)
            else:
                for at in range(0, len(got), BATCH):
                    yield batch(got, slice(at, min(at + BATCH, len(got))), count + at, split, o, place)
            count += len(got)
            if got.error:
                raise got.error.numbered(count + 1)
    except ReadError as e:
        e, found["failed"] = e.numbered(count + 1), True
        if place:
            e = place.absolute(e)
            if not o.permissive and not o.summary:
                before, first = place.earlier()
                e = first or e.moved(0, e.record + before)
        if not o.permissive and not o.summary:
            raise e from None
        count += 1
        if not o.summary:
            yield failure(e, split, o)
    if o.summary:
        row = {"file": split.file, "file_no": split.file_no, "split_id": split.split_id, "records": count, "bytes": place.bytes_to_next() if place else 0, **found}
        yield pa.RecordBatch.from_pylist([row], pa.schema([(f.split()[0], TYPES[f.split()[1]]) for f in SUMMARY.split(", ")]))


def summed(found: dict, got: framing.Records, place: Place) -> None:
    """Adds records to a split's summary."""
    found["lines"] += got.lines
    if not len(got):
        return
    found["bases"] += int(np.sum(got.size))
    if found["start"] is None:
        first = int(got.header_offset[0])
        found["start"] = place.voffsets([first])[0].as_py() if place.split.kind == "bgzf" else first
    if got.qual is not None:
        raw = framing.bytes_of(got.qual)[0] if isinstance(got.qual, pa.Array) else np.frombuffer(b"".join(got.qual), np.uint8)
        if len(raw):
            low, high = int(raw.min()), int(raw.max())
            found["low"] = low if found["low"] is None else min(low, found["low"])
            found["high"] = high if found["high"] is None else max(high, found["high"])


def batch(got: framing.Records, part: slice, before: int, split: Split, o: Options, place: Place) -> pa.RecordBatch:
    offsets = got.header_offset[part]
    n = len(offsets)
    made = {
        "file": lambda: pa.repeat(pa.scalar(split.file, pa.string()), n), "file_no": lambda: pa.array(np.full(n, split.file_no, np.int32)),
        "split_id": lambda: pa.array(np.full(n, split.split_id, np.int32)), "record": lambda: pa.array(np.arange(before + 1, before + n + 1)), "voffset": lambda: place.voffsets(offsets),
    }
    made |= {f: lambda f=f: x if isinstance(x := getattr(got, f)[part], pa.Array) else pa.array(x, pa.binary()) for f in framing.FIELDS}
    made |= {f: lambda f=f: pa.array(getattr(got, f)[part], pa.int64()) for f in ("header_offset", "seq_offset", "qual_offset")}
    columns = {c: made[c]() for c in o.columns}
    if o.wrapped:
        for name in ("seq_segs", "qual_segs"):
            columns[name] = x if isinstance(x := getattr(got, name)[part], pa.Array) else pa.array(x, framing.SEGMENT)
    if o.permissive:
        bad = {k - part.start: e.numbered(before + k - part.start + 1).row() for k, e in got.failing if part.start <= k < part.stop}
        columns["error"] = pa.array([bad.get(k) for k in range(n)], ERROR_TYPE) if bad else pa.nulls(n, ERROR_TYPE)
    return pa.RecordBatch.from_pydict(columns)


TYPES = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
ERROR_TYPE = pa.struct([(k, TYPES[t]) for k, t in (f.split() for f in ERROR_SCHEMA.split(", "))])


def failure(e: ReadError, split: Split, o: Options) -> pa.RecordBatch:
    """One row that has the place of an error and no record."""
    known = {"file": split.file, "file_no": split.file_no, "split_id": split.split_id, "record": e.record, "header_offset": e.offset}
    columns = {c: pa.array([known.get(c)], TYPES[COLUMNS[c]]) for c in o.columns}
    if o.wrapped:
        columns |= {c: pa.nulls(1, framing.SEGMENT) for c in ("seq_segs", "qual_segs")}
    return pa.RecordBatch.from_pydict(columns | {"error": pa.array([e.row()], ERROR_TYPE)})


class Reader(DataSourceReader):
    def __init__(self, options):
        known(options, READ_OPTIONS)
        self.paths, self.o = options["path"], Options(options)

    def partitions(self):
        return plans(listed(self.paths), self.o)

    def read(self, partition):
        return run_batches(partition, self.o)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class Writer(DataSourceArrowWriter):
    """Tasks write hidden files that commit renames; a failed job leaves nothing behind."""

    def __init__(self, options, overwrite: bool):
        known(options, WRITE_OPTIONS)
        self.path, self.overwrite = options["path"], overwrite
        self.limit = int(options["singleFileLimit"]) if "singleFileLimit" in options else None
        self.kind = str(options.get("compression", sinks.by_extension(self.path))).lower()
        if self.kind not in sinks.SUFFIX:
            raise ReadError("Unsupported", detail=self.kind)
        self.level = sinks.checked_level(self.kind, options.get("level"))
        self.single = flag(options, "singleFile", False)
        self.how = (options.get("validation", "none"), options.get("alphabet", "iupac"), options.get("quality", "phred33"))
        sinks.Checks(*self.how)
        self.job = uuid.uuid4().hex[:12]
        self.folder = f"{self.path}.parts-{self.job}" if self.single else self.path

    def hidden(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/.{self.job}-{name}"

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{self.job}.{sinks.SUFFIX[self.kind]}"
        checks, encoder, rows = sinks.Checks(*self.how), sinks.Encoder(self.kind, self.level), 0
        temporary = self.hidden(f"{task.taskAttemptId() if task else 0}-{name}")
        f = None  # a task without rows makes no file
        try:
            for b in iterator:
                if b.num_rows:
                    f = f or sinks.output(temporary)
                    rows += b.num_rows
                    f.write(encoder.add(checks.text(*(b.column(c) for c in ("header", "seq", "qual")))))
            if f:
                f.write(encoder.finish())
                f.close()
        except BaseException:
            if f:
                f.close()
                system, inner = sinks.file_system(temporary)
                system.delete_file(inner)
            raise
        return Written(temporary if f else "", rows)

    def commit(self, messages):
        system, inner = sinks.file_system(self.path)
        done = [m for m in messages if m is not None and m.file]
        kept = []
        for m in done:
            name = re.sub(rf"^\.{self.job}-\d+-", "", os.path.basename(m.file))
            kept.append((name, m.file))
        if self.single:
            parts = [f for _, f in sorted(kept)]
            size = sum(codecs.size_of(f) for f in parts)
            if self.limit is not None and size > self.limit:
                raise ReadError("Unsupported", detail=f"one file of {size} bytes, above singleFileLimit {self.limit}; a folder of parts has no limit")
            temporary = f"{self.path}.{self.job}"
            if parts:
                sinks.joined(parts, temporary, self.kind)
            else:
                with sinks.output(temporary) as f:
                    f.write(sinks.Encoder(self.kind, self.level).finish())
            system.move(sinks.file_system(temporary)[1], inner)
            self.remove()
            return
        from pyarrow import fs

        system.create_dir(inner, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(f".{self.job}-")]
        for name, file in kept:  # the new files are there before the old ones go
            system.move(sinks.file_system(file)[1], f"{inner.rstrip('/')}/{name}")
        for file in old if self.overwrite else ():
            system.delete_file(file)

    def remove(self):
        from pyarrow import fs

        system, inner = sinks.file_system(self.folder)
        for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if os.path.basename(f.path).startswith(f".{self.job}-"):
                system.delete_file(f.path)
        if self.single:
            system.delete_dir(inner) if system.get_file_info(inner).type == fs.FileType.Directory else None

    def abort(self, messages):
        self.remove()


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return Options(self.options).schema()

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        from .stream import StreamReader  # which builds on this module

        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(FastqSource)


