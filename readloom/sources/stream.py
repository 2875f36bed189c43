"""The stream reader of the data source `fastq`: files that appear in a folder and, where asked for, files that grow.

Options beside those of the batch reader: log (a folder of the stream's own, in which it notes what it has seen, so that an offset is one number however many files there are),
maxFilesPerTrigger (parts of files that a batch takes at most; needs a log) and follow (a file that grows gives its new records; needs a log).
"""

from __future__ import annotations

import copy
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql.datasource import DataSourceStreamReader

from ..errors import ReadError
from . import codecs, framing, sinks
from .fastq import Options, Place, Split, dealt, flag, laid, listed, modified, plans, run_batches, sized

#: Bytes of a file before its end in which the end of its last whole record is looked for first; twice as many each time, up to the bytes of a synchroniser.
TAIL = 1 << 18
#: Steps of a log after which one file takes the place of theirs.
KEEP = 32


@dataclass
class Part:
    """Records of a file from one place to another (bytes, in BGZF virtual offsets); with no end, the whole rest, after which the file is followed no more. size: the file's, when it was seen."""

    file: str
    start: int = 0
    end: int | None = None
    size: int = 0


class Log:
    """What each step of a stream added, a file a step (`000000000007.step`); every KEEP committed steps one file with all that came before (`000000000032.all`) takes their place.

    A step is written under another name first and then moved, so that it is there whole or not at all. One stream writes to a log at a time; a new stream on an old log reads all that the log has, again.
    """

    def __init__(self, folder: str):
        self.system, self.inner = sinks.file_system(folder)
        self.system.create_dir(self.inner, recursive=True)
        self.first, self.last, self.steps, self.seen = 0, 0, {}, {}
        names = self.names()
        self.first = max((n for n, kind in names if kind == "all"), default=0)
        if self.first:
            self.add_all(self.read(self.first, "all"))
        self.before = list(self.seen.values())
        self.last = self.first
        for n, kind in sorted(names):
            if kind == "step" and n > self.first:
                self.steps[n] = self.read(n, kind)
                self.add_all(self.steps[n])
                self.last = n

    def names(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        found = (f.base_name.split(".") for f in self.system.get_file_info(fs.FileSelector(self.inner)))
        return [(int(n[0]), n[1]) for n in found if len(n) == 2 and n[0].isdigit() and n[1] in ("step", "all")]

    def name(self, n: int, kind: str) -> str:
        return f"{self.inner.rstrip('/')}/{n:012d}.{kind}"

    def read(self, n: int, kind: str) -> list[Part]:
        with self.system.open_input_file(self.name(n, kind)) as f:
            return [Part(**json.loads(line)) for line in f.read().splitlines()]

    def write(self, n: int, kind: str, parts: list[Part]) -> None:
        beside = f"{self.inner.rstrip('/')}/_{uuid.uuid4().hex}"
        with self.system.open_output_stream(beside) as f:
            f.write("".join(json.dumps(asdict(p)) + "\n" for p in parts).encode())
        self.system.move(beside, self.name(n, kind))

    def add_all(self, parts: list[Part]) -> None:
        """A file's parts as one: from the start of its first to the end of its last."""
        for p in parts:
            old = self.seen.get(p.file)
            self.seen[p.file] = Part(p.file, old.start, p.end, p.size) if old else p

    def add(self, parts: list[Part]) -> None:
        self.write(self.last + 1, "step", parts)
        self.last += 1
        self.steps[self.last] = parts
        self.add_all(parts)

    def parts(self, start: int, end: int) -> list[Part]:
        """What the steps after one, up to another, added. Those that one file replaced are there together, for a stream that starts anew."""
        if start and start < self.first:
            raise RuntimeError(f"step {start} of the stream's log has been committed and merged into step {self.first}")
        merged = self.before if start < self.first else []
        return merged + [p for n in range(max(start, self.first) + 1, end + 1) for p in self.steps[n]]

    def commit(self, step: int) -> None:
        if step - self.first < KEEP:
            return
        old, held = self.first, self.seen
        self.seen = {p.file: p for p in self.before}
        for n in range(old + 1, step + 1):
            self.add_all(self.steps.pop(n))
        self.before, self.seen, self.first = list(self.seen.values()), held, step
        self.write(step, "all", self.before)
        for n, kind in self.names():
            if n < step or n == step and kind == "step":
                self.system.delete_file(self.name(n, kind))


def tail(file: str, kind: str, start: int, size: int, o: Options) -> tuple[Place, int] | None:
    """A place in a file from which on records are known to follow one another, near its end; or its start. None where none is found."""
    low, back = start >> 16 if kind == "bgzf" else start, TAIL
    while size - back > low and back <= framing.SYNC_BYTES:
        place = Place(Split(file, kind, 1, start=size - back, exact_start=False, step=back, total=size), o)
        if place.start is not None:
            return place, place.start
        back *= 2
    if size - low > 2 * framing.SYNC_BYTES:
        return None
    place = Place(Split(file, kind, 0, start=start), o)
    return place, place.start


def whole_to(file: str, start: int, size: int, o: Options) -> int | None:
    """Where the last record of a file that may still be written ends, a line feed after it; its start, if there is none yet; None if what stands at its end is wrong rather than unfinished.

    Reads the end of the file alone. A block or a record that the file's end cuts is unfinished.
    """
    with codecs.opened(file) as f:
        kind = codecs.sniff(f.read(codecs.SNIFFED)) if o.kind == "auto" else o.kind
        if kind not in ("plain", "bgzf"):
            return None
        found = tail(file, kind, start, size, o)
        if found is None:
            return None
        place, at = found
        if kind == "plain":
            f.seek(at)
            out, used = framing.one_by_one(f.read(size - at), at, 0, False, o.wrapped)
            return None if out.error else at + used if used else max(start, at)
        blocks, data, decoded, here = [], [], 0, place.base
        while (n := codecs.block_at(f, here, size)) is not None:
            f.seek(here)
            blocks.append((decoded, here))
            data.append(codecs.bgzf_block(f.read(n), 0))
            decoded, here = decoded + len(data[-1]), here + n
        f.seek(here)
        head = f.read(size - here)[:64]
        if len(head) >= 18 and codecs.block_size(head) is None:
            return None
    text = b"".join(data)
    out, used = framing.one_by_one(text, 0, at, False, o.wrapped)
    if out.error:
        return None
    for k in range(len(blocks) - 1, -1, -1):
        if blocks[k][0] <= used and used - blocks[k][0] < 1 << 16:
            return max(start, blocks[k][1] << 16 | used - blocks[k][0])
    return start


class StreamReader(DataSourceStreamReader):
    """Files that appear in a folder; each is read whole, once, whatever its name and modification time.

    Without a log, an offset names the files that the folder held: a batch has those that its end names and its start does not, in order of
    modification time and name, and a file that goes and comes back in a later batch counts as new. With a log, an offset is the number of a step of the log, and a
    file's name counts once. A stream begun without a log may go on with one.

    With follow, a plain or BGZF file that has become longer gives the records that are whole since. A record counts once a line feed ends it; one that is not whole yet waits, and so does
    what stands at the end of a BGZF file before its block is whole; the end marker is not asked for. gzip and zstd files are read whole, once. A file whose end is wrong is read as it stands, its
    error told, and followed no more; one that has become shorter than what was read of it is an error.

    With maxFilesPerTrigger, a batch takes the oldest parts first and leaves the rest to the next. Triggers that ask for offsets once (once, availableNow) make one batch of that many; the next run goes on.
    """

    def __init__(self, options):
        self.paths, self.o = options["path"], Options(options)
        self.follow, self.most = flag(options, "follow", False), int(options.get("maxFilesPerTrigger", 0))
        if (self.follow or self.most) and not options.get("log"):
            raise ValueError("follow and maxFilesPerTrigger need a log")
        if self.follow and (self.o.start is not None or self.o.end is not None):
            raise ValueError("follow takes no startOffset and no endOffset")
        self.folder, self.held = options.get("log"), None

    @property
    def log(self) -> Log:
        """The log, read when it is first asked for: on the driver alone."""
        if self.held is None:
            self.held = Log(self.folder)
        return self.held

    def initialOffset(self) -> dict:
        return {"step": 0} if self.folder else {"files": []}

    def latestOffset(self) -> dict:
        if not self.folder:
            return {"files": sorted(set(listed(self.paths)))}
        if new := self.fresh():
            self.log.add(new)
        return {"step": self.log.last}

    def fresh(self) -> list[Part]:
        """Parts that no step has yet, oldest first."""
        seen = self.log.seen
        sizes = {f: n for f, n in sized(self.paths) if f not in seen or self.follow and seen[f].end is not None and seen[f].size != n}
        files = [f for _, f in self.by_age(list(sizes))]
        if not self.follow:
            return [Part(f, size=sizes[f]) for f in files[: self.most or None]]
        out: list[Part] = []
        with ThreadPoolExecutor(32) as pool:
            for at in range(0, len(files), 256):
                out += filter(None, pool.map(lambda f: self.grown(f, sizes[f]), files[at : at + 256]))
                if self.most and len(out) >= self.most:
                    return out[: self.most]
        return out

    def grown(self, file: str, size: int) -> Part | None:
        """What is new in a file; None if nothing is whole yet."""
        old = self.log.seen.get(file)
        if old and size < old.size:
            raise RuntimeError(f"{file} has become shorter than what was read of it")
        start = old.end if old else 0
        with codecs.opened(file) as f:
            head = f.read(codecs.SNIFFED)
        if not head or len(head) < 18 and head[:2] == b"\x1f\x8b":  # too little to tell gzip from BGZF
            return None
        try:
            end = whole_to(file, start, size, self.o)
        except ReadError:
            end = None
        return None if end == start else Part(file, start, end, size)

    def by_age(self, files: list[str]) -> list[tuple[int, str]]:
        with ThreadPoolExecutor(32) as pool:
            return sorted(zip(pool.map(modified, files), files, strict=True))

    def named(self, offset: dict) -> set[str]:
        if "files" in offset:
            return set(offset["files"])
        # of a checkpoint by an earlier version: the last file's time and name; of a URI only the name counted
        last = (offset["time"], offset["file"])
        return {f for f in listed(self.paths) if (f <= last[1] if "://" in self.paths else (modified(f), f) <= last)}

    def partitions(self, start: dict, end: dict):
        if "step" not in end:
            return plans([f for _, f in self.by_age(list(self.named(end) - self.named(start)))], self.o)
        if "step" in start:
            parts = self.log.parts(start["step"], end["step"])
        else:
            before = self.named(start)
            parts = [p for p in self.log.parts(0, end["step"]) if p.file not in before]
        if not self.follow and all(not p.start and p.end is None for p in parts):
            return plans([p.file for p in parts], self.o)
        with ThreadPoolExecutor(32) as pool:
            return dealt(list(pool.map(lambda k: laid(parts[k].file, self.within(parts[k]), k), range(len(parts)))))

    def within(self, part: Part) -> Options:
        o = copy.copy(self.o)
        o.start, o.end = part.start or None, part.end
        return o

    def read(self, partition):
        return run_batches(partition, self.o)

    def commit(self, end: dict) -> None:
        if "step" in end:
            self.log.commit(end["step"])
