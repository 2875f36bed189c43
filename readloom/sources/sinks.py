"""Encoders for records on their way out: plain, gzip, BGZF and zstd, with validation before anything is written."""

from __future__ import annotations

import os
import re
import struct
import zlib

import pyarrow as pa
import pyarrow.compute as pc

from ..errors import ReadError, invalid
from .codecs import BGZF_EOF, opened

BLOCK = 65_280
DEFAULT_LEVEL = 6
EXTENSIONS = {"bgz": "bgzf", "bgzf": "bgzf", "gz": "gzip", "zst": "zstd", "zstd": "zstd"}
SUFFIX = {"plain": "fastq", "gzip": "fastq.gz", "bgzf": "fastq.bgz", "zstd": "fastq.zst"}
VALIDATION = ("none", "linebreaks", "bases", "qualities", "basesandqualities")
# The alphabets and quality encodings of the format.
ALPHABETS = {"strict": "ACGTN", "casesensitive": "ACGTN", "case": "ACGTNacgtn", "iupac": "ACGTURYSWKMBDHVNacgturyswkmbdhvn.-"}
ENCODINGS = {"phred33": (33, 33, 126), "phred64": (64, 64, 126)}


def by_extension(path: str) -> str:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path) else "", "plain")


def checked_level(kind: str, level: str | None) -> int:
    n = DEFAULT_LEVEL if level is None else int(level)
    low, high = (1, 22) if kind == "zstd" else (0, 9)
    if not low <= n <= high:
        raise ReadError("Unsupported", detail=f"compression level {n}")
    return n


def encoding(name: str) -> tuple[int, int, int]:
    """(offset, least, most): phred33, phred64, or three numbers `offset,min,max`."""
    if name.lower() in ENCODINGS:
        return ENCODINGS[name.lower()]
    offset, low, high = map(int, name.split(","))
    return offset, low, high


def level_of(validation: str) -> str:
    """A validation level by any of its spellings."""
    found = validation.lower().replace("_", "").replace("-", "")
    if found not in VALIDATION:
        raise ValueError(f"validation must be one of {', '.join(VALIDATION)}")
    return found


class Checks:
    """What a record must pass before it is written. Content errors have the index within the field as offset."""

    def __init__(self, validation: str = "none", alphabet: str = "iupac", quality: str = "phred33"):
        level = level_of(validation)
        self.breaks = level != "none"
        self.bases = re.compile(b"[^" + re.escape(ALPHABETS[alphabet.lower()].encode()) + b"]") if "bases" in level else None
        _, low, high = encoding(quality)
        outside = bytes(b for b in range(256) if not low <= b <= high)
        self.quals = re.compile(b"[" + re.escape(outside) + b"]") if "qualities" in level and low <= high and outside else None

    def check(self, header: bytes, seq: bytes, qual: bytes) -> None:
        if len(seq) != len(qual):
            raise ReadError("LengthMismatch", 0, seq_len=len(seq), qual_len=len(qual))
        if b"\n" in header or b"\r" in header:
            raise invalid("HeaderContainsNewline", 0)
        if self.breaks:
            for value, kind in ((seq, "SeqContainsNewline"), (qual, "QualContainsNewline")):
                if m := re.search(b"[\r\n]", value):
                    raise invalid(kind, m.start())
        if self.bases and (m := self.bases.search(seq)):
            raise ReadError("InvalidBase", m.start(), byte=seq[m.start()])
        if self.quals and (m := self.quals.search(qual)):
            raise ReadError("InvalidQuality", m.start(), byte=qual[m.start()])


    def text(self, header: pa.Array, seq: pa.Array, qual: pa.Array) -> bytes:
        """Records of a batch as text. The columns are looked at as wholes; only where one does not pass, row by row for the first error."""
        fine = pc.all(pc.equal(pc.binary_length(seq), pc.binary_length(qual))).as_py() is not False and not broken(header) and header.null_count + seq.null_count + qual.null_count == 0
        fine = fine and not (self.breaks and (broken(seq) or broken(qual)))
        fine = fine and not (self.bases and self.bases.search(whole(seq))) and not (self.quals and self.quals.search(whole(qual)))
        if not fine:
            for row in zip(header.to_pylist(), seq.to_pylist(), qual.to_pylist(), strict=True):
                self.check(*row)
        n = len(header)
        parts = [pa.repeat(pa.scalar(b"@", pa.large_binary()), n), header, pa.repeat(pa.scalar(b"\n", pa.large_binary()), n), seq, pa.repeat(pa.scalar(b"\n+\n", pa.large_binary()), n), qual]
        return whole(pc.binary_join_element_wise(*(p.cast(pa.large_binary()) for p in parts), pa.scalar(b"", pa.large_binary())), b"\n")


def whole(values: pa.Array, end: bytes = b"") -> bytes:
    """The values of a column one after another, each with an end."""
    one = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values.cast(pa.large_binary()))
    return (pc.binary_join(one, pa.scalar(end, pa.large_binary()))[0].as_py() or b"") + (end if len(values) else b"")


def broken(values: pa.Array) -> bool:
    """Whether a value has a line feed or a carriage return."""
    data = whole(values)
    return b"\n" in data or b"\r" in data


def bgzf_block(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 18 + len(body) + 8
    if size > 1 << 16:  # not compressible: stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        size = 18 + len(body) + 8
    head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class Encoder:
    """Bytes in, encoded bytes out; finish() gives the rest."""

    def __init__(self, kind: str, level: int):
        self.kind, self.level, self.held = kind, level, bytearray()
        if kind == "gzip":
            self.packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        elif kind == "zstd":
            try:
                import zstandard
            except ImportError:
                raise ReadError("Unsupported", detail="zstd") from None
            self.packer = zstandard.ZstdCompressor(level=level).compressobj()

    def add(self, data: bytes) -> bytes:
        if self.kind == "plain":
            return data
        if self.kind != "bgzf":
            return self.packer.compress(data)
        self.held += data
        out = []
        while len(self.held) >= BLOCK:
            out.append(bgzf_block(bytes(self.held[:BLOCK]), self.level))
            del self.held[:BLOCK]
        return b"".join(out)

    def finish(self) -> bytes:
        if self.kind == "plain":
            return b""
        if self.kind != "bgzf":
            return self.packer.flush()
        return (bgzf_block(bytes(self.held), self.level) if self.held else b"") + BGZF_EOF


def output(path: str):
    """A new binary file by local path or URI; folders are made."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        return system.open_output_stream(inner)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return open(path, "wb")


def file_system(path: str):
    """(Arrow file system, path within it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def joined(parts: list[str], to: str, kind: str) -> None:
    """One file of the parts in order: every format can be concatenated, BGZF once inner end markers are left out."""
    with output(to) as out:
        for k, part in enumerate(parts):
            with opened(part) as f:
                f.seek(0, 2)
                size = f.tell() - (len(BGZF_EOF) if kind == "bgzf" and k + 1 < len(parts) else 0)
                f.seek(0)
                while size > 0 and (data := f.read(min(size, 1 << 20))):
                    out.write(data)
                    size -= len(data)
