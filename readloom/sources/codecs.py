"""Compressed containers: recognised by content, decoded with every checksum verified."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

from ..errors import ReadError, invalid

# Fixed values of public formats.
BGZF_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAGIC = {b"\x28\xb5\x2f\xfd": "zstd", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz"}
SNIFFED = 128
CHUNK = 1 << 20
#: Bytes of a BGZF block at most, and decoded blocks that are kept for those who ask for them again.
MOST_BLOCK, NEAR = 1 << 16, 8
#: Compressed bytes that zstd decodes at once: its output for them is held whole.
ZSTD_STEP = 1 << 16


def opened(path: str):
    """A binary file by local path or by any URI that Arrow's file systems know."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return io.BufferedReader(system.open_input_file(inner), CHUNK)
    return open(path, "rb")


def size_of(path: str) -> int:
    with opened(path) as f:
        f.seek(0, 2)
        return f.tell()


def subfield(extra: bytes) -> int | None:
    """The block size that a BGZF extra field gives; None if it is not one."""
    at = 0
    while at + 4 <= len(extra):
        name, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if name == b"BC" and n == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    return None


def sniff(head: bytes) -> str:
    """plain, gzip, bgzf, zstd, bzip2 or xz, from a file's first bytes."""
    for magic, kind in MAGIC.items():
        if head.startswith(magic):
            return kind
    if not head.startswith(b"\x1f\x8b"):
        return "plain"
    if len(head) < 12 or not head[3] & 4:
        return "gzip"
    n = struct.unpack_from("<H", head, 10)[0]
    return "bgzf" if subfield(head[12 : 12 + n]) else "gzip"


class Feed:
    """Bytes from an iterator of chunks, taken by need."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data = chunks, b""

    def more(self) -> bool:
        got = next(self.chunks, b"")
        self.data += got
        return bool(got)

    def need(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.more():
                return False
        return True


def gzip_header(feed: Feed, at: int) -> None:
    """Drops a member's header."""
    if not feed.need(10):
        raise invalid("GzipTruncated", at)
    if feed.data[2] != 8 or feed.data[3] & 0xE0:
        raise invalid("GzipHeader", at)
    flags, end = feed.data[3], 10
    if flags & 4:
        if not feed.need(end + 2):
            raise invalid("GzipTruncated", at)
        end += 2 + struct.unpack_from("<H", feed.data, end)[0]
    for flag in (8, 16):
        if flags & flag:
            while (stop := feed.data.find(b"\0", end)) < 0:
                if not feed.more():
                    raise invalid("GzipTruncated", at)
            end = stop + 1
    end += 2 if flags & 2 else 0
    if not feed.need(end):
        raise invalid("GzipTruncated", at)
    feed.data = feed.data[end:]


def gunzipped(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Decoded bytes of all members; NUL padding is skipped, other trailing bytes end the stream."""
    feed, at = Feed(chunks), 0
    while True:
        while True:
            feed.data = feed.data.lstrip(b"\0")
            if feed.data or not feed.more():
                break
        if not feed.need(2) or feed.data[:2] != b"\x1f\x8b":
            return
        gzip_header(feed, at)
        inflater, crc, size = zlib.decompressobj(-15), 0, 0
        while not inflater.eof:
            if not feed.data and not feed.more():
                raise invalid("GzipTruncated", at)
            try:
                out = inflater.decompress(feed.data, CHUNK)
            except zlib.error:
                raise invalid("GzipData", at) from None
            feed.data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
            if out:
                crc, size, at = zlib.crc32(out, crc), size + len(out), at + len(out)
                yield out
        if not feed.need(8):
            raise invalid("GzipTruncated", at)
        want_crc, want_size = struct.unpack_from("<II", feed.data)
        if crc != want_crc:
            raise invalid("GzipTrailerCrc", at)
        if size & 0xFFFFFFFF != want_size:
            raise invalid("GzipTrailerIsize", at)
        feed.data = feed.data[8:]


def block_size(head: bytes) -> int | None:
    """Size of the BGZF block that starts with head (18 bytes or more where the file has them)."""
    if len(head) < 18 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    n = struct.unpack_from("<H", head, 10)[0]
    size = subfield(head[12 : 12 + n])
    return size if size and size >= 12 + n + 8 and size >= 26 else None


def bgzf_block(block: bytes, at: int) -> bytes:
    """A block's bytes: length verified first, then CRC. at is the decoded offset, for errors."""
    n = struct.unpack_from("<H", block, 10)[0]
    crc, size = struct.unpack_from("<II", block, len(block) - 8)
    if size > 1 << 16:
        raise invalid("BgzfBlockTooLarge", at)
    inflater = zlib.decompressobj(-15)
    try:
        out = inflater.decompress(block[12 + n : -8], (1 << 16) + 1)
    except zlib.error:
        raise invalid("BgzfBlock", at) from None
    if not inflater.eof:
        raise invalid("BgzfBlock" if len(out) <= 1 << 16 else "BgzfBlockTooLarge", at)
    if len(out) != size:
        raise invalid("BgzfBlockIsize", at)
    if zlib.crc32(out) != crc:
        raise invalid("BgzfBlockCrc", at)
    return out


def marked(path: str) -> bool:
    """Whether a BGZF file ends with the end marker."""
    with opened(path) as f:
        f.seek(max(0, f.seek(0, 2) - len(BGZF_EOF)))
        return f.read() == BGZF_EOF


def block_at(f, at: int, total: int) -> int | None:
    """Size of the block that starts at this place of an open file; None if none does."""
    f.seek(at)
    head = f.read(18)
    if len(head) >= 12:
        head += f.read(max(0, 12 + struct.unpack_from("<H", head, 10)[0] - len(head)))
    size = block_size(head)
    return size if size is not None and at + size <= total else None


def next_block(path: str, place: int, near: dict | None = None) -> int | None:
    """The first block that starts at or after a byte of a BGZF file; None if none does.

    A place counts if it has a block's header, the file or another block ends there, and its content decodes with the right length and CRC:
    the bytes within a block do not pass for one. near has blocks that were decoded lately.
    """
    if place == 0:
        return 0
    total, at = size_of(path), place
    with opened(path) as f:
        while at < total:
            f.seek(at)
            data = f.read(2 * MOST_BLOCK)
            k = -1
            while (k := data.find(b"\x1f\x8b\x08", k + 1)) >= 0:
                size = block_at(f, at + k, total)
                if size is None or at + k + size < total and block_at(f, at + k + size, total) is None:
                    continue
                if near is not None and at + k in near:
                    return at + k
                f.seek(at + k)
                try:
                    out = bgzf_block(f.read(size), 0)
                except ReadError:
                    continue
                keep(near, at + k, size, out)
                return at + k
            at += max(1, len(data) - 2)
            if len(data) < 3:
                return None
    return None


def decoded_span(path: str, start: int, end: int) -> int:
    """Decoded bytes of the blocks from one place to another, by their headers and trailers alone."""
    found = 0
    with opened(path) as f:
        total = f.seek(0, 2)
        while start < end:
            size = block_at(f, start, total)
            if size is None:
                break
            f.seek(start + size - 4)
            found += struct.unpack("<I", f.read(4))[0]
            start += size
    return found


def keep(near: dict | None, at: int, size: int, out: bytes) -> None:
    """Notes a decoded block among the few that were decoded lately."""
    if near is not None:
        near[at] = size, out
        if len(near) > NEAR:
            del near[next(iter(near))]


def bgzf_blocks(path: str, start: int, decoded: int, near: dict | None = None) -> Iterator[tuple[int, bytes]]:
    """(compressed offset, bytes) of each block from `start`, which has `decoded` bytes before it."""
    with opened(path) as f:
        f.seek(start)
        yield from blocks_of(f, start, decoded, near)


def blocks_of(f, start: int = 0, decoded: int = 0, near: dict | None = None) -> Iterator[tuple[int, bytes]]:
    """The blocks of an open file from where it stands; near has some that were decoded lately."""
    while True:
        if near is not None and (known := near.get(start)):
            size, out = known
            f.seek(start + size)
            yield start, out
            start, decoded = start + size, decoded + len(out)
            continue
        head = f.read(18)
        if not head:
            return
        if len(head) >= 12:
            head += f.read(max(0, 12 + struct.unpack_from("<H", head, 10)[0] - len(head)))
        size = block_size(head)
        if size is None:
            raise invalid("BgzfHeader", decoded)
        block = head + f.read(size - len(head))
        if len(block) < size:
            raise invalid("BgzfBlock", decoded)
        out = bgzf_block(block, decoded)
        keep(near, start, size, out)
        yield start, out
        start, decoded = start + size, decoded + len(out)


def unblocked(value: bytes) -> Iterator[bytes]:
    """Decoded bytes of a BGZF value in memory, whose end marker must be there."""
    size = 0
    for _, data in blocks_of(io.BytesIO(value)):
        size += len(data)
        yield data
    if not value.endswith(BGZF_EOF):
        raise invalid("BgzfMissingEofMarker", size)


def file_chunks(path: str, start: int = 0, step: int = CHUNK) -> Iterator[bytes]:
    with opened(path) as f:
        f.seek(start)
        while data := f.read(step):
            yield data


def growing_chunks(path: str, start: int, step: int) -> Iterator[bytes]:
    """A file's bytes by pieces that become larger."""
    with opened(path) as f:
        f.seek(start)
        while data := f.read(step):
            yield data
            step = min(2 * step, CHUNK)


def unzstd(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Decoded bytes of all frames; what the library refuses, and an end within a frame, is an error of this container."""
    try:
        import zstandard
    except ImportError:
        raise ReadError("Unsupported", detail="zstd") from None
    at, frame = 0, None
    for data in chunks:
        while data:
            frame = frame or zstandard.ZstdDecompressor().decompressobj()
            try:
                out = frame.decompress(data)
            except zstandard.ZstdError:
                raise invalid("ZstdData", at) from None
            data = frame.unused_data if frame.eof else b""
            frame = None if frame.eof else frame
            at += len(out)
            if out:
                yield out
    if frame:
        raise invalid("ZstdTruncated", at)


def decoded_chunks(path: str, kind: str) -> Iterator[bytes]:
    """The whole decoded stream of a file."""
    if kind in ("bzip2", "xz"):
        raise ReadError("Unsupported", detail=kind)
    if kind == "zstd":
        return unzstd(file_chunks(path, step=ZSTD_STEP))
    if kind == "bgzf":
        return (b for _, b in bgzf_blocks(path, 0, 0))
    return gunzipped(file_chunks(path)) if kind == "gzip" else file_chunks(path)
