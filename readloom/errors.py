"""What can be wrong with reads: one exception with a variant, a kind and a place, and its text."""

from __future__ import annotations

import re

# The texts of the kinds of invalid input, as users of the format's tools know them.
KINDS = {
    "HeaderMissingAt": "header line does not start with '@'",
    "PlusMissing": "separator line does not start with '+'",
    "GzipHeader": "malformed gzip header",
    "GzipData": "corrupt deflate stream",
    "GzipTrailerCrc": "gzip CRC32 mismatch",
    "GzipTrailerIsize": "gzip ISIZE mismatch",
    "GzipTruncated": "gzip stream ends mid-member",
    "SeqLineEmpty": "empty sequence line",
    "QualLineEmpty": "empty quality line",
    "BgzfHeader": "malformed BGZF block header",
    "BgzfBlock": "malformed BGZF block",
    "BgzfVirtualOffset": "virtual offset does not address a BGZF block",
    "BgzfBlockTooLarge": "BGZF block exceeds 64 KiB of uncompressed data",
    "BgzfBlockCrc": "BGZF block CRC32 mismatch",
    "BgzfBlockIsize": "BGZF block ISIZE mismatch",
    "BgzfMissingEofMarker": "BGZF end-of-file marker is missing",
    "BufferOverflow": "decompression buffer overflow",
    "HeaderContainsNewline": "header contains a line break",
    "SeqContainsNewline": "sequence contains a line break",
    "QualContainsNewline": "qualities contain a line break",
}

#: Kinds beyond those: containers whose decoder says no more.
KINDS |= {"ZstdData": "corrupt zstd frame", "ZstdTruncated": "zstd stream ends within a frame"}

#: The fields of an error as a column.
FIELDS = ("variant", "kind", "offset", "record", "seq_len", "qual_len", "byte")
SCHEMA = "variant string, kind string, offset bigint, record bigint, seq_len bigint, qual_len bigint, byte int"


def shown(byte: int) -> str:
    return f"'{chr(byte)}'" if 0x21 <= byte <= 0x7E else "non-printable"


class ReadError(ValueError):
    """variant: InvalidFormat, UnexpectedEof, LengthMismatch, InvalidBase, InvalidQuality, PairedCountMismatch, PairedIdMismatch, Unsupported.

    offset is the place in the decoded stream, record counts from 1 and is 0 where unknown. Ids that differ come with `offsets` and `ids` of both mates.
    """

    def __init__(
        self, variant: str, offset: int = 0, record: int = 0, kind: str | None = None, seq_len: int | None = None, qual_len: int | None = None, byte: int | None = None,
        detail: str = "", offsets: tuple[int, int] | None = None, ids: tuple[str, str] | None = None,
    ):
        self.variant, self.kind, self.offset, self.record = variant, kind, offset, record
        self.seq_len, self.qual_len, self.byte, self.detail = seq_len, qual_len, byte, detail
        self.offsets, self.ids = offsets, ids
        super().__init__(self.text())

    def __reduce__(self):
        return ReadError, (self.variant, self.offset, self.record, self.kind, self.seq_len, self.qual_len, self.byte, self.detail, self.offsets, self.ids)

    def text(self) -> str:
        at, nth = f"at offset {self.offset}", f" (record {self.record})" if self.record else ""
        return {
            "InvalidFormat": f"invalid FASTQ {at}{nth}: {KINDS.get(self.kind or '', self.kind)}",
            "UnexpectedEof": f"unexpected end of input {at}{nth}",
            "LengthMismatch": f"sequence/quality length mismatch {at}{nth}: seq_len={self.seq_len}, qual_len={self.qual_len}",
            "InvalidBase": f"invalid base byte 0x{self.byte or 0:02x} ({shown(self.byte or 0)}) {at}{nth}",
            "InvalidQuality": f"invalid quality byte 0x{self.byte or 0:02x} ({shown(self.byte or 0)}) {at}{nth}",
            "PairedCountMismatch": f"paired-end files hold different numbers of records: {self.detail} ended first{nth}",
            "PairedIdMismatch": f"paired-end read ID mismatch{nth}: {self.detail}",
            "Unsupported": f"unsupported operation: {self.detail}",
        }[self.variant]

    def numbered(self, record: int) -> ReadError:
        """The same error with its record, if it has none yet."""
        return self if self.record else self.moved(0, record)

    def moved(self, by: int, record: int | None = None) -> ReadError:
        """The same error further on in the stream."""
        return ReadError(self.variant, self.offset + by, self.record if record is None else record, self.kind, self.seq_len, self.qual_len, self.byte, self.detail, self.offsets, self.ids)

    def row(self) -> dict:
        return {k: getattr(self, k) for k in FIELDS}


def invalid(kind: str, offset: int) -> ReadError:
    return ReadError("InvalidFormat", offset, kind=kind)


def parsed(message: str) -> ReadError | None:
    """The error in a message that Spark passes on from a Python worker; None if there is none."""
    number = r" at offset (\d+)(?: \(record (\d+)\))?"
    if m := re.search(rf"invalid FASTQ{number}: ([^\n]+)", message):
        kind = next((k for k, text in KINDS.items() if m[3].startswith(text)), m[3])
        return ReadError("InvalidFormat", int(m[1]), int(m[2] or 0), kind)
    if m := re.search(rf"unexpected end of input{number}", message):
        return ReadError("UnexpectedEof", int(m[1]), int(m[2] or 0))
    if m := re.search(rf"length mismatch{number}: seq_len=(\d+), qual_len=(\d+)", message):
        return ReadError("LengthMismatch", int(m[1]), int(m[2] or 0), seq_len=int(m[3]), qual_len=int(m[4]))
    if m := re.search(rf"invalid (base|quality) byte 0x([0-9a-f]+) \([^)]*\){number}", message):
        return ReadError("InvalidBase" if m[1] == "base" else "InvalidQuality", int(m[3]), int(m[4] or 0), byte=int(m[2], 16))
    if m := re.search(r"different numbers of records: (R[12]) ended first(?: \(record (\d+)\))?", message):
        return ReadError("PairedCountMismatch", 0, int(m[2] or 0), detail=m[1])
    if m := re.search(r"read ID mismatch(?: \(record (\d+)\))?: ([^\n]+)", message):
        return ReadError("PairedIdMismatch", 0, int(m[1] or 0), detail=m[2])
    if m := re.search(r"unsupported operation: ([^\n]+)", message):
        return ReadError("Unsupported", detail=m[1])
    return None
