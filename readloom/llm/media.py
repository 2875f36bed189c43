"""Media columns (operator 10): signature sniffing with Aho-Corasick and format validators.

One automaton locates the magic bytes of all formats in a binary value in one pass. At each hit the format's validator
walks the structure (chunks, blocks, segments, pages, lengths, checksums where the format has them) and returns the end, or rejects the
hit. The first valid hit at offset 0 is the value's type, which corrects a declared type that differs; valid hits elsewhere that no
earlier valid hit covers are carved as embedded media.

The query stores each text's bytes, padded with zeros to a positive multiple of 64, as 8-bit mono samples of a WAV file,
sniffs the stored bytes, which corrects their declared type, carves the samples out of the chunk that the validator found, and computes features of them. It also appends the stored
bytes to the text, and carves what media this value has: the whole text is searched for magic bytes, and words of it that look like some are rejected.

Results that the cases have: null values have no type and nothing embedded; empty values likewise; null and empty texts store 64
zero bytes; rows that repeat have the same result; extra columns are ignored; an empty table gives an empty result. Values are read whole; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, process_cache, text_of

#: Fixed values of public formats: (type, magic bytes, offset of the magic within the file).
MAGIC = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/bmp", b"BM", 0),
    ("audio/wav", b"WAVE", 8),
    ("image/webp", b"WEBP", 8),
    ("audio/ogg", b"OggS", 0),
    ("audio/flac", b"fLaC", 0),
    ("video/mp4", b"ftyp", 4),
)
RATE = 8000
BLOCK = 64
#: The type that stored values are declared to have before they are looked at.
DECLARED = "application/octet-stream"


def png_end(b: memoryview, at: int) -> int | None:
    place, first = at + 8, True
    while place + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, place)
        if (kind == b"IHDR") != first or place + 12 + n > len(b) or first and n != 13:
            return None
        if zlib.crc32(b[place + 4 : place + 8 + n]) != struct.unpack_from(">I", b, place + 8 + n)[0]:
            return None
        place, first = place + 12 + n, False
        if kind == b"IEND":
            return place
    return None


def jpeg_end(b: memoryview, at: int) -> int | None:
    place, frame = at + 2, False
    while place + 4 <= len(b):
        if b[place] != 0xFF:
            return None
        mark = b[place + 1]
        if mark == 0xFF:
            place += 1
            continue
        n = struct.unpack_from(">H", b, place + 2)[0]
        if mark in (0x00, 0xD8) or n < 2 or place + 2 + n > len(b):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        place += 2 + n
        if mark == 0xDA:  # entropy-coded data up to the next real marker
            if not frame:
                return None
            data = bytes(b[place:])
            k = 0
            while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data) and (data[k + 1] == 0 or 0xD0 <= data[k + 1] <= 0xD7):
                k += 2
            if k < 0 or k + 1 >= len(data):
                return None
            place += k
            if data[k + 1] == 0xD9:
                return place + 2
    return None


def gif_end(b: memoryview, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(k: int) -> int | None:
        while k < len(b):
            if not b[k]:
                return k + 1
            k += 1 + b[k]
        return None

    while place is not None and place < len(b):
        kind = b[place]
        if kind == 0x3B:
            return place + 1
        if kind == 0x21:
            place = blocks(place + 2)
        elif kind == 0x2C and place + 10 <= len(b):
            flags = b[place + 9]
            place = blocks(place + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return None
    return None


def bmp_end(b: memoryview, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    ok = reserved == 0 and header in (40, 52, 56, 108, 124) and 14 + header <= offset <= size and at + size <= len(b)
    return at + size if ok and struct.unpack_from("<H", b, at + 26)[0] == 1 else None


def riff_end(b: memoryview, at: int) -> int | None:
    """Chunks of a RIFF file: sizes must nest exactly, and a WAV file needs its format chunk before its data."""
    if at < 0 or at + 12 > len(b) or b[at : at + 4] != b"RIFF":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    place, seen = at + 12, []
    while place + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, place)
        if place + 8 + n > end or kind == b"data" and b"fmt " not in seen:
            return None
        seen.append(bytes(kind))
        place += 8 + n + n % 2
    wanted = b"data" if b[at + 8 : at + 12] == b"WAVE" else b"VP8"
    return end if place in (end, end + 1) and any(k.startswith(wanted) for k in seen) else None


def crc_table(poly: int, bits: int) -> list[int]:
    """Checksums of single bytes, most significant bit first."""
    out, top, most = [], 1 << bits - 1, (1 << bits) - 1
    for byte in range(256):
        x = byte << bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & most
        out.append(x)
    return out


#: Fixed values of the formats: the polynomials of their checksums. That of Ogg is the one of zlib, over bits in the other order.
FLAC_HEAD_CRC, FLAC_CRC = crc_table(0x07, 8), crc_table(0x8005, 16)
TURNED = bytes(int(f"{byte:08b}"[::-1], 2) for byte in range(256))


def ogg_page(b: memoryview, at: int) -> tuple[int, int, int] | None:
    """(end, flags, serial number) of the page that starts here with its checksum."""
    if at + 27 > len(b) or b[at : at + 4] != b"OggS" or b[at + 4]:
        return None
    end = at + 27 + b[at + 26] + sum(b[at + 27 : at + 27 + b[at + 26]])
    if end > len(b):
        return None
    page = b"".join((b[at : at + 22], bytes(4), b[at + 26 : end])).translate(TURNED)
    crc = int(f"{zlib.crc32(page, 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)
    return (end, b[at + 5], struct.unpack_from("<I", b, at + 14)[0]) if crc == struct.unpack_from("<I", b, at + 22)[0] else None


def ogg_end(b: memoryview, at: int, pages: dict | None = None) -> int | None:
    """Pages from one that begins a stream up to where all streams that were begun have ended. pages remembers those that were checked, so that each is checked once."""
    pages, place, open_ = {} if pages is None else pages, at, set()
    while True:
        if place not in pages:
            pages[place] = ogg_page(b, place)
        if pages[place] is None:
            return None
        place, flags, serial = pages[place]
        if flags & 2:
            open_.add(serial)
        elif serial not in open_:
            return None
        if flags & 4:
            open_.discard(serial)
            if not open_:
                return place


def flac_frame(b: memoryview, at: int) -> tuple[int, int] | None:
    """(samples, end of the header) of the frame whose header stands here with its checksum."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    lead = b[at + 4]
    number = 1 if lead < 0x80 else next((n for n in range(2, 8) if lead >> 7 - n == (1 << n + 1) - 2), 0)
    place = at + 4 + number
    more = {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or rate == 15 or b[at + 3] & 1 or b[at + 3] >> 4 > 10 or not number or place + more + 1 > len(b):
        return None
    samples = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8 if size > 7 else int.from_bytes(b[place : place + size - 5], "big") + 1
    crc = 0
    for byte in b[at : place + more]:
        crc = FLAC_HEAD_CRC[crc ^ byte]
    return (samples, place + more + 1) if crc == b[place + more] else None


def flac_end(b: memoryview, at: int) -> int | None:
    """Metadata blocks, then frames up to the samples that the first block names, or as far as frames go where it names none.

    A frame ends where its checksum holds and the next frame's header or, after the last one, anything follows.
    """
    place, first, total = at + 4, True, 0
    while place + 4 <= len(b):
        head = struct.unpack_from(">I", b, place)[0]
        kind, n = head >> 24 & 0x7F, head & 0xFFFFFF
        if first and (kind, n) != (0, 34) or kind > 6 or place + 4 + n > len(b):
            return None
        if first:
            total = int.from_bytes(b[place + 14 : place + 22], "big") & (1 << 36) - 1
        place, first = place + 4 + n, False
        if head >> 31:
            break
    else:
        return None
    seen, frame = 0, flac_frame(b, place)
    while frame is not None:
        samples, k = frame
        crc, end = 0, None
        for byte in b[place:k]:
            crc = crc << 8 & 0xFFFF ^ FLAC_CRC[crc >> 8 ^ byte]
        while k < len(b):
            crc = crc << 8 & 0xFFFF ^ FLAC_CRC[crc >> 8 ^ b[k]]
            k += 1
            if not crc:
                end, frame = k if end is None else end, flac_frame(b, k)
                if frame is not None or total and seen + samples >= total:
                    end = k
                    break
        if end is None:
            return None
        seen, place = seen + samples, end
        if total and seen >= total:
            return place
    return place if seen and not total else None


def mp4_end(b: memoryview, at: int) -> int | None:
    place, kinds = at, []
    while at >= 0 and place + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, place)
        if n == 1 and place + 16 <= len(b):
            n = struct.unpack_from(">Q", b, place + 8)[0]
        if n < 8 or place + n > len(b) or not bytes(kind).isalnum():
            break
        kinds.append(bytes(kind))
        place += n
    return place if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


END = {
    "image/png": png_end, "image/jpeg": jpeg_end, "image/gif": gif_end, "image/bmp": bmp_end, "audio/wav": riff_end,
    "image/webp": riff_end, "audio/ogg": ogg_end, "audio/flac": flac_end, "video/mp4": mp4_end,
}


def automaton():
    out = ahocorasick.Automaton()
    for kind, magic, offset in MAGIC:
        out.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
    out.make_automaton()
    return out


def sniff(value: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of the valid media in a value, in order of start; those inside earlier ones are left out."""
    finder, view = process_cache("magic", automaton), memoryview(value)
    hits = sorted((last - n + 1 - offset, kind) for last, (kind, n, offset) in finder.iter(value.decode("latin-1")))
    out, free, pages = [], 0, {}
    for start, kind in hits:
        if start >= free and (end := ogg_end(view, start, pages) if kind == "audio/ogg" else END[kind](view, start)):
            out.append((start, end, kind))
            free = end
    return out


def sniffed(batches):
    for batch in batches:
        rows = []
        for value, declared in zip(batch["_value"], batch["_declared"], strict=True):
            found = sniff(value.as_py() or b"")
            whole = found[0] if found and found[0][0] == 0 else None
            rest = found[1:] if whole else found
            kind = whole[2] if whole else None
            rows.append({
                "type": kind, "corrected": kind is not None and declared.as_py() is not None and declared.as_py() != kind, "length": whole[1] if whole else None,
                "embedded": [{"start": s, "end": e, "type": k, "sha256": hashlib.sha256(value.as_py()[s:e]).hexdigest()} for s, e, k in rest],
            })
        embedded = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))
        kind = pa.struct([("type", pa.string()), ("corrected", pa.bool_()), ("length", pa.int64()), ("embedded", embedded)])
        yield pa.RecordBatch.from_pydict({"_id": batch["_id"], "media": pa.array(rows, kind)})


MEDIA = "struct<type:string,corrected:boolean,length:bigint,embedded:array<struct<start:bigint,end:bigint,type:string,sha256:string>>>"


def media_types(table: DataFrame, id_col: str, value_col: str, declared_col: str | None = None) -> DataFrame:
    """One row a value: (id_col, media) with its true type, whether it corrects the declared one, its length and what it embeds."""
    declared = col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    rows = table.select(col(id_col).alias("_id"), col(value_col).cast("binary").alias("_value"), declared.alias("_declared"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(sniffed, f"_id {kind}, media {MEDIA}").select(F.col("_id").alias(id_col), "media")


def wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + pad


def wav_samples(value: bytes, start: int, end: int) -> bytes:
    """The samples in a WAV file that the validator has accepted."""
    place = start + 12
    while place + 8 <= end:
        kind, n = struct.unpack_from("<4sI", value, place)
        if kind == b"data":
            return value[place + 8 : place + 8 + n]
        place += 8 + n + n % 2
    raise ValueError("no data chunk")


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def features(samples: bytes) -> str:
    """Duration, level, spread and zero crossings of the samples around the middle value."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, values = len(x), np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
    return f"wav;rate={RATE};frames={n};sum={total};squares={squares};low={int(x.min())};high={int(x.max())};crossings={crossings}"


def stored(batches):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n", "p", "psha", "tail", "m", "msha", "feature", "kind", "corrected", "embedded")}
        for text in batch["_text"]:
            data = text.as_py().encode("utf-8")
            value = wav(padded(data))
            found = [x for x in sniff(value) if x[0] == 0]
            if [x[1:] for x in found] != [(len(value), "audio/wav")]:
                raise ValueError("a stored value does not read back as one WAV file")
            back = wav_samples(value, *found[0][:2])
            carved = ",".join(f"{s}:{e}:{k}:{hashlib.sha256(memoryview(carrier)[s:e]).hexdigest()}" for carrier in (data + value,) for s, e, k in sniff(carrier))
            digests = hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(value), hashlib.sha256(value).hexdigest()
            for k, v in zip(out, (len(data), len(back), *digests, features(back), found[0][2], found[0][2] != DECLARED, carved), strict=True):
                out[k].append(v)
        types = {"psha": pa.string(), "msha": pa.string(), "feature": pa.string(), "kind": pa.string(), "embedded": pa.string(), "corrected": pa.bool_()}
        yield pa.RecordBatch.from_pydict({"_id": batch["_id"]} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: what its stored form reads back as, with digests and features; its type by content and whether that corrects DECLARED; and the media, as
    start:end:type:sha256 joined by commas, that the text with its stored form after it embeds."""
    rows = docs.select(col(id_col).alias("_id"), text_of(docs, text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(stored, f"_id {kind}, n bigint, p bigint, psha string, tail bigint, m bigint, msha string, feature string, kind string, corrected boolean, embedded string")
    names = (id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "embedded")
    return out.toDF(*names)


def op10_media(spark, sf_dir: str) -> DataFrame:
    return stored_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
