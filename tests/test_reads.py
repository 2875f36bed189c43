"""Framing, codecs, splits, sinks, pairs and errors of reads, on small inputs written here."""

import gzip
import itertools
import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom import errors
from readloom.api import error_of, parse_bytes, read_interleaved, read_pairs, read_reads, read_totals, starts_record, write_reads
from readloom.functions import columns as C
from readloom.operators import reads as R
from readloom.sources import codecs, fastq, framing, sinks


def records(data: bytes, wrapped: bool = False, piece: int = 7):
    """(records, error) of bytes that arrive in small pieces."""
    out, error = [], None
    for got in framing.framed((data[k : k + piece] for k in range(0, len(data), piece)), 0, wrapped):
        out += zip(*map(got.values, framing.FIELDS), strict=True)
        error = got.error
    return out, error


def shape(e):
    return e and (e.variant, e.kind, e.offset, e.record)


# Small inputs that every reader of this format must accept or refuse alike, and where.
@pytest.mark.parametrize(
    ("data", "wrapped", "want", "error"),
    [
        (b"@r1\nACGT\n+\n!!!!\n@r2\nTT\n+\n##\n", False, [b"ACGT", b"TT"], None),
        (b"@a\nACGT\n+\n!!!!\n@b\nTT\n+\n##", False, [b"ACGT", b"TT"], None),
        (b"@a\n\n+\n\n@b\nGT\n+\n##\n", False, [b"", b"GT"], None),
        (b"\n@a\nAC\n+\n!!\n\n\n@b\nGT\n+\n##\n\n", False, [b"AC", b"GT"], None),
        (b"@a\r\nACGT\r\n+\r\n!!!!\r\n@b\r\nTT\r\n+\r\n##\r\n", False, [b"ACGT", b"TT"], None),
        (b"@a desc\nACGT\n+a desc\n!!!!\n", False, [b"ACGT"], None),
        (b"r1\nACGT\n+\n!!!!\n", False, [], ("InvalidFormat", "HeaderMissingAt", 0, 1)),
        (b"@r1\nACGT\nx\n!!!!\n", False, [], ("InvalidFormat", "PlusMissing", 9, 1)),
        (b"@r1\nACGT\n+\n!!!\n", False, [], ("LengthMismatch", None, 11, 1)),
        (b"@r1\nACGT\n+\n", False, [], ("UnexpectedEof", None, 11, 1)),
        (b"@a\nAC\n+\n!!\n@b\nGT\n+\n##\n@c\nACGT\n+\n!!\n", False, [b"AC", b"GT"], ("LengthMismatch", None, 32, 3)),
        (b"@r1\nACGT\nN\n+\n!!!!\n!\n@r2\nTT\nGG\n+\n##\n!!\n", True, [b"ACGTN", b"TTGG"], None),
        (b"\n@a\nAC\nGT\n+\n!!\n!!\n\n@b\nTT\n+\n##", True, [b"ACGT", b"TT"], None),
        (b"@r1\nACGT\nN\n", True, [], ("UnexpectedEof", None, 11, 1)),
        (b"@r1\nAC\nGT\n+\n!!!!\n!!\n", True, [b"ACGT"], ("InvalidFormat", "HeaderMissingAt", 17, 2)),
        (b"@a\n+\n\n@b\nA\n+\n!\n", True, [b"", b"A"], None),
        (b"@a\n\n+\n\n", True, [], ("InvalidFormat", "SeqLineEmpty", 3, 1)),
        (b"", False, [], None),
        (b"@a\nA\n+\n!\n\r", False, [b"A"], None),
    ],
)
def test_framing(data, wrapped, want, error):
    got, e = records(data, wrapped)
    assert [r[1] for r in got] == want
    assert shape(e) == error


def generated(seed: int, n: int = 60):
    rng, out, data = random.Random(seed), [], b""
    for k in range(n):
        size = rng.randrange(200)
        seq, qual = (bytes(rng.choice(c) for _ in range(size)) for c in (b"ACGTN", range(33, 93)))
        out.append((b"r%d" % k, seq, qual))
        data += b"@r%d\n%b\n+%b\n%b\n" % (k, seq, b"r%d" % k if rng.random() < 0.4 else b"", qual) + b"\n" * (rng.random() < 0.2)
    return out, data[:-1] if data.endswith(b"\n") and rng.random() < 0.5 and out[-1][2] else data


def stored(path, data: bytes, kind: str, block: int = 997) -> None:
    path.write_bytes(data if kind == "plain" else b"".join(sinks.bgzf_block(data[k : k + block], 6) for k in range(0, len(data), block)) + codecs.BGZF_EOF)


def scanned(path, **options):
    o = fastq.Options({k: str(v) for k, v in options.items()})
    return [r for s in fastq.planned(str(path), o) for b in fastq.batches(s, o) for r in zip(*(b[c].to_pylist() for c in ("header", "seq", "qual")), strict=True)]


@pytest.mark.parametrize("kind", ["plain", "bgzf"])
def test_every_split_size_gives_the_same_reads(tmp_path, kind):
    want, data = generated(5)
    stored(tmp_path / "reads", data, kind)
    for size in [*range(1, 120, 7), 500, 1000, 4096, 1 << 20]:
        assert scanned(tmp_path / "reads", splitSize=size) == want, size

def test_a_window_that_ends_with_the_file_counts_no_line_less(tmp_path, monkeypatch):
    data = b"".join(b"@r%d\nACG\n+\nIII\n" % k + b"\n" * (k % 3 == 0) for k in range(7))
    (tmp_path / "x").write_bytes(data)
    monkeypatch.setattr(framing, "WINDOW", 64)
    for size in range(5, len(data) + 2):
        o = fastq.Options({"splitSize": str(size), "summary": "true"})
        assert sum(b["lines"][0].as_py() for s in fastq.planned(str(tmp_path / "x"), o) for b in fastq.batches(s, o)) == data.count(b"\n"), size

@pytest.mark.parametrize("kind", ["plain", "bgzf"])
@pytest.mark.parametrize("wrapped", [False, True])
def test_splits_read_in_a_run_are_those_read_alone(tmp_path, kind, wrapped):
    want, data = generated(21, 80)
    if wrapped:
        want = [r for r in want if r[1]]
        data = b"".join(b"@%b\n%b\n+\n%b\n" % (h, b"\n".join(s[i : i + 30] for i in range(0, len(s), 30)), b"\n".join(q[i : i + 30] for i in range(0, len(q), 30))) for h, s, q in want)
    stored(tmp_path / "x", data, kind)
    if kind == "bgzf":  # one block is damaged
        raw = bytearray((tmp_path / "x").read_bytes())
        raw[[c for c, _ in codecs.bgzf_blocks(str(tmp_path / "x"), 0, 0)][9] - 8] ^= 1
        (tmp_path / "x").write_bytes(raw)
    for size in (50, 333, 700, 2000, 1 << 20):
        o = fastq.Options({"splitSize": str(size), "mode": "permissive", "format": "multiline" if wrapped else "single"})
        alone = [r for s in fastq.planned(str(tmp_path / "x"), o) for b in fastq.batches(s, o) for r in b.to_pylist()]
        runs = list(fastq.laid(str(tmp_path / "x"), o).cut(1500))
        assert [r for run in runs for b in fastq.run_batches(run, o) for r in b.to_pylist()] == alone, size
        assert len({r["split_id"] for r in alone}) > 3 or size > 700
        assert (len(alone) == len(want)) == (kind == "plain")


def test_small_splits_are_few_tasks(tmp_path):
    with open(tmp_path / "x", "wb") as f:
        f.truncate(20 << 30)  # without bytes on disk
    runs = fastq.Reader({"path": str(tmp_path / "x"), "splitSize": str(1 << 16)}).partitions()
    assert len(runs) == 320
    assert sum(r.count for r in runs) == (20 << 30) >> 16


@pytest.mark.parametrize("kind", ["plain", "bgzf"])
@pytest.mark.parametrize("wrapped", [False, True])
def test_reads_longer_than_splits(tmp_path, kind, wrapped):
    rng, want, data = random.Random(11), [], b""
    for k in range(12):  # qualities that look like headers, reads up to a megabyte
        n = rng.choice((100, 60_000, 400_000, 1_000_000))
        seq, qual = b"ACGT" * (n // 4), b"@" + b"I@+J" * (n // 4 - 1) + b"II@"
        want.append((b"r%d" % k, seq, qual))
        width = 70_001 if wrapped else n
        data += b"@r%d\n%b\n+\n%b\n" % (k, b"\n".join(seq[i : i + width] for i in range(0, n, width)), b"\n".join(qual[i : i + width] for i in range(0, n, width)))
    stored(tmp_path / "reads", data, kind, 60_000)
    for size in (1 << 21, 1 << 20, 300_000, 100_001):
        if kind == "bgzf":
            size //= 100  # these bytes compress well
        assert scanned(tmp_path / "reads", splitSize=size, format="multiline" if wrapped else "single") == want, size


def test_resync_and_shape(tmp_path):
    want, data = generated(8)
    at = [k for k in range(0, len(data), 97)]
    for kind in ("plain", "bgzf"):
        stored(tmp_path / kind, data, kind, 500)
    o = fastq.Options({})
    heads = [x for s in fastq.planned(str(tmp_path / "plain"), o) for b in fastq.batches(s, o) for x in b["header_offset"].to_pylist()]
    for offset in at:
        left = [r for r, h in zip(want, heads, strict=True) if h >= offset]
        assert scanned(tmp_path / "plain", startOffset=offset, resync="true") == left
        assert starts_record(str(tmp_path / "plain"), offset) == (offset in heads)
    assert all(starts_record(str(tmp_path / "plain"), h) for h in heads)
    block = next(c for c in codecs.bgzf_blocks(str(tmp_path / "bgzf"), 0, 0) if c[0])[0]
    assert scanned(tmp_path / "bgzf", startOffset=(block << 16) + 40, resync="true") == [r for r, h in zip(want, heads, strict=True) if h >= 540]
    # an exact offset is never moved
    with pytest.raises(errors.ReadError, match="does not start with '@'"):
        scanned(tmp_path / "plain", startOffset=heads[3] + 1)


def test_quality_before_headers_of_equal_length(tmp_path):
    data = b"@r1\nTTTT\n+\n@AAA\n@r2\nTTTT\n+\nBBBB\n@r3\nAC\n+\nII\n"
    stored(tmp_path / "x", data, "plain")
    for size in range(1, len(data)):
        for shape in ("single", "multiline"):
            assert [r[0] for r in scanned(tmp_path / "x", splitSize=size, format=shape)] == [b"r1", b"r2", b"r3"]


def test_damaged_bytes_never_crash_and_errors_lie_ahead(tmp_path):
    rng, (_, data) = random.Random(12), generated(9, 30)
    for k in range(150):
        bad = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(len(bad))] = rng.choice(b"@+\n\rA\0")
        kind = ("plain", "bgzf")[k % 2]
        stored(tmp_path / "x", bytes(bad), kind, 300)
        raw = bytearray((tmp_path / "x").read_bytes())
        if k % 3 == 0:
            raw[rng.randrange(len(raw))] ^= 1 << rng.randrange(8)
            (tmp_path / "x").write_bytes(raw)
        o = fastq.Options({"mode": "permissive", "splitSize": str(rng.choice((50, 400, 1 << 20)))})
        for s in fastq.planned(str(tmp_path / "x"), o):
            before = -1
            for b in fastq.batches(s, o):
                for h, e in zip(b["header_offset"].to_pylist(), b["error"].to_pylist(), strict=True):
                    if e is None:
                        assert h > before
                        before = h
                    else:
                        assert 0 <= e["offset"] <= max(len(bad), len(raw)) + 1 and (s.kind == "bgzf" or e["offset"] >= before)


def told(path, **options):
    """(rows before the first error, that error, errors in all), split by split."""
    o = fastq.Options({k: str(v) for k, v in options.items()})
    rows, first, errors_met = [], None, 0
    for s in fastq.planned(str(path), o):
        try:
            for b in fastq.batches(s, o):
                for h, e in zip(b["header"].to_pylist(), b["error"].to_pylist() if "error" in b.schema.names else [None] * b.num_rows, strict=True):
                    errors_met += e is not None
                    if e is not None and first is None:
                        first = (e["variant"], e["kind"], e["offset"])
                    elif first is None:
                        rows.append(h)
        except errors.ReadError as e:
            return rows, (e.variant, e.kind, e.offset, e.record), 1
    return rows, first, errors_met


@pytest.mark.parametrize("what", ["crc", "data", "header", "size"])
@pytest.mark.parametrize("wrapped", [False, True])
def test_a_damaged_block_has_one_owner(tmp_path, what, wrapped):
    _, data = generated(3, 120)
    if wrapped:
        rng, data = random.Random(4), b""
        for k in range(120):
            n = rng.randrange(1, 120)
            seq, qual = b"ACGT" * (n // 4) + b"A", (b"@I" * n)[: n // 4 * 4 + 1]
            data += b"@r%d\n%b\n+\n%b\n" % (k, b"\n".join(seq[i : i + 20] for i in range(0, len(seq), 20)), b"\n".join(qual[i : i + 20] for i in range(0, len(qual), 20)))
    shape = "multiline" if wrapped else "single"
    blocks = [sinks.bgzf_block(data[k : k + 700], 6) for k in range(0, len(data), 700)]
    for nth in range(0, len(blocks), 2):
        bad, block = list(blocks), bytearray(blocks[nth])
        if what == "crc":
            block[-8] ^= 1
        elif what == "size":
            block[-4] ^= 1
        elif what == "data":
            block[18:-8] = b"\xff" * (len(block) - 26)
        else:
            block[0] ^= 1
        bad[nth] = bytes(block)
        (tmp_path / "x").write_bytes(b"".join(bad) + codecs.BGZF_EOF)
        for mode in ("failfast", "permissive"):
            want = told(tmp_path / "x", mode=mode, splittable="false", format=shape)
            assert want[1] is not None and want[2] == 1
            for size in (150, 400, 1000, 2500):
                assert told(tmp_path / "x", mode=mode, splitSize=size, format=shape) == want, (nth, size, mode)


def wrapped_text(seed: int, n: int, width: int, most: int = 300):
    """Wrapped reads whose qualities look like headers and separators here and there."""
    rng, want, data = random.Random(seed), [], b""
    for k in range(n):
        size = rng.randrange(most) if rng.random() < 0.95 else 0
        seq, qual = (bytes(rng.choice(c) for _ in range(size)) for c in (b"ACGTN", b"@+I#"))
        header = b"read%04d" % k if seed % 2 else b"r%d" % k
        want.append((header, seq, qual))
        lines = [b"@" + header, *(seq[i : i + width] for i in range(0, size, width)), b"+", *(qual[i : i + width] for i in range(0, size, width))]
        data += b"\n".join(lines + [b""] * (size == 0)) + b"\n" + b"\n" * (rng.random() < 0.1)
    return want, data


@pytest.mark.parametrize("kind", ["plain", "bgzf"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_wrapped_files_split_anywhere(tmp_path, kind, seed):
    want, data = wrapped_text(seed, 150, 17 * seed)
    stored(tmp_path / "reads", data, kind)
    for size in (37, 200, 900, 3000, 1 << 20):
        assert scanned(tmp_path / "reads", splitSize=size, format="multiline") == want, size


def test_wrapped_error_is_that_of_one_split(tmp_path):
    for seed in range(12):
        rng, (_, data) = random.Random(seed), wrapped_text(5, 60, 20)
        bad = bytearray(data)
        bad[rng.randrange(len(bad))] = rng.choice(b"\n@+A")
        (tmp_path / "x").write_bytes(bytes(bad))
        want = told(tmp_path / "x", splittable="false", format="multiline")
        for size in (300, 1000):
            got = told(tmp_path / "x", splitSize=size, format="multiline")
            assert got[1] == want[1] and got[0][: len(want[0])] == want[0], (seed, size)


def test_a_synchroniser_stays_within_its_budget(tmp_path):
    def start(data, wrapped=False, lines=framing.SYNC_LINES, most=framing.SYNC_BYTES):
        taken = []

        def chunks():
            for k in range(0, len(data), 1 << 16):
                taken.append(1)
                yield data[k : k + (1 << 16)]

        found, reached = framing.Synchroniser(wrapped, lines, most).found(chunks(), 0)
        return found, reached, len(taken) << 16

    noise = b"no record here\n" * 1_000_000
    found, reached, taken = start(noise)
    assert found is None and reached == 15 * framing.SYNC_LINES and taken <= 1 << 19
    found, _, taken = start(b"x" * (100 << 20), most=1 << 22)  # one line
    assert found is None and taken <= 1 << 24
    # a wrapped record may run on beyond the lines, as long as it stays one
    long = b"@r\n" + b"ACGTACGTAC\n" * 30_000 + b"+\n" + b"@IIIIIIII+\n" * 30_000
    assert start(b"IIII\n" + long * 4, True)[0] == 5
    assert start(b"IIII\n" + long * 4, True, most=1 << 18)[0] is None
    # what is no wrapped file is given up, and the split before goes on: each split reads a bounded stretch
    (tmp_path / "x").write_bytes(long * 6)
    assert told(tmp_path / "x", splitSize=200_000) == ([], ("InvalidFormat", "PlusMissing", 14, 1), 1)
    assert [r[0] for r in scanned(tmp_path / "x", splitSize=200_000, format="multiline")] == [b"r"] * 6


def test_arrays_and_lines_frame_alike():
    for seed in range(300):
        rng = random.Random(seed)
        wrapped = seed % 2 == 1
        _, data = wrapped_text(seed, 12, rng.choice((1, 7, 40)), 60) if wrapped else generated(seed, 12)
        bad = bytearray(data)
        for _ in range(rng.randrange(3)):
            bad[rng.randrange(len(bad))] = rng.choice(b"@+\n\rA")
        for data in (bytes(bad), bytes(bad).replace(b"\n", b"\r\n")):
            plain, used = framing.one_by_one(data, 0, 0, True, wrapped)
            got = list(framing.framed(iter([data[k : k + 50] for k in range(0, len(data), 50)]), 0, wrapped))
            for name in framing.FIELDS:
                assert [v for g in got for v in g.values(name)] == getattr(plain, name)
            for name in ("header_offset", "seq_offset", "qual_offset", "size"):
                assert [int(v) for g in got for v in getattr(g, name)] == list(getattr(plain, name)), (seed, name)
            if wrapped:
                for name in ("seq_segs", "qual_segs"):
                    segments = [getattr(g, name) for g in got if getattr(g, name) is not None]
                    assert [v for x in segments for v in (x if isinstance(x, list) else x.to_pylist())] == getattr(plain, name)
            error = next((g.error for g in got if g.error), None)
            assert shape(error) == shape(plain.error and plain.error.numbered(len(plain) + 1))
            if error is None:
                assert sum(g.lines for g in got) == data.count(b"\n")


@pytest.mark.parametrize("shape_of", ["single", "multiline"])
def test_scan_validates_as_expressions_do(spark, tmp_path, shape_of):
    rng, text = random.Random(7), b""
    for k in range(400):
        n = rng.randrange(1, 90)
        seq, qual = bytes(rng.choice(b"ACGTNACGTX" if k % 3 else b"ACGT") for _ in range(n)), bytes(rng.choice(b"IIIII#\x1f" if k % 4 == 0 else b"I#~") for _ in range(n))
        width = 13 if shape_of == "multiline" else n
        text += b"\n".join([b"@r%d" % k, *(seq[i : i + width] for i in range(0, n, width)), b"+", *(qual[i : i + width] for i in range(0, n, width))]) + b"\n"
    for name, kind in (("x.fastq", "plain"), ("x.bgz", "bgzf")):
        stored(tmp_path / name, text, kind)
        read = {"format": shape_of, "splitSize": 3000}
        want = R.validation(read_reads(spark, str(tmp_path / name), numbered=True, **read), "bases_and_qualities", "strict", wrapped=shape_of == "multiline").where("invalid IS NOT NULL")
        got = read_reads(spark, str(tmp_path / name), mode="permissive", validation="bases_and_qualities", alphabet="strict", **read).where("error IS NOT NULL")
        expected = sorted(tuple(r) for r in want.select("header", "invalid.variant", "invalid.offset", "invalid.record", "invalid.byte", "record").collect())
        assert len(expected) > 100
        assert sorted(tuple(r) for r in got.select("header", "error.variant", "error.offset", "error.record", "error.byte", "record").collect()) == expected
        with pytest.raises(Exception) as e:
            read_reads(spark, str(tmp_path / name), validation="bases_and_qualities", alphabet="strict", **read | {"splitSize": 1 << 20}).collect()
        met, first = error_of(e.value), min(expected, key=lambda r: r[3])
        assert (met.variant, met.offset, met.record, met.byte) == first[1:5]
        prefix = read_reads(spark, str(tmp_path / name), mode="prefix", validation="bases_and_qualities", alphabet="strict", **read)
        assert prefix.count() == first[3] - 1


def test_totals_and_folders(spark, tmp_path):
    (tmp_path / "empty" / "below").mkdir(parents=True)
    assert read_reads(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "empty" / "below" / "a.fastq").write_bytes(b"@a\nAC\n+\n!J\n\n@b\n\n+\n\n")
    (tmp_path / "empty" / "_hidden").mkdir()
    (tmp_path / "empty" / "_hidden" / "x").write_bytes(b"junk")
    stored(tmp_path / "empty" / "b", b"@c\r\nACG\r\n+\r\n#I#\r\n" * 500, "bgzf")
    assert read_reads(spark, str(tmp_path / "empty")).count() == 502
    for size in (100, 1 << 20):
        assert tuple(read_totals(spark, str(tmp_path / "empty"), qualities=True, splitSize=size).first()) == (502, 1502, 2009, 33, 74)
    (tmp_path / "bad").write_bytes(b"@a\nAC\n+\n!\n")
    with pytest.raises(Exception, match="bad"):
        read_totals(spark, str(tmp_path / "bad")).collect()


def test_seek_to_every_virtual_offset(tmp_path):
    want, data = generated(6)
    path = str(tmp_path / "reads.gz")
    with open(path, "wb") as f:
        f.write(b"".join(sinks.bgzf_block(data[k : k + 500], 6) for k in range(0, len(data), 500)) + codecs.BGZF_EOF)
    o = fastq.Options({})
    places = [v for s in fastq.planned(path, o) for b in fastq.batches(s, o) for v in b["voffset"].to_pylist()]
    for k, v in enumerate(places):
        o = fastq.Options({"startOffset": str(v)})
        got = [h for s in fastq.planned(path, o) for b in fastq.batches(s, o) for h in b["header"].to_pylist()]
        assert got == [r[0] for r in want[k:]]
    for bad in ((places[-1] >> 16) + 1 << 16, places[0] + 501):
        with pytest.raises(errors.ReadError, match="virtual offset"):
            scanned(path, startOffset=bad)
    assert scanned(path, startOffset=os.path.getsize(path) << 16) == []


def decoded(data: bytes):
    try:
        return b"".join(codecs.gunzipped(iter([data[k : k + 11] for k in range(0, len(data), 11)])))
    except errors.ReadError as e:
        return e.kind


def test_gzip_integrity():
    one = gzip.compress(b"@a\nACGT\n+\n!!!!\n")
    assert decoded(one * 3) == b"@a\nACGT\n+\n!!!!\n" * 3
    assert decoded(one + b"\0" * 20 + one) == b"@a\nACGT\n+\n!!!!\n" * 2
    assert decoded(one + b"garbage") == b"@a\nACGT\n+\n!!!!\n"
    assert decoded(one[: len(one) // 2]) == "GzipTruncated"
    assert decoded(one[:-8] + bytes([one[-8] ^ 1]) + one[-7:]) == "GzipTrailerCrc"
    assert decoded(one[:-1] + bytes([one[-1] ^ 1])) == "GzipTrailerIsize"
    assert decoded(gzip.compress(b"")) == b""


def test_bgzf_integrity(tmp_path):
    block = sinks.bgzf_block(b"@a\nAC\n+\n!!\n", 6)
    path = tmp_path / "x"

    def read(data, **options):
        path.write_bytes(data)
        o, rows = fastq.Options({"mode": "permissive", **options}), []
        for s in fastq.planned(str(path), o):
            for b in fastq.batches(s, o):
                rows += [e["kind"] if e else h for h, e in zip(b["header"].to_pylist(), b["error"].to_pylist(), strict=True)]
        return rows

    assert read(block + codecs.BGZF_EOF) == [b"a"]
    assert read(block) == [b"a", "BgzfMissingEofMarker"]
    assert read(block, bgzfEofCheck="false") == [b"a"] and read(block, splittable="false") == [b"a", "BgzfMissingEofMarker"]
    assert read(b"", compression="bgzf") == ["BgzfHeader"] and read(b"@a\nAC\n+\n!!\n", compression="bgzf") == ["BgzfHeader"]
    crc, size = struct.unpack("<II", block[-8:])
    assert read(block[:-8] + struct.pack("<II", crc ^ 1, size) + codecs.BGZF_EOF) == ["BgzfBlockCrc"]
    assert read(block[:-8] + struct.pack("<II", crc, size + 1) + codecs.BGZF_EOF) == ["BgzfBlockIsize"]


def test_zstd_errors_have_kinds(tmp_path):
    zstandard = pytest.importorskip("zstandard")
    one = zstandard.ZstdCompressor().compress(b"@a\nAC\n+\n!!\n")

    def decoded_zstd(data):
        try:
            return b"".join(codecs.unzstd(iter([data[k : k + 5] for k in range(0, len(data), 5)])))
        except errors.ReadError as e:
            return e.kind

    assert decoded_zstd(one * 2) == b"@a\nAC\n+\n!!\n" * 2
    assert decoded_zstd(one[:-3]) == "ZstdTruncated" and decoded_zstd(one + b"junk" * 9) == "ZstdData"


def test_gzip_header_fields():
    import zlib

    body = gzip.compress(b"@a\nA\n+\n!\n", mtime=0)
    extra, name, note = b"\x03\0abc", b"file\0", b"note\0"
    for flags, fields in ((4, extra), (8, name), (16, note), (4 | 8 | 16, extra + name + note)):
        head = body[:3] + bytes([flags]) + body[4:10] + fields
        assert decoded(head + body[10:]) == b"@a\nA\n+\n!\n"
        crc = body[:3] + bytes([flags | 2]) + body[4:10] + fields
        assert decoded(crc + struct.pack("<H", zlib.crc32(crc) & 0xFFFF) + body[10:]) == b"@a\nA\n+\n!\n"
    assert decoded(body[:3] + b"\x20" + body[4:]) == "GzipHeader"


def test_detection_by_content(spark, tmp_path):
    data = b"@a\nAC\n+\n!!\n"
    for name, content in (("x.fastq", gzip.compress(data)), ("y.gz", data), ("z.gz", sinks.bgzf_block(data, 6) + codecs.BGZF_EOF)):
        (tmp_path / name).write_bytes(content)
        assert read_reads(spark, str(tmp_path / name)).count() == 1
    for head, kind in ((b"BZh91AY&SY", "bzip2"), (b"\xfd7zXZ\0rest", "xz")):
        (tmp_path / "bad").write_bytes(head)
        with pytest.raises(Exception, match=f"unsupported operation: {kind}"):
            read_reads(spark, str(tmp_path / "bad")).count()
    (tmp_path / "empty").write_bytes(b"")
    assert read_reads(spark, str(tmp_path / "empty")).count() == 0


def test_modes(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"@a\nAC\n+\n!!\n@b\nACGT\n+\n!!\n")
    with pytest.raises(Exception) as e:
        read_reads(spark, str(tmp_path / "x")).collect()
    got = error_of(e.value)
    assert (got.variant, got.offset, got.record, got.seq_len, got.qual_len) == ("LengthMismatch", 21, 2, 4, 2)
    rows = read_reads(spark, str(tmp_path / "x"), mode="permissive").orderBy("header_offset").collect()
    assert [r.error and r.error.variant for r in rows] == [None, "LengthMismatch"]
    assert [bytes(r.header) for r in read_reads(spark, str(tmp_path / "x"), mode="prefix").collect()] == [b"a"]


@pytest.mark.parametrize("extension", ["fastq", "fastq.gz", "fastq.bgz", "fastq.zst"])
def test_round_trip(spark, tmp_path, extension):
    rows = [(b"r%d x" % k, b"ACGT"[: k % 5], b"!~%A"[: k % 5]) for k in range(500)]
    df = spark.createDataFrame(rows, "header binary, seq binary, qual binary").repartition(3)
    write_reads(df, str(tmp_path / f"one.{extension}"), singleFile=True)
    write_reads(df, str(tmp_path / extension), compression=sinks.by_extension(f"x.{extension}"))
    for path in (f"one.{extension}", extension):
        got = read_reads(spark, str(tmp_path / path)).select("header", "seq", "qual").collect()
        assert sorted((bytes(r[0]), bytes(r[1]), bytes(r[2])) for r in got) == sorted(rows)


@pytest.mark.parametrize("n", [0, 1, 700, 9000])
def test_one_bgzf_file_is_that_of_one_writer(spark, tmp_path, monkeypatch, n):
    from readloom.sources import grid

    monkeypatch.setattr(grid, "BLOCKS", 2)
    df = spark.range(n).select(F.concat(F.lit("r"), "id").cast("binary").alias("header"), F.repeat(F.lit("ACGTA"), 10).cast("binary").alias("seq"), F.repeat(F.lit("IJKLM"), 10).cast("binary").alias("qual"))
    write_reads(df.repartitionByRange(5, "header").sortWithinPartitions("header"), str(tmp_path / "x.bgz"), singleFile=True, level=4)
    text = b"".join(b"@%b\n%b\n+\n%b\n" % tuple(map(bytes, r)) for r in df.orderBy("header").collect())
    encoder = sinks.Encoder("bgzf", 4)
    assert (tmp_path / "x.bgz").read_bytes() == encoder.add(text) + encoder.finish()
    assert sorted(os.listdir(tmp_path)) == ["x.bgz"]

@pytest.mark.parametrize("name", ["x.fastq", "x.fastq.gz", "x.fastq.bgz", "x.fastq.zst"])
def test_one_file_of_any_size_is_copied_by_tasks(spark, tmp_path, monkeypatch, name):
    from readloom.sources import grid

    monkeypatch.setattr(grid, "COPIED", 1000)
    df = spark.range(3000).select("id", *(F.format_string(t, "id").cast("binary").alias(c) for t, c in (("r%05d", "header"), ("ACGT%05d", "seq"), ("IIII%05d", "qual"))))
    write_reads(df.repartitionByRange(3, "id").sortWithinPartitions("id"), str(tmp_path / name), singleFile=True)
    assert os.listdir(tmp_path) == [name]
    assert [int(r.header[1:]) for r in read_reads(spark, str(tmp_path / name), numbered=True).orderBy("record").collect()] == list(range(3000))
    assert fastq.Writer({"path": str(tmp_path / name), "singleFile": "true"}, True).limit is None

@pytest.mark.parametrize("kind", [("plain", ""), ("bgzf", ""), ("bgzf", "crc"), ("bgzf", "header")])
def test_a_lane_by_many_tasks_is_that_of_one_writer(spark, tmp_path, monkeypatch, kind):
    from readloom.plans import lanes
    from readloom.sources import grid

    monkeypatch.setattr(grid, "BLOCKS", 2)
    df = spark.range(9000).select("id", F.format_string("@r%05d %s\n", "id", F.repeat(F.lit("x"), 80)).alias("value")).repartitionByRange(5, "id").sortWithinPartitions("id")
    assert lanes.split_lane(spark, df.select("value"), str(tmp_path / "many"), *kind)
    text = "".join(r.value for r in df.orderBy("id").collect()).encode()
    one = lanes.Lane(str(tmp_path / "one"), *kind, -(-len(text) // lanes.GRID) // 2)
    one.add(text)
    one.close()
    assert (tmp_path / "many").read_bytes() == (tmp_path / "one").read_bytes()
    assert sorted(os.listdir(tmp_path)) == ["many", "one"]
    assert not lanes.split_lane(spark, df.where("id < 0").select("value"), str(tmp_path / "none"), *kind)

def test_values_read_together_are_those_read_alone(spark, monkeypatch):
    good, odd = b"@a\nAC\n+\n!!\n@b\nGT\n+\n##\n", [b"@c\nA\n+\n!", b"", b"\n@d\nA\n+\n!\n\n", b"@e\nA\n", b"+\n!\n", b"@f\r\nAC\r\n+\r\n!!\r\n", b"\n", b"@a\nA\n+\n!\n\r", gzip.compress(b"@g\nA\n+\n!\n"), b"@h\n\n+\n\n"]
    values = [good] * 50 + odd + [good] * 50 + odd[::-1] + [None] + [good] * 500
    df = spark.createDataFrame([(str(k), v) for k, v in enumerate(values)], "key string, content binary")
    got = parse_bytes(df.coalesce(1), key_col="key").collect()
    want = []
    for k, v in enumerate(values):
        v = gzip.decompress(v) if v and v[:2] == b"\x1f\x8b" else v or b""
        out, n = list(framing.framed(iter([v]))), 0
        for x in out:
            for h, s, q, *places in zip(*map(x.values, framing.FIELDS), x.header_offset, x.seq_offset, x.qual_offset, strict=True):
                n += 1
                want.append((str(k), h, s, q, n, *map(int, places), None))
            if x.error:
                want.append((str(k), None, None, None, x.error.record, x.error.offset, None, None, x.error.variant))
    assert [(*(x if x is None or not isinstance(x, bytearray) else bytes(x) for x in tuple(r)[:8]), r.error and r.error.variant) for r in got] == want
    # values of whole records are framed as one text
    seen, framed = [], framing.framed
    monkeypatch.setattr(framing, "framed", lambda *a, **b: seen.append(1) or framed(*a, **b))
    (batch,) = parse_in_process([good] * 1000)
    assert (len(batch), seen) == (2000, [])


def parse_in_process(values):
    """The batches of parse_bytes without Spark."""
    import pyarrow as pa

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_pydict({"key": pa.nulls(len(values), pa.string()), "value": pa.array(values, pa.binary())})]))

    return parse_bytes(Rows())


@pytest.mark.parametrize(
    ("row", "options", "message"),
    [
        ((b"a", b"AC", b"!"), {}, "seq_len=2, qual_len=1"),
        ((b"a\nb", b"A", b"!"), {}, "header contains a line break"),
        ((b"a", b"A\n", b"!!"), {"validation": "linebreaks"}, "sequence contains a line break"),
        ((b"a", b"AX", b"!!"), {"validation": "bases", "alphabet": "strict"}, "invalid base byte 0x58 ('X') at offset 1"),
        ((b"a", b"A", b"\x10"), {"validation": "qualities"}, "invalid quality byte 0x10 (non-printable) at offset 0"),
        ((b"a", b"A", b"!"), {"compression": "gzip", "level": 10}, "compression level 10"),
    ],
)
def test_refusals_leave_nothing(spark, tmp_path, row, options, message):
    df = spark.createDataFrame([row], "header binary, seq binary, qual binary")
    with pytest.raises(Exception) as e:
        write_reads(df, str(tmp_path / "out"), **options)
    assert message in str(e.value)
    assert not os.path.isdir(tmp_path / "out") or not os.listdir(tmp_path / "out")


def test_columns(spark):
    names = ["r1/1", "r1 1:N", "SRR000001.1.2", "SRR000001.17", "/1", "a\tb  c", "x/9"]
    got = spark.createDataFrame([(n,) for n in names], "h string").select(C.canonical_id(F.col("h")), C.description(F.col("h"))).collect()
    assert [r[0] for r in got] == ["r1", "r1", "SRR000001.1", "SRR000001.17", "/1", "a", "x"]
    assert [r[1] for r in got] == ["", "1:N", "", "", "", "b  c", ""]
    reads = parse_bytes(spark.createDataFrame([(bytearray(b"@r1\nAC\nGTX\n+\n!!\n!!!\n"),)], "content binary"), wrapped=True)
    assert bytes(reads.first().seq) == b"ACGTX"


def test_wrapped_error_place(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"@r1\nAC\nGTX\n+\n!!\n!!!\n")
    out = R.validation(read_reads(spark, str(tmp_path / "x"), format="multiline"), "bases", "strict", wrapped=True)
    e = R.first_invalid(out)
    assert (e.variant, e.offset, e.record, e.byte) == ("InvalidBase", 9, 1, 88)


def test_pairs(spark, tmp_path):
    def file(name, ids):
        (tmp_path / name).write_bytes(b"".join(b"@%b\nA\n+\n!\n" % i for i in ids))
        return R.number_records(read_reads(spark, str(tmp_path / name)))

    # (paired through the operators alone)
    good = R.pairs(file("a", [b"r1/1", b"r2/1"]), file("b", [b"r1/2", b"r2/2"]), check_ids=True)
    assert R.checked_pairs(good).count() == 2
    for one, two, ended in (([b"a", b"b"], [b"a"], "R2"), ([b"a"], [b"a", b"b"], "R1")):
        with pytest.raises(errors.ReadError, match=f"{ended} ended first \\(record 2\\)"):
            R.checked_pairs(R.pairs(file("c", one), file("d", two)))
    with pytest.raises(errors.ReadError, match="r1 and x1"):
        R.checked_pairs(R.pairs(file("e", [b"r1"]), file("f", [b"x1"]), check_ids=True))
    odd = R.interleaved(file("g", [b"a/1", b"a/2", b"b/1"])).orderBy("record").collect()
    assert [r.error for r in odd] == [None, "R2 ended first"]
    assert R.guess_encoding(spark.createDataFrame([(bytearray(b"KKZZ"),)], "qual binary")).first()[0] == "phred64"


@pytest.mark.parametrize(("kinds", "counts"), [(("plain", "bgzf"), (300, 300)), (("bgzf", "plain"), (310, 290)), (("plain", "plain"), (120, 300)), (("bgzf", "gzip"), (300, 299)), (("plain", "bgzf"), (0, 40))])
def test_pairs_and_interleaved_read_no_mate_twice(spark, tmp_path, kinds, counts):
    rng = random.Random(counts[0])
    for mate, (kind, n) in enumerate(zip(kinds, counts, strict=True)):
        (tmp_path / f"m{mate}").mkdir()
        for lane in range(2):
            sizes = [rng.randrange(1, 200) if mate else rng.randrange(0, 60) for _ in range(n if lane == 0 else n // 2)]
            data = b"".join(b"@r%d\n%b\n+\n%b\n" % (k, b"A" * size, b"I" * size) for k, size in enumerate(sizes))
            path = tmp_path / f"m{mate}" / f"lane{lane}"
            path.write_bytes(gzip.compress(data)) if kind == "gzip" else stored(path, data, kind)
    paths, fields = [str(tmp_path / f"m{mate}") for mate in (0, 1)], ("file_no", "record", "r1", "r2", "error")
    got = read_pairs(spark, *paths, splitSize=1500)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = R.pairs(*(read_reads(spark, p, mode="permissive", numbered=True, splitSize=1500) for p in paths))
    assert sorted(map(repr, got.select(*fields).collect())) == sorted(map(repr, want.select(*fields).collect()))
    n = got.count()
    if "bgzf" in kinds:
        # without their end markers, which an option lets pass
        for path in (p for kind, folder in zip(kinds, paths, strict=True) if kind == "bgzf" for p in sorted(os.scandir(folder), key=lambda f: f.name)):
            os.truncate(path, os.path.getsize(path) - len(codecs.BGZF_EOF))
        assert read_pairs(spark, *paths, splitSize=1500, bgzfEofCheck=False).count() == n
    folded = read_interleaved(spark, paths[1], splitSize=700, bgzfEofCheck=False)
    want = R.interleaved(read_reads(spark, paths[1], mode="permissive", numbered=True, splitSize=700, bgzfEofCheck=False))
    fields = ("file", "record", "r1", "r2", "error")
    assert sorted(map(repr, folded.select(*fields).collect())) == sorted(map(repr, want.select(*fields).collect()))


def test_malformed_read_ends_its_pairs(spark, tmp_path):
    good = [b"@r%d\nACGT\n+\nIIII\n" % k for k in range(200)]
    (tmp_path / "a").write_bytes(b"".join(good))
    (tmp_path / "b").write_bytes(b"".join([*good[:120], b"@bad\nAC\n+\nI\n", *good[121:]]))
    for size in (700, 1 << 20):
        pairs = read_pairs(spark, str(tmp_path / "a"), str(tmp_path / "b"), splitSize=size)
        e = R.first_pair_error(pairs)
        assert (e.variant, e.record, e.seq_len, e.offset) == ("LengthMismatch", 121, 2, sum(map(len, good[:120])) + 10)
        assert pairs.where("error IS NULL").count() == 120 and pairs.count() == 121
        e = R.first_pair_error(read_interleaved(spark, str(tmp_path / "b"), splitSize=size))
        assert (e.variant, e.record, e.seq_len) == ("LengthMismatch", 121, 2)


def test_lanes_and_precedence(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)

    for mate in (1, 2):
        for lane in (1, 2):
            file(f"m{mate}/l{lane}.fastq", b"".join(b"@l%dr%d/%d\nA\n+\n!\n" % (lane, k, mate) for k in range(3)))
    got = read_pairs(spark, str(tmp_path / "m1"), str(tmp_path / "m2"), check_ids=True)
    assert R.checked_pairs(got).count() == 6
    # R1's own error comes before R2's at the same record, and both before what follows them
    file("a", b"@r/1\nA\n+\n!\n@s/1\nX\n+\n!\n")
    file("b", b"@r/2\nA\n+\n!\n@s/2\nAC\n+\n!\n")
    e = R.first_pair_error(read_pairs(spark, str(tmp_path / "a"), str(tmp_path / "b"), validation="bases", alphabet="strict"))
    assert (e.variant, e.record, e.offset, e.byte) == ("InvalidBase", 2, 16, 88)
    e = R.first_pair_error(read_pairs(spark, str(tmp_path / "a"), str(tmp_path / "b")))
    assert (e.variant, e.record, e.seq_len) == ("LengthMismatch", 2, 2)
    file("c", b"@r/1\nA\n+\n!\n@s/1\nA\n+\n!\n")
    file("d", b"@r/2\nA\n+\n!\n@t/2\nA\n+\n!\n")
    e = R.first_pair_error(read_pairs(spark, str(tmp_path / "c"), str(tmp_path / "d"), check_ids=True))
    assert (e.variant, e.record, e.offsets, e.ids) == ("PairedIdMismatch", 2, (11, 11), ("s", "t"))


def test_reader_validates_and_refuses_unknown_options(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"@a\nAC\n+\n!!\n@b\nAX\n+\n!!\n@c\nA\n+\n!\n")
    with pytest.raises(Exception) as e:
        read_reads(spark, str(tmp_path / "x"), validation="bases", alphabet="strict").count()
    got = error_of(e.value)
    assert (got.variant, got.offset, got.record, got.byte) == ("InvalidBase", 15, 2, 88)
    assert read_reads(spark, str(tmp_path / "x"), validation="qualities").count() == 3
    prefix = read_reads(spark, str(tmp_path / "x"), mode="prefix", validation="bases-and-qualities", alphabet="strict")
    assert [bytes(r.header) for r in prefix.collect()] == [b"a"]
    assert read_reads(spark, str(tmp_path / "x"), columns="seq,record").columns == ["seq", "record"]
    for bad in ({"splitsise": 1}, {"columns": "seqs"}):
        with pytest.raises(Exception, match="unknown"):
            read_reads(spark, str(tmp_path / "x"), **bad).count()
    df = read_reads(spark, str(tmp_path / "x"))
    with pytest.raises(Exception, match="unknown options"):
        write_reads(df, str(tmp_path / "o"), levle=3)
    with pytest.raises(Exception, match="singleFileLimit"):
        write_reads(df, str(tmp_path / "o.fastq"), singleFile=True, singleFileLimit=5)


def test_numbering_shuffles_no_read(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"".join(b"@r%d\nAC\n+\n!!\n" % k for k in range(1000)))
    df = read_reads(spark, str(tmp_path / "x"), splitSize=700, numbered=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    rows = df.select("header", "record").collect()
    assert sorted((r.record, bytes(r.header)) for r in rows) == [(k + 1, b"r%d" % k) for k in range(1000)]
    many = R.number_records(read_reads(spark, str(tmp_path / "x"), splitSize=700), splits=3)  # more splits than are broadcast
    assert sorted((r.record, bytes(r.header)) for r in many.collect()) == [(k + 1, b"r%d" % k) for k in range(1000)]


def test_try_for_each(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"@a\nAC\n+\n!!\n@b\nAC\n+\n!!\n@c\nA\n+\n!!\n")
    reads = read_reads(spark, str(tmp_path / "x"), mode="permissive", numbered=True)
    with pytest.raises(errors.ReadError, match="length mismatch at offset 29 \\(record 3\\)"):
        R.try_for_each(reads, lambda read: None)

    def refuse(read):
        if read["header"] == b"b":
            raise KeyError("no b")

    with pytest.raises(R.CallbackError, match="record 2 .*KeyError: 'no b'"):
        R.try_for_each(reads, refuse)
    assert R.try_for_each(reads.where("record < 3"), lambda read: None) == 2


def test_values_in_memory(spark):
    data = b"@a\nAC\n+\n!!\n"
    values = [data, gzip.compress(data), sinks.bgzf_block(data, 6) + codecs.BGZF_EOF, sinks.bgzf_block(data, 6), b""]
    df = spark.createDataFrame([(str(k), bytearray(v)) for k, v in enumerate(values)], "k string, content binary")
    got = [(r.key, r.error and r.error.kind) for r in parse_bytes(df, key_col="k").orderBy("key", "record").collect()]
    assert got == [("0", None), ("1", None), ("2", None), ("3", None), ("3", "BgzfMissingEofMarker")]


def test_messages_parse():
    for e in (
        errors.invalid("PlusMissing", 9).numbered(2), errors.ReadError("UnexpectedEof", 11, 1), errors.ReadError("LengthMismatch", 3, 1, seq_len=4, qual_len=2),
        errors.ReadError("InvalidBase", 6, 1, byte=88), errors.ReadError("InvalidQuality", 14, byte=16), errors.ReadError("Unsupported", detail="xz"),
    ):
        got = errors.parsed(f"worker said: {e}\nat line 3")
        assert (got.variant, got.kind, got.offset, got.record, got.byte) == (e.variant, e.kind, e.offset, e.record, e.byte)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_stream_reads_late_files_once(spark, tmp_path, scheme):
    from readloom.api import stream_reads
    from readloom.streaming.reads import write_stream

    folder = tmp_path / "in"
    folder.mkdir()
    # a file that sorts first, and one with an older modification time, come after others were read
    for batch in ((("b", 3000), ("d", 3000)), (("a", 4000),), (("e", 1000), ("c", 2000))):
        for name, time in batch:
            (folder / f"{name}.fastq").write_bytes(b"@%b\nA\n+\nI\n" % name.encode())
            os.utime(folder / f"{name}.fastq", (time, time))
        write_stream(stream_reads(spark, f"{scheme}{folder}"), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(100)
    found = [line for f in sorted((tmp_path / "out").rglob("part-*")) for line in f.read_bytes().split(b"\n") if line.startswith(b"@")]
    assert sorted(found) == [b"@a", b"@b", b"@c", b"@d", b"@e"]


def made(first, last):
    return [b"@r%d\n%b\n+\n%b\n" % (k, b"ACGT" * (1 + k % 5), b"IIII" * (1 + k % 5)) for k in range(first, last)]


def blocks(data, size=700):
    return [sinks.bgzf_block(data[k : k + size], 6) for k in range(0, len(data), size)]


@pytest.mark.parametrize("kind", ["plain", "bgzf", "wrapped"])
def test_whole_to_ends_with_the_last_whole_record(tmp_path, kind):
    """Cut anywhere, and begun at any whole record: what is whole up to there, as reading line by line has it."""
    from readloom.sources import stream

    records, path = made(0, 400), tmp_path / "x"
    if kind == "wrapped":
        records = [r.replace(b"ACGTACGT", b"ACGT\nACGT", 1).replace(b"IIIIIIII", b"IIIII\nIII", 1) for r in records]
    ends = list(itertools.accumulate(map(len, records)))
    text = b"".join(records)
    o = fastq.Options({"format": "multiline" if kind == "wrapped" else "single"})
    parts = blocks(text) if kind == "bgzf" else [text]
    whole, random = b"".join(parts), np.random.default_rng(3)
    for tail in (1 << 8, 1 << 11, 1 << 18):
        stream.TAIL, start, seen = tail, 0, 0
        for cut in sorted(random.integers(1, len(whole) + 1, 25).tolist()) + [len(whole)]:
            path.write_bytes(whole[:cut])
            if kind == "bgzf" and cut < 20:
                continue
            if kind == "bgzf":
                sizes = list(itertools.accumulate(map(len, parts)))
                n = min(len(text), 700 * sum(s <= cut for s in sizes))
            else:
                n = cut
            want = max((e for e in ends if e <= n), default=0)
            end = stream.whole_to(str(path), start, cut, o)
            if end != start:
                places = {"startOffset": str(start), "endOffset": str(end), "splitSize": "900", "format": "multiline" if kind == "wrapped" else "single"}
                seen += sum(b.num_rows for s in fastq.planned(str(path), fastq.Options(places)) for b in fastq.batches(s, o))
            assert seen == sum(e <= want for e in ends), (tail, cut)
            start = end
        assert seen == len(records)
    stream.TAIL = 1 << 18


def test_whole_to_tells_wrong_from_unfinished(tmp_path):
    from readloom.sources import stream

    o, path, good = fastq.Options({}), tmp_path / "x", b"".join(made(0, 50))
    for end, wrong in ((b"@a\nAC", False), (b"@a\nACGT\n+\nII", False), (b"@a\nACGT\n+\nIIII", False), (b"@a\nACGT\n+\nII\n", True), (b"nothing\n@a\n", True), (b"\n\n", False)):
        path.write_bytes(good + end)
        assert stream.whole_to(str(path), 0, len(good + end), o) == (None if wrong else len(good)), end
    packed = b"".join(blocks(good))
    for end, wrong in ((b"\x1f\x8b\x08", False), (blocks(b"@a\nA\n+\nI\n")[0][:-3], False), (b"x" * 40, True)):
        path.write_bytes(packed + end)
        assert (stream.whole_to(str(path), 0, len(packed + end), o) is None) == wrong, end


def test_stream_log(tmp_path):
    from readloom.sources import stream

    folder = tmp_path / "in"
    folder.mkdir()
    options = {"path": str(folder), "log": str(tmp_path / "log"), "maxFilesPerTrigger": "2"}
    reader, offset, got = stream.StreamReader(options), {"step": 0}, []
    for k in range(0, 200):
        (folder / f"{k:03d}.fastq").write_bytes(b"@%d\nA\n+\nI\n" % k)
        if k % 50 == 49:
            reader = stream.StreamReader(options)  # a restart knows what the log has
        if k % 2:
            end = reader.latestOffset()
            got += [s.file for s in reader.partitions(offset, end)]
            assert len(json.dumps(end)) < 20
            reader.commit(end)
            offset = end
    assert sorted(got) == sorted(map(str, folder.iterdir())) and len(got) == 200 and reader.latestOffset() == offset
    assert len(list((tmp_path / "log").iterdir())) <= stream.KEEP + 1
    # a new stream on the log reads all of it, one that goes on from a checkpoint without a log what that has not
    again = stream.StreamReader(options)
    assert sorted(s.file for s in again.partitions({"step": 0}, offset)) == sorted(got)
    assert {s.file for s in again.partitions({"files": got[:150]}, offset)} == set(got[150:])
    with pytest.raises(RuntimeError, match="merged"):
        again.partitions({"step": 1}, offset)
    # more files than a batch takes stay for the next
    for k in range(5):
        (folder / f"z{k}.fastq").write_bytes(b"@z\nA\n+\nI\n")
    sizes = []
    while (end := again.latestOffset()) != offset:
        sizes.append(len(again.partitions(offset, end)))
        offset = end
    assert sizes == [2, 2, 1]
    for odd in ({"follow": "true"}, {"maxFilesPerTrigger": "1"}, {"follow": "true", "log": "x", "startOffset": "3"}):
        with pytest.raises(ValueError):
            stream.StreamReader({"path": str(folder), **odd})
    with pytest.raises(ValueError):
        fastq.Reader({"path": str(folder), "follow": "true"})


def test_stream_follows_files_that_grow(spark, tmp_path):
    from readloom.api import stream_reads

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    plain, packed, records = folder / "a.fastq", folder / "b.fastq.bgz", made(0, 300)
    text, parts = b"".join(records), blocks(b"".join(made(1000, 1300)))
    steps = [(text[:1000], parts[:2]), (text[:1007], parts[:2]), (text[:5000], [*parts[:6], parts[6][:20]]), (text, [*parts, codecs.BGZF_EOF])]
    (folder / "c.fastq.gz").write_bytes(gzip.compress(b"@c\nA\n+\nI\n"))
    found = []
    for a, b in steps:
        plain.write_bytes(a)
        packed.write_bytes(b"".join(b))
        stream = stream_reads(spark, str(folder), log=str(tmp_path / "log"), follow=True, splitSize=1500, columns="header,file")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(100)
        found.append(spark.read.parquet(out).count())
    headers = sorted(bytes(r.header) for r in spark.read.parquet(out).collect())
    assert headers == sorted([b"c", *(b"r%d" % k for k in [*range(300), *range(1000, 1300)])])
    assert found == sorted(found) and found[0] < found[2] < found[3]
    plain.write_bytes(text[:50])
    from readloom.sources import stream as s

    with pytest.raises(RuntimeError, match="shorter"):
        s.StreamReader({"path": str(folder), "log": str(tmp_path / "log"), "follow": "true"}).latestOffset()
