"""Records out of decoded bytes, by arrays of lines.

The lines of a window are known by their starts, lengths and first bytes. For every line at once it is computed where the next record would start if
one started here; the records of the window are the chain of these from its first line. Fields are cut out by Arrow kernels, wrapped ones joined from
their lines. Only where the chain breaks is a record read line by line, to tell what is wrong with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..errors import ReadError, invalid

#: Decoded bytes that are framed at once.
WINDOW = 8 << 20
#: Fields of a record that are built if they are wanted; places always are.
FIELDS = ("header", "seq", "qual")
#: Bytes that an Arrow array of binary values can hold.
MOST = (1 << 31) - 1
#: Lines, and bytes, in which a record start must be found; a candidate that began within the lines may run on to the end of the bytes.
SYNC_LINES, SYNC_BYTES = 4096, 64 << 20
#: Bytes after which a start without rivals is taken, unless reads are wrapped, and after which any is.
SOON, SURE = 1 << 14, 1 << 17
#: Records that must follow one another from a start, and records with a sequence that must lead up to a split of a wrapped file.
CONFIRM, LEAD = 3, 3
#: What follows a line as a header: no record, or nothing known yet.
BAD, OPEN = -1, -2
SEGMENT = pa.list_(pa.struct([("offset", pa.int64()), ("len", pa.int32())]))


@dataclass
class Checks:
    """What the bytes of fields must be: bases of an alphabet, qualities from least to most; None where they are not checked."""

    bases: bytes | None = None
    quals: tuple[int, int] | None = None


@dataclass
class Records:
    """Columns of framed records, as Arrow arrays, or as lists where a record is too long for them; offsets are absolute in the decoded stream."""

    header: pa.Array | list[bytes] | None = field(default_factory=list)
    seq: pa.Array | list[bytes] | None = field(default_factory=list)
    qual: pa.Array | list[bytes] | None = field(default_factory=list)
    header_offset: np.ndarray | list[int] = field(default_factory=list)
    seq_offset: np.ndarray | list[int] = field(default_factory=list)
    qual_offset: np.ndarray | list[int] = field(default_factory=list)
    seq_segs: pa.Array | list[list[tuple[int, int]]] | None = None
    qual_segs: pa.Array | list[list[tuple[int, int]]] | None = None
    #: The lengths of the sequences, and the line feeds in the records and the blank lines before them.
    size: np.ndarray | list[int] = field(default_factory=list)
    lines: int = 0
    #: Records that fail their checks: (number in this batch, error), in order.
    failing: list[tuple[int, ReadError]] = field(default_factory=list)
    error: ReadError | None = None

    def __len__(self) -> int:
        return len(self.header_offset)

    def cut(self, n: int) -> None:
        """Only the first n records stay."""
        for name in (*FIELDS, "header_offset", "seq_offset", "qual_offset", "seq_segs", "qual_segs", "size"):
            if getattr(self, name) is not None:
                setattr(self, name, getattr(self, name)[:n])
        self.failing = [x for x in self.failing if x[0] < n]

    def values(self, name: str) -> list[bytes]:
        """A field as a list."""
        found = getattr(self, name)
        return found.to_pylist() if isinstance(found, pa.Array) else found


class Lines:
    """Lines of a buffer one by one; `whole` tells that the stream ends with it."""

    def __init__(self, data: bytes, at: int, whole: bool, place: int = 0):
        self.data, self.place, self.at, self.whole = data, place, at, whole

    def take(self) -> tuple[int, bytes] | None:
        """(absolute offset, line without its end); None at the end. Raises NeedMore where the buffer ends in a line."""
        data, start = self.data, self.place
        end = data.find(b"\n", start)
        if end < 0:
            if not self.whole:
                raise NeedMore
            if start == len(data):
                return None
            end, self.place = len(data), len(data)
        else:
            self.place = end + 1
        stop = end - 1 if end > start and data[end - 1] == 13 else end
        return self.at + start, data[start:stop]

    def next(self) -> tuple[int, bytes]:
        """As take, but the end is an error."""
        here = self.at + self.place
        if (got := self.take()) is None:
            raise ReadError("UnexpectedEof", here)
        return got


class NeedMore(Exception):
    pass


def single(lines: Lines):
    """The next four-line record: (header, seq, qual, their offsets, no segments); None at the end."""
    while (got := lines.take()) is not None and not got[1]:
        pass
    if got is None:
        return None
    at, header = got
    if header[:1] != b"@":
        raise invalid("HeaderMissingAt", at)
    s_at, seq = lines.next()
    here, plus = lines.next()
    if plus[:1] != b"+":
        raise invalid("PlusMissing", here)
    q_at, qual = lines.next()
    if len(seq) != len(qual):
        raise ReadError("LengthMismatch", q_at, seq_len=len(seq), qual_len=len(qual))
    return header[1:], seq, qual, at, s_at, q_at, None, None


def multi(lines: Lines):
    """The next record whose sequence and qualities may be wrapped, with the origin of each line."""
    while (got := lines.take()) is not None and not got[1]:
        pass
    if got is None:
        return None
    at, header = got
    if header[:1] != b"@":
        raise invalid("HeaderMissingAt", at)
    s_at, seq, s_segs = lines.at + lines.place, [], []
    while True:
        here, text = lines.next()
        if text[:1] == b"+":
            break
        if not text:
            raise invalid("SeqLineEmpty", here)
        seq.append(text)
        s_segs.append((here, len(text)))
    whole = b"".join(seq)
    q_at, qual, q_segs, size = lines.at + lines.place, [], [], 0
    while True:
        here, text = lines.next()
        if not whole and text:
            raise ReadError("LengthMismatch", q_at, seq_len=0, qual_len=len(text))
        if whole and not text:
            raise invalid("QualLineEmpty", here)
        if size + len(text) > len(whole):
            raise ReadError("LengthMismatch", here, seq_len=len(whole), qual_len=size + len(text))
        size += len(text)
        if text:
            qual.append(text)
            q_segs.append((here, len(text)))
        if size == len(whole):
            return header[1:], whole, b"".join(qual), at, s_at, q_at, s_segs, q_segs


@dataclass
class Index:
    """Lines of a window: where each starts, its length without its end, its first byte (0 if blank), and where the last one ends."""

    starts: np.ndarray
    lens: np.ndarray
    first: np.ndarray
    used: int
    ended: bool

    def __len__(self) -> int:
        return len(self.starts)


def indexed(data: bytes, whole: bool) -> Index:
    """The lines of a buffer that are complete; with `whole`, what stands after the last line feed is a line as well."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    used = int(ends[-1]) + 1 if len(ends) else 0
    if whole and used < len(raw):
        ends, used = np.append(ends, len(raw)), len(raw)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0], starts[1:] = 0, ends[:-1] + 1
    lens = ends - starts
    lens -= (raw[ends - 1] == 13) & (lens > 0)
    first = np.where(lens > 0, raw[np.minimum(starts, max(0, len(raw) - 1))], 0) if len(ends) else np.empty(0, np.uint8)
    return Index(starts, lens, first, used, whole)


def following_single(x: Index) -> np.ndarray:
    """For each line the line after the record that it heads; BAD where none can, OPEN where that is not known yet."""
    n = len(x)
    out = np.full(n, BAD, np.int64)
    m = max(0, n - 3)
    ok = (x.first[:m] == 64) & (x.first[2 : m + 2] == 43) & (x.lens[1 : m + 1] == x.lens[3 : m + 3])
    out[:m][ok] = np.flatnonzero(ok) + 4
    if not x.ended:
        for j in range(m, n):
            if x.first[j] == 64 and (j + 2 >= n or x.first[j + 2] == 43):
                out[j] = OPEN
    return out


def following_multi(x: Index) -> tuple[np.ndarray, np.ndarray]:
    """As following_single, and the separator line of the record that each line heads."""
    n = len(x)
    out, separator = np.full(n, BAD, np.int64), np.zeros(n, np.int64)
    heads = np.flatnonzero(x.first == 64)
    if not len(heads):
        return out, separator
    plus = np.flatnonzero(x.first == 43)
    total, blank = (np.concatenate([[0], np.cumsum(v)]) for v in (x.lens, x.lens == 0))
    p = np.append(plus, n)[np.searchsorted(plus, heads + 1)]
    clean = blank[np.minimum(p, n)] == blank[np.minimum(heads + 1, n)]
    size = total[p] - total[np.minimum(heads + 1, n)]
    after = np.minimum(p + 1, n)
    # the first line with which the qualities are as long as the sequence
    wanted = total[after] + size
    e = np.where(size == 0, after + 1, np.searchsorted(total, wanted))
    inside = np.minimum(e, n)
    whole = (e <= n) & (p < n)
    fits = np.where(size == 0, blank[inside] - blank[after] == 1, (total[inside] == wanted) & (blank[inside] == blank[after]))
    out[heads[clean & whole & fits]] = e[clean & whole & fits]
    if not x.ended:
        out[heads[clean & ((p >= n) | (e > n) & ((size == 0) | (blank[n] == blank[after])))]] = OPEN
    separator[heads] = np.minimum(p, n)
    return out, separator


def chained(x: Index, after: np.ndarray, j: int = 0) -> tuple[np.ndarray, int]:
    """The header lines of the records that follow one another from line j, blank lines between them, and the line where that ends."""
    blank = (x.lens == 0).tolist()
    after, heads, n = after.tolist(), [], len(x)
    while j < n:
        if blank[j]:
            j += 1
        elif (k := after[j]) >= 0:
            heads.append(j)
            j = k
        else:
            break
    return np.array(heads, np.int64), j


def regular(x: Index) -> tuple[np.ndarray, int] | None:
    """As chained, where every four lines are a record; None where they are not."""
    n = len(x) // 4
    part = slice(0, 4 * n)
    if n and (x.first[part][0::4] == 64).all() and (x.first[part][2::4] == 43).all() and (x.lens[part][1::4] == x.lens[part][3::4]).all():
        return np.arange(0, 4 * n, 4), 4 * n
    return None


def ranged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Cutter:
    """Cuts fields out of a window. Items 2j are the contents of its lines, items between them the line ends."""

    def __init__(self, data: bytes, x: Index, heads: np.ndarray):
        bounds = np.empty(2 * len(x) + 1, np.int32)
        bounds[0:-1:2], bounds[1::2], bounds[-1] = x.starts, x.starts + x.lens, x.used
        bounds[2 * heads] += 1  # less the @
        self.items = pa.Array.from_buffers(pa.binary(), 2 * len(x), [None, pa.py_buffer(bounds), pa.py_buffer(data)])

    def lines(self, which: np.ndarray) -> pa.Array:
        return self.items.take(pa.array(2 * which))

    def joined(self, which: np.ndarray, counts: np.ndarray, size: np.ndarray) -> pa.Array:
        """Records' values of so many of the lines each."""
        lines = self.lines(which)
        bounds = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(size, out=bounds[1:])
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds), lines.buffers()[2] or pa.py_buffer(b"")])


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of an array that starts at its buffer's start."""
    bounds = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8, int(bounds[-1])), bounds


def outside(variant: str, values: pa.Array, allowed: bytes | tuple[int, int], place: Callable) -> dict[int, ReadError]:
    """The first byte outside what is allowed of each value that has one, as an error at place(record, bytes before it in all values)."""
    raw, bounds = bytes_of(values)
    if isinstance(allowed, tuple):
        low, high = allowed
        if not len(raw) or raw.min() >= low and raw.max() <= high:
            return {}
        at = np.flatnonzero((raw < low) | (raw > high))
    else:
        if not raw.tobytes().translate(None, allowed):
            return {}
        good = np.zeros(256, bool)
        good[list(allowed)] = True
        at = np.flatnonzero(~good[raw])
    record, one = np.unique(np.searchsorted(bounds, at, side="right") - 1, return_index=True)
    at = at[one]
    return {int(r): ReadError(variant, int(o), byte=int(b)) for r, o, b in zip(record, place(record, at, bounds), raw[at], strict=True)}


def built(data: bytes, x: Index, at: int, heads: np.ndarray, separator: np.ndarray | None, want: tuple[str, ...], checks: Checks) -> Records:
    """The records that start at the lines named; separator has their separator lines where they are wrapped."""
    cutter = Cutter(data, x, heads) if want or checks.bases is not None or checks.quals else None
    needed = {*want, *(["seq"] if checks.bases is not None else []), *(["qual"] if checks.quals else [])}
    middle = heads + 2 if separator is None else separator
    out = Records(None, None, None, x.starts[heads] + at, x.starts[np.minimum(heads + 1, len(x) - 1)] + at, x.starts[np.minimum(middle + 1, len(x) - 1)] + at)
    if "header" in needed:
        out.header = cutter.lines(heads)
    where = {}
    if separator is None:
        out.size = x.lens[heads + 1]
        for name, line in (("seq", heads + 1), ("qual", heads + 3)):
            if name in needed:
                setattr(out, name, cutter.lines(line))
            where[name] = lambda record, pos, bounds, line=line: x.starts[line[record]] + at + pos - bounds[record]
    else:
        total = np.concatenate([[0], np.cumsum(x.lens)])
        out.size = total[middle] - total[heads + 1]
        stop = np.where(out.size > 0, np.searchsorted(total, total[middle + 1] + out.size), middle + 1)
        for name, begin, end in (("seq", heads + 1, middle), ("qual", middle + 1, stop)):
            counts = end - begin
            which = ranged(begin, counts)
            if name in needed:
                setattr(out, name, cutter.joined(which, counts, out.size))
            bounds = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=bounds[1:])
            segments = pa.StructArray.from_arrays([pa.array(x.starts[which] + at, pa.int64()), pa.array(x.lens[which].astype(np.int32))], ["offset", "len"])
            setattr(out, f"{name}_segs", pa.ListArray.from_arrays(pa.array(bounds), segments))
            before = np.concatenate([[0], np.cumsum(x.lens[which])])

            def place(record, pos, bounds, which=which, before=before):
                k = np.searchsorted(before, pos, side="right") - 1
                return x.starts[which[k]] + at + pos - before[k]

            where[name] = place
    bad: dict[int, ReadError] = {}
    if checks.quals:
        bad |= outside("InvalidQuality", out.qual, checks.quals, where["qual"])
    if checks.bases is not None:
        bad |= outside("InvalidBase", out.seq, checks.bases, where["seq"])
    out.failing = sorted(bad.items())
    for name in needed - set(want):
        setattr(out, name, None)
    return out


def one_by_one(data: bytes, at: int, place: int, whole: bool, wrapped: bool, most: int | None = None) -> tuple[Records, int]:
    """Records read line by line from a place in a buffer, up to `most` of them, an error as the last; and the place after them."""
    out = Records(seq_segs=[], qual_segs=[]) if wrapped else Records()
    lines, used, take = Lines(data, at, whole, place), place, multi if wrapped else single
    try:
        while most is None or len(out) < most:
            if (got := take(lines)) is None:
                used = len(data)
                break
            for column, value in zip((out.header, out.seq, out.qual, out.header_offset, out.seq_offset, out.qual_offset), got, strict=False):
                column.append(value)
            out.size.append(len(got[1]))
            if wrapped:
                out.seq_segs.append([{"offset": a, "len": b} for a, b in got[6]])
                out.qual_segs.append([{"offset": a, "len": b} for a, b in got[7]])
            out.lines += data.count(b"\n", used, lines.place)
            used = lines.place
    except NeedMore:
        pass
    except ReadError as e:
        out.error = e
    return out, used


def framed(
    chunks: Iterator[bytes], at: int = 0, wrapped: bool = False, end: Callable[[], int | None] | int | None = None, want: tuple[str, ...] = FIELDS, checks: Checks | None = None
) -> Iterator[Records]:
    """Records of decoded chunks that start at offset `at`, up to the first record that starts at `end` or later, with the fields wanted.

    end may be told once chunks that reach it have come. An error ends the records: it comes in the last Records, with the number of its record among those framed here.
    """
    data, ended, count, failed = b"", False, 0, None  # failed: what the chunks ended with, due once the records before it are out
    stop, checks = end if callable(end) else lambda: end, checks or Checks()
    while True:
        parts, size = [data], len(data)
        try:
            while not ended and size < max(WINDOW, 2 * len(data)):
                got = next(chunks, None)
                if got is None:
                    ended = True
                else:
                    parts.append(got)
                    size += len(got)
                    if (cutoff := stop()) is not None and at + size > cutoff:
                        break
        except ReadError as e:
            failed, ended = e, True
        data = b"".join(parts)
        whole = ended and failed is None
        out, used, last = Records(), 0, False
        if len(data) <= MOST:
            x = indexed(data, whole)
            heads, separator, j = np.empty(0, np.int64), None, 0
            if len(x):
                fast = None if wrapped else regular(x)
                if fast:
                    heads, j = fast
                    if j < len(x) and (x.lens[j:] == 0).any():
                        fast = None  # blank lines after the last record
                if not fast:
                    after, separator = following_multi(x) if wrapped else (following_single(x), None)
                    heads, j = chained(x, after)
            used = int(x.starts[j]) if j < len(x) else x.used
            cutoff = stop()
            if cutoff is not None and len(heads) and x.starts[heads[-1]] + at >= cutoff:
                j = int(heads[(k := int(np.searchsorted(x.starts[heads], cutoff - at)))])
                heads, used, last = heads[:k], int(x.starts[j]), True
            if len(heads):
                out = built(data, x, at, heads, separator[heads] if wrapped else None, want, checks)
            out.lines = j - (1 if data and j == len(x) and x.used == len(data) and not data.endswith(b"\n") else 0)  # the stream's last line may have no end
            if not last and j < len(x) and (cutoff is None or used + at < cutoff):
                # not a record, or one whose end is not here: read on its own, to tell which
                odd, _ = one_by_one(data, at, used, whole, wrapped, 1)
                out.error = odd.error
            last = last or cutoff is not None and used + at >= cutoff
        else:
            out, used = one_by_one(data, at, 0, whole, wrapped)
            cutoff = stop()
            if cutoff is not None and len(out) and out.header_offset[-1] >= cutoff:
                out.cut(int(np.searchsorted(np.asarray(out.header_offset), cutoff)))
                out.error, last = None, True
            for k in range(len(out)):
                bad = long_check(out, k, checks)
                out.failing += [(k, bad)] if bad else []
        if out.error:
            out.error = out.error.numbered(count + len(out) + 1)
        ahead = len(data) - used
        data, at, count = data[used:], at + used, count + len(out)
        if out.error is None and failed is not None and not last:
            out.error = failed.numbered(count + 1)
        if len(out) or out.error or out.lines:
            yield out
        if out.error or last or ended and (not ahead or failed is not None):
            return


def long_check(out: Records, k: int, checks: Checks) -> ReadError | None:
    """The first bad byte of a record that is held as Python bytes."""
    for variant, name, allowed in (("InvalidBase", "seq", checks.bases), ("InvalidQuality", "qual", bytes(range(max(0, checks.quals[0]), min(255, checks.quals[1]) + 1)) if checks.quals else None)):
        text = getattr(out, name)[k]
        if allowed is not None and (odd := text.translate(None, allowed)):
            place, segs = text.index(odd[:1]), getattr(out, f"{name}_segs")
            offset = getattr(out, f"{name}_offset")[k] + place
            if segs:
                for s in segs[k]:
                    if place < s["len"]:
                        offset = s["offset"] + place
                        break
                    place -= s["len"]
            return ReadError(variant, offset, byte=odd[0])
    return None


class Synchroniser:
    """Finds the first line at which records follow one another, from lines given piece by piece; it keeps places and lengths of lines, never their bytes.

    Every line may head a record; each such hypothesis is followed over all lines that are known. The first one from which CONFIRM records, or all up to
    the end of the stream, follow is the start, unless lines within its first record start chains of their own: then
    the start is the first line on which all chains that do not break agree. With `lead`, so many records of the chain that have a sequence come before the start: in a wrapped file, the last lines
    of qualities can pass for a record of their own whose end is the true one's, but hardly several times in a row. What is not settled within SYNC_LINES lines (a candidate among them may run on) and SYNC_BYTES bytes is given up.
    """

    def __init__(self, wrapped: bool, lines: int = SYNC_LINES, most: int = SYNC_BYTES, lead: int = 0):
        self.wrapped, self.lines, self.most, self.lead = wrapped, lines, most, lead
        self.parts: list[Index] = []
        self.tail, self.tail_at, self.taken = b"", 0, 0

    def found(self, chunks: Iterator[bytes], at: int) -> tuple[int | None, int]:
        """(start, place reached) for chunks of the stream from offset `at`, where a line starts; start is None if it was given up, or if there is none before the end.

        An error in the chunks ends what is known, as if no more were to come but no end either.
        """
        self.tail_at, ended, cut, wait = at, False, False, SURE if self.wrapped else SOON
        while True:
            size, parts = 0, [self.tail]
            try:
                while size < wait:
                    got = next(chunks, None)
                    if got is None:
                        ended = True
                        break
                    parts.append(got)
                    size += len(got)
            except ReadError:
                cut = True
            self.tail = b"".join(parts)
            self.taken += size
            self.add(ended)
            start = self.settled(ended, ended or cut or self.taken >= SURE)
            if start is not None or ended or cut or self.taken > self.most:
                return start, self.reached(ended)
            if sum(map(len, self.parts)) > self.lines and not self.waiting:
                return None, self.reached(False)
            wait = max(wait, self.taken)

    def add(self, ended: bool) -> None:
        x = indexed(self.tail, ended)
        if len(x):
            x.starts += self.tail_at
            self.parts.append(x)
            self.tail, self.tail_at = self.tail[x.used :], self.tail_at + x.used

    def reached(self, ended: bool) -> int:
        """Where reading goes on if no start is found: the end, or the line after those that were looked at."""
        if ended or not self.parts:
            return self.tail_at + len(self.tail) if ended else self.tail_at
        starts = np.concatenate([p.starts for p in self.parts])
        return int(starts[self.lines]) if len(starts) > self.lines else self.tail_at

    def settled(self, ended: bool, sure: bool) -> int | None:
        self.waiting = False
        if not self.parts:
            return None
        x = Index(*(np.concatenate([getattr(p, f) for p in self.parts]) for f in ("starts", "lens", "first")), 0, ended)
        self.parts = [x]
        after = (following_multi(x)[0] if self.wrapped else following_single(x)).tolist()
        blank, n = (x.lens == 0).tolist(), len(x)

        def follow(j: int, most: int) -> tuple[list[int], bool, int]:
            """(header lines, whether they end in what is not known or the end of the stream, line reached)"""
            heads = []
            while len(heads) < most:
                while j < n and blank[j]:
                    j += 1
                if j >= n or after[j] < 0:
                    return heads, j >= n or after[j] == OPEN, j
                heads.append(j)
                j = after[j]
            return heads, True, j

        for j in np.flatnonzero(x.first[: self.lines] == 64).tolist():
            if after[j] == BAD:
                continue
            heads, alive, _ = follow(j, CONFIRM)
            if not alive:
                continue
            if len(heads) < CONFIRM and not ended:
                self.waiting = True
                return None
            if not heads:
                continue
            rivals = [k for k in range(j + 1, min(after[j], n)) if x.first[k] == 64 and after[k] != BAD and follow(k, CONFIRM)[1]]
            if not rivals and not self.lead:
                return int(x.starts[j])
            if not sure:  # what comes next may tell which of them is one
                self.waiting = True
                return None
            # of what may be true, what lasts; the lines on which all of that agrees
            chains = [follow(k, n) for k in (j, *rivals)]
            lasting = [c for c in chains if c[1]] or [c for c in chains if c[2] == max(y[2] for y in chains)]
            common, led = sorted(set(lasting[0][0]).intersection(*(c[0] for c in lasting[1:]))), 0
            self.waiting = not ended
            for place, head in enumerate(common):
                if led >= self.lead:
                    return int(x.starts[head]) if ended or len(common) >= place + CONFIRM else None
                led += after[head] > head + 3
            return None
        # a header may stand in the line that is not whole yet; beyond the lines of the budget none is looked for
        self.waiting = n <= self.lines
        return None
