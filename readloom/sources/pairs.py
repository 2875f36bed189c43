"""The data source `fastq_pairs`: reads of two files, or of one that alternates, side by side.

A task reads a range of records of both mates at once, each from an exact offset, so that no read is shuffled. The ranges come with the option plan, which
`operators.pairing` makes from the summaries of the scans.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, InputPartition

from ..errors import SCHEMA as ERROR_SCHEMA
from .fastq import ERROR_TYPE, Options, batches, planned

FIELDS = ("header", "seq", "qual", "header_offset", "error")
ERROR = f"struct<{ERROR_SCHEMA.replace(' ', ':').replace(',:', ',')}>"
MATE = f"struct<header:binary,seq:binary,qual:binary,header_offset:bigint,error:{ERROR}>"
SCHEMA = f"file_no int, file string, record bigint, r1 {MATE}, r2 {MATE}"
TYPE = pa.struct([("header", pa.binary()), ("seq", pa.binary()), ("qual", pa.binary()), ("header_offset", pa.int64()), ("error", ERROR_TYPE)])


@dataclass
class Side:
    """Where a mate's records of a range are read: from record `number` on, which starts at `offset` of the file (None: at its start) and has `before` decoded bytes before the place that
    offsets count from."""

    file: str | None
    number: int = 1
    offset: int | None = None
    before: int = 0


@dataclass
class Range(InputPartition):
    """Records first to first + count - 1 of a file or of two (all from first on if count is None); file_no names the pair of files."""

    file_no: int
    first: int
    count: int | None
    one: Side
    two: Side | None = None


def mates(side: Side, first: int, count: int | None, options: dict) -> Iterator[pa.StructArray]:
    """A side's reads from a record on; what is malformed ends them, as a read that has an error and nothing else."""
    if side.file is None:
        return
    own = {"mode": "permissive", "splittable": "false", "columns": "header,seq,qual,header_offset"} | ({} if side.offset is None else {"startOffset": str(side.offset)})
    o = Options(CaseInsensitiveDict({**options, **{k.lower(): v for k, v in own.items()}}))
    number = side.number
    for split in planned(side.file, o):
        for b in batches(split, o):
            skip = min(max(0, first - number), b.num_rows)
            keep = b.num_rows - skip if count is None else min(b.num_rows - skip, first + count - number - skip)
            if keep > 0:
                b = b.slice(skip, keep)
                broken = b["header"].null_count > 0
                offsets = b["header_offset"] if broken or not side.before else pa.array(b["header_offset"].to_numpy() + side.before)
                errors = b["error"]
                if errors.null_count < len(errors):
                    told = [e and e | {"record": number + skip + k, "offset": e["offset"] + (0 if broken else side.before)} for k, e in enumerate(errors.to_pylist())]
                    errors = pa.array(told, ERROR_TYPE)
                yield pa.StructArray.from_arrays([b["header"], b["seq"], b["qual"], offsets, errors], fields=list(TYPE))
                if broken:
                    return
            number += skip + max(keep, 0)
            if count is not None and number >= first + count:
                return


def row_batch(part: Range, record: np.ndarray, one, two) -> pa.RecordBatch:
    n = len(record)
    numbers, file = pa.array(np.full(n, part.file_no, np.int32)), pa.repeat(pa.scalar(part.one.file or (part.two and part.two.file) or "", pa.string()), n)
    return pa.RecordBatch.from_arrays([numbers, file, pa.array(record), one, two], ["file_no", "file", "record", "r1", "r2"])


def zipped(part: Range, options: dict) -> Iterator[pa.RecordBatch]:
    """The n-th read of either file with the n-th of the other; what one alone has stands beside null."""
    sides, held, ended, at = [mates(s, part.first, part.count, options) for s in (part.one, part.two)], [None, None], [False, False], part.first
    while True:
        for k in (0, 1):
            while not ended[k] and (held[k] is None or not len(held[k])):
                held[k] = next(sides[k], None)
                ended[k] = held[k] is None
        live = [h for h in held if h is not None and len(h)]
        if not live:
            return
        n = min(map(len, live))
        cut = [h.slice(0, n) if h is not None and len(h) else pa.nulls(n, TYPE) for h in held]
        yield row_batch(part, np.arange(at, at + n), *cut)
        if any(h.field("header").null_count for h in live if len(h) == n):
            return  # a malformed read is the last of its pair of files
        held, at = [h.slice(n) if h is not None and len(h) else None for h in held], at + n


def folded(part: Range, options: dict) -> Iterator[pa.RecordBatch]:
    """Reads of one file two by two; a last odd one stands beside null."""
    rest, at = None, (part.first + 1) // 2
    for got in mates(part.one, part.first, part.count, options):
        got = pa.concat_arrays([rest, got]) if rest is not None and len(rest) else got
        n = len(got) // 2
        if n:
            yield row_batch(part, np.arange(at, at + n), *(got.take(pa.array(np.arange(k, 2 * n, 2))) for k in (0, 1)))
        rest, at = got.slice(2 * n), at + n
    if rest is not None and len(rest):
        yield row_batch(part, np.array([at]), rest, pa.nulls(1, TYPE))


class PairReader(DataSourceReader):
    def __init__(self, options):
        self.plan, self.options = json.loads(options["plan"]), {k.lower(): v for k, v in options.items() if k.lower() != "plan"}

    def partitions(self):
        return [Range(no, first, count, Side(*one), Side(*two) if two else None) for no, first, count, one, two in self.plan] or [Range(0, 1, 0, Side(None), None)]

    def read(self, partition):
        return (zipped if partition.two else folded)(partition, self.options)


class PairSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PairReader(self.options)
