"""Reading and writing reads: the facade over the data source `fastq`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SCHEMA, ReadError, parsed
from .operators import pairing as P
from .operators import reads as R
from .sources import codecs, framing, sinks
from .sources.fastq import ERROR_TYPE, WRITE_OPTIONS, Options, Place, known, most_splits, planned, register, run_bytes, sized, split_size
from .sources.grid import one_bgzf, one_file


def options_of(kw: dict) -> dict:
    return {k: str(v) for k, v in kw.items() if v is not None}


def source(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("fastq").options(**options).load(path)


def read_reads(
    spark: SparkSession, path: str | list[str], mode: str = "failfast", numbered: bool = False, validation: str = "none", alphabet: str = "iupac", quality: str = "phred33", **options
) -> DataFrame:
    """Reads of a file, a folder and those below it, or a list. mode: failfast raises; permissive adds an error column and, where a split meets an error, a row that tells it;
    later splits of the file go on; prefix gives each file's rows before its first error.

    numbered: records count within the file and offsets in its whole stream; a scan that builds no field counts the splits of files that have several first.
    validation (bases, qualities, bases_and_qualities), done by the scan, makes a bad base or quality an error, by alphabet and quality: in permissive mode the row keeps its read; it
    numbers the reads but in failfast mode. Other options are those of the data source; unknown ones are refused.
    """
    if mode not in ("failfast", "permissive", "prefix"):
        raise ValueError("mode must be failfast, permissive or prefix")
    path, options = path if isinstance(path, str) else ",".join(path), options_of(options)
    checked = R.level(validation) != "none"
    checks = {"validation": validation, "alphabet": alphabet, "quality": quality} if checked else {}
    df = source(spark, path, **options, **checks, mode="failfast" if mode == "failfast" else "permissive")
    uncut = {k: v for k, v in options.items() if k.lower() != "columns"}
    counted = numbered or checked and mode != "failfast"
    small = (counted or mode == "prefix") and most_splits(path, options) <= R.SPLITS
    if mode == "prefix":
        if not {"file", "split_id", "record"} <= set(df.columns):
            raise ValueError("prefix mode needs the columns file, split_id and record")
        # in order of file, split and record, which a scan finds that builds no field but to check it
        place = F.struct("split_id", "record")
        first = source(spark, path, **uncut, **checks, mode="permissive", columns="file,split_id,record").where("error IS NOT NULL").groupBy("file").agg(F.min(place).alias("_first"))
        df = df.where("error IS NULL").join(F.broadcast(first) if small else first, "file", "left").where(F.col("_first").isNull() | (place < F.col("_first"))).drop("_first", "error")
    if counted:
        df = R.number_records(df, source(spark, path, **uncut, summary="many"), small=small)
    return df


def read_totals(spark: SparkSession, path: str | list[str], qualities: bool = False, **options) -> DataFrame:
    """One row: records, bases and line feeds of all files, and least and greatest quality where asked for, summed up by the scan, which hands over one row a split. Errors are raised."""
    path = path if isinstance(path, str) else ",".join(path)
    df = source(spark, path, **options_of(options), summary="qualities" if qualities else "true")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "bases", "lines")]
    out = df.agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.when(F.col("failed"), F.col("file"))).alias("bad"))
    fine = F.when(F.col("bad").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("totals of a file with an error: "), F.col("bad"))))
    return out.where(fine).select("records", "bases", "lines", *(["low", "high"] if qualities else []))


def marks(spark: SparkSession, path: str, options: dict) -> list:
    """The splits of each file, counted by a scan that builds no field, for files of several splits alone."""
    uncut = {k: v for k, v in options.items() if k.lower() not in ("columns", "validation", "alphabet", "quality")}
    return P.anchors(source(spark, path, **uncut, summary="many"), P.files_of(path))


def splits_a_task(paths: list[str], options: dict) -> int:
    return max(1, run_bytes(max(sum(n for _, n in sized(p)) for p in paths)) // split_size(options))


def read_pairs(spark: SparkSession, first: str | list[str], second: str | list[str], check_ids: bool = False, **options) -> DataFrame:
    """The reads of two files, or of two lists of files in order, as pairs (file_no, record, r1, r2, error), with every option for both mates.

    Splits are counted when this is called; then a task reads the same records of both mates, and no read is shuffled. A malformed read is the last of its pair of files. Beyond SPLITS splits
    a mate, positions are joined by shuffle. Errors are told by place in the order of a reader of both; `operators.reads.checked_pairs` raises the first.
    """
    paths = [p if isinstance(p, str) else ",".join(p) for p in (first, second)]
    given = options_of(options)
    if any(most_splits(p, given) > R.SPLITS for p in paths):
        return R.pairs(*(read_reads(spark, p, mode="permissive", numbered=True, **options) for p in paths), check_ids=check_ids)
    plan = P.zipped_plan(*(marks(spark, p, given) for p in paths), tuple(map(P.files_of, paths)), splits_a_task(paths, given))
    return P.loaded(spark, plan, given, check_ids).select("file_no", "record", "r1", "r2", "error")


def read_interleaved(spark: SparkSession, path: str | list[str], check_ids: bool = False, **options) -> DataFrame:
    """Consecutive reads of each file as pairs (file_no, file, record, r1, r2, error): a task reads on to the mate of its last read, and no read is shuffled."""
    path, given = path if isinstance(path, str) else ",".join(path), options_of(options)
    if most_splits(path, given) > R.SPLITS:
        return R.interleaved(read_reads(spark, path, mode="permissive", numbered=True, **options), check_ids)
    return P.loaded(spark, P.folded_plan(marks(spark, path, given), P.files_of(path), splits_a_task([path], given)), given, check_ids)


def starts_record(path: str, offset: int, wrapped: bool = False) -> bool:
    """Whether records follow one another from an offset (bytes; in BGZF a virtual offset) of a file: the test that finds splits."""
    o = Options({"startOffset": str(offset), "resync": "true", "format": "multiline" if wrapped else "single"})
    (split,) = planned(path, Options({"startOffset": str(offset), "splittable": "false"}))
    if split.failed:
        raise split.failed
    split.exact_start = False
    inside = offset & 0xFFFF if split.kind == "bgzf" else offset
    place = Place(split, o)
    return place.confirmed and place.start == inside


def stream_reads(spark: SparkSession, path: str, **options) -> DataFrame:
    """A streaming DataFrame of the reads of files as they appear in a folder, with the options of the data source: mode (failfast or permissive), format, validation and the rest.

    log: a folder of this stream's own, so that offsets stay small however many files there are; with it, follow=True reads on in files that grow, and maxFilesPerTrigger bounds a batch.
    """
    register(spark)
    return spark.readStream.format("fastq").options(**options_of(options)).load(path)


def write_reads(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Writes header, seq and qual as a folder of parts, or as one file with singleFile=True, in the order of the partitions.

    One file may have any size, unless singleFileLimit bounds it: parts are written beside it first and copied to their places by tasks. One BGZF file is that of a single writer, byte for byte:
    its parts are plain, their sizes place its blocks, and tasks compress those.
    """
    spark, given = df.sparkSession, options_of(options)
    register(spark)
    lower = {k.lower(): v for k, v in given.items()}
    rows = df.select(*(F.col(c).cast("binary").alias(c) for c in ("header", "seq", "qual")))
    kind = lower.get("compression", sinks.by_extension(path)).lower()
    if lower.get("singlefile", "").lower() in ("true", "1", "yes") and kind in sinks.SUFFIX:
        known(given, WRITE_OPTIONS)
        level, limit = sinks.checked_level(kind, lower.get("level")), int(lower["singlefilelimit"]) if "singlefilelimit" in lower else None
        beside = f"{path}.parts-{uuid.uuid4().hex[:12]}"
        system, inner = sinks.file_system(beside)
        try:
            own = {"compression": "plain"} if kind == "bgzf" else {"compression": kind, "level": level}
            write_reads(df, beside, **own, **{k: lower[k] for k in ("validation", "alphabet", "quality") if k in lower})
            if kind == "bgzf":
                one_bgzf(spark, sized(beside), path, level, limit)
            else:
                one_file(spark, sized(beside), path, kind, level, limit)
        finally:
            if system.get_file_info(inner).type.name == "Directory":
                system.delete_dir(inner)
        return
    rows.write.format("fastq").mode(mode).options(**given).save(path)


def concatenated(path: str, df: DataFrame, **options) -> None:
    write_reads(df, path, singleFile=True, **options)


NAMES = ["key", "header", "seq", "qual", "record", "header_offset", "seq_offset", "qual_offset", "error"]


def parse_bytes(df: DataFrame, value_col: str = "content", key_col: str | None = None, wrapped: bool = False) -> DataFrame:
    """Reads of binary values in memory, whatever their compression: (key, header, seq, qual, record, offsets, error)."""
    import numpy as np
    import pyarrow as pa

    key = F.col(key_col) if key_col else F.lit(None).cast("string")
    rows = df.select(key.cast("string").alias("key"), F.col(value_col).cast("binary").alias("value"))

    def run(batches):
        for b in batches:
            held, size = [], 0
            for k, v in zip(b["key"].to_pylist(), b["value"].to_pylist(), strict=True):
                v = v or b""
                if wrapped or len(v) > framing.WINDOW or codecs.sniff(v[: codecs.SNIFFED]) != "plain":
                    yield from together(held)
                    yield from parsed_value(k, v, wrapped)
                    held, size = [], 0
                elif v:
                    if size + len(v) > framing.WINDOW:
                        yield from together(held)
                        held, size = [], 0
                    held.append((k, v))
                    size += len(v)
            yield from together(held)

    def together(held: list[tuple]):
        """Plain values as one text, if every four lines of it are a record and every value starts with one; else by halves, down to single values."""
        if len(held) < 2:
            for k, v in held:
                yield from parsed_value(k, v, False)
            return
        data = b"".join(v if v.endswith(b"\n") else v + b"\n" for _, v in held)
        starts = np.zeros(len(held) + 1, np.int64)
        np.cumsum([len(v) + (not v.endswith(b"\n")) for _, v in held], out=starts[1:])
        x = framing.indexed(data, True)
        found = framing.regular(x)
        if found is None or found[1] < len(x) or not np.isin(starts[:-1], x.starts[found[0]], assume_unique=True).all():
            yield from together(held[: len(held) // 2])
            yield from together(held[len(held) // 2 :])
            return
        got = framing.built(data, x, 0, found[0], None, framing.FIELDS, framing.Checks())
        first = np.searchsorted(got.header_offset, starts)
        counts, n = np.diff(first), len(got)
        which, before = np.repeat(np.arange(len(held)), counts), np.repeat(starts[:-1], counts)
        keys = pa.array([k for k, _ in held], pa.string()).take(pa.array(which))
        places = [pa.array(o - before) for o in (got.header_offset, got.seq_offset, got.qual_offset)]
        yield pa.RecordBatch.from_arrays([keys, got.header, got.seq, got.qual, pa.array(np.arange(1, n + 1) - np.repeat(first[:-1], counts)), *places, pa.nulls(n, ERROR_TYPE)], NAMES)

    def parsed_value(k, value: bytes, wrapped: bool):
        kind = codecs.sniff(value[: codecs.SNIFFED])
        if kind in ("bzip2", "xz"):
            raise ReadError("Unsupported", detail=kind)
        chunks = iter([value]) if kind == "plain" else codecs.unzstd(iter([value])) if kind == "zstd" else codecs.unblocked(value) if kind == "bgzf" else codecs.gunzipped(iter([value]))
        count = 0
        for got in framing.framed(chunks, 0, wrapped):
            n = len(got)
            columns = [[k] * n, *map(got.values, framing.FIELDS), list(range(count + 1, count + n + 1)), *map(list, (got.header_offset, got.seq_offset, got.qual_offset)), [None] * n]
            if got.error:
                for c, x in zip(columns, (k, None, None, None, got.error.record, got.error.offset, None, None, got.error.row()), strict=True):
                    c.append(x)
            count += n
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), ERROR_TYPE]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)

    error = f"struct<{SCHEMA.replace(', ', ',').replace(' ', ':')}>"
    return rows.mapInArrow(run, f"key string, header binary, seq binary, qual binary, record bigint, header_offset bigint, seq_offset bigint, qual_offset bigint, error {error}")


def error_of(exception: Exception) -> ReadError | None:
    """The error of a read or write that Spark has wrapped."""
    return parsed(str(exception))


__all__ = ["concatenated", "error_of", "parse_bytes", "read_interleaved", "read_pairs", "read_reads", "read_totals", "starts_record", "stream_reads", "write_reads"]
