"""Operators on DataFrames of reads: numbering, validation, pairing, and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SCHEMA as ERROR_SCHEMA
from ..errors import ReadError
from ..functions import columns as C

MODES = ("none", "bases", "qualities", "basesandqualities")


#: Splits whose counts are broadcast and held by the driver, which holds the splits themselves as well; beyond that they are joined by shuffle.
SPLITS = 200_000


def number_records(reads: DataFrame, counts: DataFrame | None = None, splits: int = SPLITS, small: bool | None = None) -> DataFrame:
    """record becomes the number within the file, from 1: local numbers plus the records of earlier splits.

    counts has a row a split (file, split_id, records, bytes), as a scan with the option summary gives it without building a field; by default
    the reads are counted. Offsets, which count from the split in BGZF files of more than one split, become those of the whole stream by `bytes`. Up to `splits` rows
    the counts are broadcast, so that no read is shuffled; small tells whether there are so few, where the caller knows, and then nothing runs yet.
    """
    if counts is None:
        counts = reads.groupBy("file", "split_id").agg(F.count("*").alias("records")).withColumn("bytes", F.lit(0).cast("long"))
    counts = counts.select("file", "split_id", "records", "bytes")
    if small is None:
        some = counts.limit(splits + 1).collect()
        small = len(some) <= splits
        counts = reads.sparkSession.createDataFrame(some, counts.schema) if small else counts
    earlier = Window.partitionBy("file").orderBy("split_id").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "split_id", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("records", "bytes")))
    out = reads.join(F.broadcast(before) if small else before, ["file", "split_id"], "left").withColumn("record", F.col("record") + F.coalesce("_records", F.lit(0)))
    moved = {c: F.col(c) + F.coalesce("_bytes", F.lit(0)) for c in ("header_offset", "seq_offset", "qual_offset") if c in reads.columns}
    if "error" in reads.columns:  # where it is of malformed text, its offset is one of the whole stream already; its number is not
        content = F.col("error.variant").isin("InvalidBase", "InvalidQuality")
        moved["header_offset"] = F.when(F.col("error").isNull() | content, moved["header_offset"]).otherwise(F.col("header_offset")) if "header_offset" in moved else None
        error = F.col("error").withField("record", F.col("record"))
        moved["error"] = F.when(content, error.withField("offset", F.col("error.offset") + F.coalesce("_bytes", F.lit(0)))).when(F.col("error").isNotNull(), error)
    for field in ("seq_segs", "qual_segs"):
        if field in reads.columns:
            moved[field] = F.transform(field, lambda x: x.withField("offset", x["offset"] + F.coalesce("_bytes", F.lit(0))))
    return out.withColumns({k: v for k, v in moved.items() if v is not None}).select(*reads.columns)


def level(mode: str) -> str:
    """A validation mode by any of its spellings."""
    found = mode.lower().replace("_", "").replace("-", "")
    if found not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return found


def invalid_text(invalid: Column) -> Column:
    """The text of a row of `invalid`, as ReadError has it."""
    byte = invalid["byte"]
    shown = F.when(byte.between(0x21, 0x7E), F.concat(F.lit("'"), F.chr(byte), F.lit("'"))).otherwise(F.lit("non-printable"))
    kind = F.when(invalid["variant"] == "InvalidBase", "base").otherwise("quality")
    return F.format_string("invalid %s byte 0x%02x (%s) at offset %d (record %d)", kind, byte, shown, invalid["offset"], invalid["record"])


def validation(reads: DataFrame, mode: str = "none", alphabet: str = "iupac", quality: str = "phred33", wrapped: bool = False) -> DataFrame:
    """reads with the column `invalid` (variant, offset, record, byte), null where a read passes; bases are checked first.

    With mode none no expression is added but the null. Offsets are those of the bad byte in the stream.
    """
    wanted = level(mode)
    kind = "struct<variant:string,offset:bigint,record:bigint,byte:int>"
    found: list[Column] = []
    for on, variant, field, at in (
        ("bases" in wanted, "InvalidBase", "seq", lambda t: C.first_bad_base(t, alphabet)),
        ("qualities" in wanted, "InvalidQuality", "qual", lambda t: C.first_bad_quality(t, quality)),
    ):
        if on:
            text = C.chars(field)
            index = at(text)
            start = F.col(f"{field}_offset")
            offset = C.map_offset(F.col(f"{field}_segs"), index, start) if wrapped else start + index
            byte = F.ascii(F.substring(text, index + 1, F.lit(1)))
            row = F.struct(F.lit(variant).alias("variant"), offset.alias("offset"), F.col("record").alias("record"), byte.alias("byte"))
            found.append(F.when(index.isNotNull(), row))
    return reads.withColumn("invalid", F.coalesce(*found, F.lit(None)).cast(kind) if found else F.lit(None).cast(kind))


def first_invalid(validated: DataFrame) -> ReadError | None:
    """The first failing read of a single file by place, as a reader of the file would meet it."""
    row = validated.where("invalid IS NOT NULL").agg(F.min(F.struct("file", "header_offset", "invalid"))).first()[0]
    return None if row is None else ReadError(row["invalid"]["variant"], row["invalid"]["offset"], row["invalid"]["record"], byte=row["invalid"]["byte"])


def guess_encoding(reads: DataFrame) -> DataFrame:
    """One row: phred33 if a code is below 64, phred64 if one is above 74, else null; null without qualities."""
    codes = F.transform(F.filter(F.split(C.chars("qual"), ""), lambda c: c != ""), lambda c: F.ascii(c))
    return encoding_of(reads.select(F.array_min(codes).alias("low"), F.array_max(codes).alias("high")).agg(F.min("low").alias("low"), F.max("high").alias("high")))


def encoding_of(ends: DataFrame) -> DataFrame:
    """The guess for a row of the least and greatest code (low, high)."""
    return ends.select(F.when(F.col("low") < 64, "phred33").when(F.col("high") > 74, "phred64").alias("encoding"))


def totals(reads: DataFrame) -> DataFrame:
    """One row: records and bases."""
    return reads.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))


def newlines(values: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: the line feeds of all values."""
    return values.agg(F.coalesce(F.sum(C.count_lf(F.col(text_col))), F.lit(0)).cast("long").alias("lines"))


def pairs(r1: DataFrame, r2: DataFrame, check_ids: bool = False, fields: tuple[str, ...] = ("header", "seq", "qual")) -> DataFrame:
    """The n-th read of one file with the n-th of another, and so for every file of both sides in order: (file_no, record, r1, r2, error).

    Both inputs are numbered. error is null in good pairs, and else says what a reader of both files would meet there first: an error of R1's
    read, one of R2's, the mate that has no read there, or two canonical ids that differ, where ids are checked. Positions are joined, never ids: ids need not be unique.
    """
    sides = []
    for df, name in ((r1, "r1"), (r2, "r2")):
        error = F.col("error") if "error" in df.columns else F.lit(None).cast(f"struct<{ERROR_SCHEMA.replace(', ', ',').replace(' ', ':')}>")
        sides.append(df.select("file_no", "record", F.struct(*fields, "header_offset", error.alias("error")).alias(name)))
    return judged(sides[0].join(sides[1], ["file_no", "record"], "full_outer"), check_ids)


def interleaved(reads: DataFrame, check_ids: bool = False, fields: tuple[str, ...] = ("header", "seq", "qual")) -> DataFrame:
    """Consecutive reads of a file as pairs: (file, record, r1, r2, error), record being the number of the pair."""
    error = F.col("error") if "error" in reads.columns else F.lit(None).cast(f"struct<{ERROR_SCHEMA.replace(', ', ',').replace(' ', ':')}>")
    one = F.struct(*fields, "header_offset", error.alias("error"))
    odd = F.col("record") % 2 == 1
    folded = reads.groupBy("file", F.expr("(record + 1) div 2").alias("_pair")).agg(
        F.max(F.when(odd, one)).alias("r1"), F.max(F.when(~odd, one)).alias("r2")
    )
    return judged(folded.withColumnRenamed("_pair", "record"), check_ids)


def judged(paired: DataFrame, check_ids: bool) -> DataFrame:
    """Adds error: the reads' own errors first, R1's before R2's, then a missing mate, then ids."""
    error = F.when(F.col("r1.error").isNotNull(), F.concat(F.lit("R1: "), F.col("r1.error.variant"))).when(F.col("r2.error").isNotNull(), F.concat(F.lit("R2: "), F.col("r2.error.variant")))
    error = error.when(F.col("r1").isNull(), F.lit("R1 ended first")).when(F.col("r2").isNull(), F.lit("R2 ended first"))
    if check_ids:
        ids = [C.canonical_id(C.chars(F.col(f"{r}.header"))) for r in ("r1", "r2")]
        error = error.when(ids[0] != ids[1], F.concat(F.lit("ids differ: "), ids[0], F.lit(" and "), ids[1]))
    return paired.withColumn("error", error)


def first_pair_error(paired: DataFrame) -> ReadError | None:
    """The first error of pairs by file and record, with both offsets and both ids where ids differ; None if there is none."""
    order = [c for c in ("file_no", "file") if c in paired.columns]
    ids = [C.canonical_id(C.chars(F.col(f"{r}.header"))).alias(f"id_{r}") for r in ("r1", "r2")]
    row = paired.where("error IS NOT NULL").agg(F.min(F.struct(
        *order, "record", "error", F.col("r1.error").alias("e1"), F.col("r2.error").alias("e2"), F.col("r1.header_offset").alias("o1"), F.col("r2.header_offset").alias("o2"), *ids
    ))).first()[0]
    if row is None:
        return None
    own = row["e1"] or row["e2"]
    if own is not None:
        return ReadError(**own.asDict())
    if row["error"].endswith("ended first"):
        return ReadError("PairedCountMismatch", 0, row["record"], detail=row["error"][:2])
    return ReadError("PairedIdMismatch", 0, row["record"], detail=row["error"], offsets=(row["o1"], row["o2"]), ids=(row["id_r1"], row["id_r2"]))


def checked_pairs(paired: DataFrame) -> DataFrame:
    """The pairs, after one aggregate that raises the first error by record."""
    error = first_pair_error(paired)
    if error is not None:
        raise error
    return paired


class CallbackError(Exception):
    """What a callback raised on a read, and where: file, record and the text of what it raised."""

    def __init__(self, file: str, record: int, text: str):
        self.file, self.record, self.text = file, record, text
        super().__init__(f"callback failed at record {record} of {file}: {text}")


def try_for_each(reads: DataFrame, callback) -> int:
    """Calls callback(read), a read being a dict of its columns, on every read, in order within each split; returns how many it took.

    reads is numbered and read in permissive mode. The first error in order of file and record is raised, whether it is the data's (ReadError) or
    the callback's (CallbackError). A split stops at its first error; other splits may have gone on, as they run side by side.
    """
    import pyarrow as pa

    struct = ERROR_SCHEMA.replace(", ", ",").replace(" ", ":")
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    error_type = pa.struct([(n, types[t]) for n, t in (f.split() for f in ERROR_SCHEMA.split(", "))])
    schema = pa.schema([("file_no", pa.int32()), ("file", pa.string()), ("record", pa.int64()), ("raised", pa.string()), ("error", error_type), ("done", pa.int64())])

    def run(batches):
        done, stopped = 0, None
        for read in (r for b in batches for r in b.to_pylist()):
            raised, error = None, read.get("error")
            if error is None:
                try:
                    callback(read)
                    done += 1
                    continue
                except Exception as e:
                    raised = f"{type(e).__name__}: {e}"
            stopped = {k: read[k] for k in ("file_no", "file", "record")} | {"raised": raised, "error": error}
            break
        yield pa.RecordBatch.from_pylist([(stopped or {}) | {"done": done}], schema)

    met = reads.mapInArrow(run, f"file_no int, file string, record bigint, raised string, error struct<{struct}>, done bigint")
    place = F.struct("file_no", "file", "record", "raised", "error")
    total, first = met.agg(F.sum("done"), F.min(F.when(F.col("record").isNotNull(), place))).first()
    if first is None:
        return total or 0
    if first["raised"] is None:
        raise ReadError(**first["error"].asDict())
    raise CallbackError(first["file"], first["record"], first["raised"])
