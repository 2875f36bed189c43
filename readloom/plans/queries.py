"""The registered queries and their SQL. Reads are derived from lineitem, so that SQL can say what a query must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import concatenated, parse_bytes, read_interleaved, read_pairs, read_reads, read_totals, stream_reads, write_reads
from ..functions import columns as C
from ..operators import reads as R
from ..streaming.reads import write_stream
from . import lanes
from .base import READS, base, folder, in_order, text

ID = "regexp_extract(header, '^[^ \\t]*', 0)"


def through(extension: str = "fastq", single: bool = False, name: str | None = None, write: dict | None = None, **read):
    """Writes the reads in a format and reads them again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = folder(spark, "scan") + f"/reads.{name or extension}"
        df = base(spark, sf_dir)
        (concatenated(path, df, **(write or {})) if single else write_reads(df, path, compression={"fastq": "plain", "gz": "gzip", "bgz": "bgzf", "zst": "zstd"}[extension]))
        return text(read_reads(spark, path, **read))

    return query


def scan_lines(wrapped: bool):
    """Reads written as text in another shape: wrapped at 10 columns, or with CRLF ends and blank lines between records."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, df = folder(spark, "lines"), base(spark, sf_dir)
        if wrapped:
            def wrap(c):
                return F.regexp_replace(c, "(.{10})(?=.)", "$1\n")

            value = F.concat(F.lit("@"), F.col("header"), F.lit("\n"), wrap(F.col("seq")), F.lit("\n+\n"), wrap(F.col("qual")))
        else:
            value = F.concat(F.lit("@"), F.col("header"), F.lit("\r\n"), F.col("seq"), F.lit("\r\n+\r\n"), F.col("qual"), F.lit("\r\n\r"))
        df.select(value.alias("value")).write.text(path)
        return text(read_reads(spark, path, format="multiline" if wrapped else "single", splitSize=1 << 18))

    return query


def ordered(path: str, df: DataFrame) -> str:
    """df, which is in order of k, as one file."""
    concatenated(path, df)
    return path


def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered file, read in many splits: global record numbers and offsets."""
    path = ordered(folder(spark, "index") + "/reads.fastq", in_order(spark, sf_dir))
    return indexed(read_reads(spark, path, splitSize=1 << 18, numbered=True))


def record_index_bgzf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a BGZF file, whose splits know no decoded offset but their own."""
    path = ordered(folder(spark, "index") + "/reads.fastq.bgz", in_order(spark, sf_dir))
    return indexed(read_reads(spark, path, splitSize=1 << 17, numbered=True))


def indexed(df: DataFrame) -> DataFrame:
    return df.select(C.chars("seq").alias("seq"), "record", "header_offset", "seq_offset", "qual_offset")


def resync(extension: str):
    """The reads at and after an arbitrary place within a record of one ordered file."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = ordered(folder(spark, "resync") + f"/reads.{extension}", in_order(spark, sf_dir))
        # in BGZF, place 17,003 of the first block; in both the same decoded byte
        return text(read_reads(spark, path, startOffset=RESYNC, resync="true", splitSize=1 << 18))

    return query


RESYNC = 17_003


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of many orders joined into long ones, whose qualities start as a header does."""
    parts = base(spark, sf_dir).groupBy(F.expr("k div 8192").alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "seq", "qual"))).alias("x"))

    def joined(field: str, first: str):
        return F.concat(F.lit(first), F.array_join(F.transform("x", lambda r: r[field]), ""))

    return parts.select("k", F.concat(F.lit("long"), F.col("k")).alias("header"), joined("seq", "A").alias("seq"), joined("qual", "@").alias("qual"))


def scan_long_split(extension: str):
    """Reads far longer than a split."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = ordered(folder(spark, "long") + f"/reads.{extension}", long_reads(spark, sf_dir).repartitionByRange("k").sortWithinPartitions("k"))
        return text(read_reads(spark, path, splitSize=1 << 14))

    return query


LONG_SQL = """SELECT concat('long', CAST(g AS VARCHAR(20))) AS header, concat('A', string_agg(seq, '' ORDER BY k)) AS seq, concat('@', string_agg(qual, '' ORDER BY k)) AS qual
FROM (SELECT *, k // 8192 AS g FROM (%s)) GROUP BY g"""


INDEX_SQL = f"""SELECT seq, record, until - size AS header_offset, until - size + length(header) + 2 AS seq_offset, until - length(qual) - 1 AS qual_offset
FROM (SELECT *, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS record, CAST(sum(size) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until
  FROM (SELECT *, length(header) + length(seq) + length(qual) + 6 AS size FROM ({READS})))"""


def seek_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A BGZF file read again from the virtual offset of a record in its middle."""
    path = ordered(folder(spark, "seek") + "/reads.fastq.bgz", in_order(spark, sf_dir))
    first = read_reads(spark, path, splitSize=1 << 18, numbered=True)
    middle = first.agg(F.expr("min_by(voffset, record) FILTER (WHERE record > 1000)")).first()[0]
    return text(read_reads(spark, path, startOffset=middle)) if middle is not None else text(first.limit(0))


def encoding_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the least and greatest quality that the scan meets."""
    path = folder(spark, "guess")
    write_reads(base(spark, sf_dir), path)
    return R.encoding_of(read_totals(spark, path, qualities=True))


def in_memory(check):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base(spark, sf_dir).select("k", *check())

    return query


def mates(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Pairs of two files of reads, in order of k, one of odd and one of even lines, whose splits hold unlike numbers of records."""
    paths = []
    for nth in (1, 0):
        paths.append(ordered(folder(spark, f"mate{nth}") + "/reads.fastq", in_order(spark, sf_dir, f"ln % 2 = {nth}")))
    return read_pairs(spark, *paths, splitSize=1 << 18, **options)


def paired(check_ids: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = mates(spark, sf_dir, check_ids=check_ids)
        return out.select("record", C.chars("r1.seq").alias("seq1"), C.chars("r2.seq").alias("seq2"), F.coalesce("error", F.lit("")).alias("error"))

    return query


def paired_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lanes of two mates: a folder of two files for each mate, paired file by file."""
    folders = []
    for mate in (1, 0):
        folders.append(folder(spark, "lanes"))
        for lane in (0, 1):
            ordered(f"{folders[-1]}/lane{lane}.fastq", in_order(spark, sf_dir, f"ln % 2 = {mate} AND (k div 8) % 2 = {lane}"))
    out = read_pairs(spark, *folders, splitSize=1 << 18)
    return out.select(F.col("file_no").cast("long").alias("lane"), "record", C.chars("r1.seq").alias("seq1"), C.chars("r2.seq").alias("seq2"), F.coalesce("error", F.lit("")).alias("error"))


LANES_SQL = """WITH n AS (SELECT *, (k // 8) % 2 AS lane, CAST(row_number() OVER (PARTITION BY ln % 2, (k // 8) % 2 ORDER BY k) AS BIGINT) AS record FROM (%s))
SELECT coalesce(a.lane, b.lane) AS lane, coalesce(a.record, b.record) AS record, a.seq AS seq1, b.seq AS seq2,
  CASE WHEN a.seq IS NULL THEN 'R1 ended first' WHEN b.seq IS NULL THEN 'R2 ended first' ELSE '' END AS error
FROM (SELECT * FROM n WHERE ln % 2 = 1) a FULL JOIN (SELECT * FROM n WHERE ln % 2 = 0) b ON a.record = b.record AND a.lane = b.lane"""


def _canonical(header: str) -> str:
    return f"regexp_replace(regexp_extract({header}, '^[^ \\t]*', 0), '^(.+)(?:/[0-9]|[.][12])$', '\\1')"


def _paired_sql(check_ids: bool) -> str:
    ids = f" WHEN {_canonical('a.header')} <> {_canonical('b.header')} THEN concat('ids differ: ', {_canonical('a.header')}, ' and ', {_canonical('b.header')})" if check_ids else ""
    return f"""WITH r AS ({READS}), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY ln % 2 ORDER BY k) AS BIGINT) AS record FROM r)
SELECT coalesce(a.record, b.record) AS record, a.seq AS seq1, b.seq AS seq2,
  CASE WHEN a.seq IS NULL THEN 'R1 ended first' WHEN b.seq IS NULL THEN 'R2 ended first'{ids} ELSE '' END AS error
FROM (SELECT * FROM n WHERE ln % 2 = 1) a FULL JOIN (SELECT * FROM n WHERE ln % 2 = 0) b ON a.record = b.record"""


def count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record that only one of two files has."""
    out = mates(spark, sf_dir)
    return out.where("error IS NOT NULL").agg(F.min(F.struct("record", "error")).alias("e")).select("e.record", "e.error")


def interleaved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ordered(folder(spark, "interleaved") + "/reads.fastq.bgz", in_order(spark, sf_dir))
    out = read_interleaved(spark, path, splitSize=1 << 17)
    return out.select("record", C.chars("r1.seq").alias("seq1"), C.chars("r2.seq").alias("seq2"), F.coalesce("error", F.lit("")).alias("error"))


INTERLEAVED_SQL = f"""WITH n AS (SELECT seq, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS i FROM ({READS}))
SELECT (i + 1) // 2 AS record, max(CASE WHEN i % 2 = 1 THEN seq END) AS seq1, max(CASE WHEN i % 2 = 0 THEN seq END) AS seq2,
  CASE WHEN count(*) = 2 THEN '' ELSE 'R2 ended first' END AS error FROM n GROUP BY 1"""


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as a stream of files, gathered by the file sink."""
    path, out, state = folder(spark, "stream-in"), folder(spark, "stream-out"), folder(spark, "stream-state")
    write_reads(base(spark, sf_dir), path, compression="bgzf")
    stream = text(stream_reads(spark, path))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads from one file that grows between two runs of a stream with a log; the first run sees about half of it."""
    path, out, state, log = (folder(spark, f"stream-{x}") for x in ("in", "out", "state", "log"))
    reads = base(spark, sf_dir)
    half = (reads.agg(F.max("k")).first()[0] or 0) // 2
    for part in (reads.where(F.col("k") <= half), reads):
        write_reads(part.orderBy("k"), f"{path}/growing.fastq", mode="overwrite", singleFile=True, singleFileLimit=1 << 50)
        stream = text(stream_reads(spark, path, log=log, follow=True, splitSize=1 << 22))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads through a stream whose sink writes each micro-batch once, and read again."""
    path, out, state = folder(spark, "stream-in"), folder(spark, "stream-out"), folder(spark, "stream-state")
    write_reads(base(spark, sf_dir), path)
    write_stream(stream_reads(spark, path), out, state, compression="gzip").trigger(availableNow=True).start().awaitTermination()
    return text(read_reads(spark, out))


def in_memory_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of each order as one binary value, read in memory."""
    records = base(spark, sf_dir).select("k", C.record_text(F.col("header"), F.col("seq"), F.col("qual")).alias("r"))
    values = records.groupBy(F.expr("k div 8").alias("k")).agg(F.array_join(F.sort_array(F.collect_list("r")), "").cast("binary").alias("content"))
    return text(parse_bytes(values))


def invalid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the first base outside ACGT in each read, in the stream of one ordered file."""
    changed = in_order(spark, sf_dir).withColumn("seq", F.regexp_replace("seq", "N", "X"))
    path = ordered(folder(spark, "invalid") + "/reads.fastq", changed)
    out = R.validation(read_reads(spark, path, splitSize=1 << 18, numbered=True), "bases", "strict")
    return out.where("invalid IS NOT NULL").select("record", F.col("invalid.offset").alias("offset"), F.col("invalid.byte").cast("long").alias("byte"))


def validated_scan(extension: str, wrapped: bool = False):
    """A scan whose reader validates: bases outside ACGT come first, then qualities below the range, each with its place in the stream."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        changed = (base if wrapped else in_order)(spark, sf_dir).select("k", "header", F.translate("seq", "N", "X").alias("seq"), F.translate("qual", "!", " ").alias("qual"))
        if wrapped:
            def wrap(c: str):
                return F.regexp_replace(c, "(?s)(.{10})(?=.)", "$1\n")

            path = folder(spark, "validated")
            lines = F.concat(F.lit("@"), F.col("header"), F.lit("\n"), wrap("seq"), F.lit("\n+\n"), wrap("qual"))
            # one file a text: the number of each in its folder is its order
            changed.select("k", lines.alias("value")).repartitionByRange(4, "k").sortWithinPartitions("k").select("value").write.text(path)
            df = read_reads(spark, path, mode="permissive", format="multiline", validation="bases_and_qualities", alphabet="strict")
            return df.where("error IS NOT NULL").select(
                C.chars("header").alias("header"), "error.variant", (F.col("error.offset") - F.col("header_offset")).alias("offset"), F.col("error.byte").cast("long").alias("byte")
            )
        path = ordered(folder(spark, "validated") + f"/reads.{extension}", changed)
        df = read_reads(spark, path, mode="permissive", validation="bases_and_qualities", alphabet="strict", splitSize=1 << 18)
        return df.where("error IS NOT NULL").select("error.record", "error.variant", "error.offset", F.col("error.byte").cast("long").alias("byte"))

    return query


INVALID_SQL = f"""SELECT record, seq_offset + strpos(replace(seq, 'N', 'X'), 'X') - 1 AS "offset", CAST(88 AS BIGINT) AS byte
FROM ({INDEX_SQL}) WHERE strpos(seq, 'N') > 0"""


VALIDATED_SQL = f"""SELECT record, CASE WHEN strpos(seq, 'N') > 0 THEN 'InvalidBase' ELSE 'InvalidQuality' END AS variant,
  CASE WHEN strpos(seq, 'N') > 0 THEN seq_offset + strpos(seq, 'N') - 1 ELSE qual_offset + strpos(qual, '!') - 1 END AS "offset",
  CAST(CASE WHEN strpos(seq, 'N') > 0 THEN 88 ELSE 32 END AS BIGINT) AS byte
FROM ({INDEX_SQL.replace("SELECT seq,", "SELECT seq, qual,", 1)}) WHERE strpos(seq, 'N') > 0 OR strpos(qual, '!') > 0"""
WRAPPED_SQL = f"""SELECT header, CASE WHEN b > 0 THEN 'InvalidBase' ELSE 'InvalidQuality' END AS variant,
  CAST(length(header) + 2 + CASE WHEN b > 0 THEN b - 1 + (b - 1) // 10 ELSE length(seq) + (length(seq) - 1) // 10 + 3 + q - 1 + (q - 1) // 10 END AS BIGINT) AS "offset",
  CAST(CASE WHEN b > 0 THEN 88 ELSE 32 END AS BIGINT) AS byte
FROM (SELECT *, strpos(seq, 'N') AS b, strpos(qual, '!') AS q FROM ({READS})) WHERE b > 0 OR q > 0"""


def _bad(alphabet: str, column: str = "seq") -> str:
    return f"CASE WHEN length(regexp_extract({column}, '^[{alphabet}]*', 0)) < length({column}) THEN length(regexp_extract({column}, '^[{alphabet}]*', 0)) END"


def _sql(columns: str) -> str:
    return f"SELECT k, {columns} FROM ({READS})"


def _lines():
    """Text with no line break, with a lone carriage return, with one line feed, and with several."""
    h, s, q, lf = F.col("header"), F.col("seq"), F.col("qual"), F.lit("\n")
    return F.when(F.col("ln") % 4 == 0, h).when(F.col("ln") % 4 == 1, F.concat(h, F.lit("\r"))).when(F.col("ln") % 4 == 2, F.concat(h, lf, s)).otherwise(F.concat(lf, s, lf, lf, q))


_LINES = "(CASE ln % 4 WHEN 0 THEN header WHEN 1 THEN concat(header, chr(13)) WHEN 2 THEN concat(header, chr(10), seq) ELSE concat(chr(10), seq, chr(10), chr(10), qual) END)"
PLAIN = f"SELECT header, seq, qual FROM ({READS})"
IN_MEMORY = {
    "project_id_desc": (lambda: [C.read_id(F.col("header")).alias("id"), C.description(F.col("header")).alias("description")],
                        f"{ID} AS id, regexp_replace(header, '^[^ \\t]*[ \\t]*', '') AS description"),
    "canonical_id": (lambda: [C.canonical_id(F.col("header")).alias("id")], f"{_canonical('header')} AS id"),
    "read_length": (lambda: [C.read_length(F.col("seq")).alias("n"), C.is_empty(F.col("seq")).alias("empty")], "CAST(length(seq) AS BIGINT) AS n, length(seq) = 0 AS empty"),
    "validate_bases_strict": (lambda: [C.first_bad_base(F.lower("seq"), "strict").alias("bad")], f"{_bad('ACGTN', 'lower(seq)')} AS bad"),
    "validate_bases_case": (lambda: [C.first_bad_base(F.translate("seq", "N", "#"), "case").alias("bad")], f"{_bad('ACGTNacgtn', chr(39).join(('replace(seq, ', 'N', ', ', '#', ')')))} AS bad"),
    "validate_bases_iupac": (lambda: [C.first_bad_base(F.translate("seq", "N", "X"), "iupac").alias("bad")], "CASE WHEN strpos(seq, 'N') > 0 THEN strpos(seq, 'N') - 1 END AS bad"),
    "validate_qual_33": (lambda: [C.first_bad_quality(F.translate("qual", "!", " ")).alias("bad")], "CASE WHEN strpos(qual, '!') > 0 THEN strpos(qual, '!') - 1 END AS bad"),
    "validate_qual_64": (lambda: [C.first_bad_quality(F.col("qual"), "phred64").alias("bad")], f"{_bad('@-~', 'qual')} AS bad"),
    "validate_both": (lambda: [(C.first_bad_base(F.col("seq"), "strict").isNull() & C.first_bad_quality(F.col("qual")).isNull()).alias("ok")],
                      f"{_bad('ACGTN')} IS NULL AND {_bad('!-~', 'qual')} IS NULL AS ok"),
    "phred_sum": (lambda: [C.phred_sum(F.col("qual")).alias("score")], "CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS BIGINT) AS score"),
    "virtual_offset_pack": (lambda: [C.virtual_offset(F.col("k"), F.col("ln")).alias("v"), C.virtual_compressed(C.virtual_offset(F.col("k"), F.col("ln"))).alias("c"), C.virtual_inside(C.virtual_offset(F.col("k"), F.col("ln"))).alias("i")],
                            "(k << 16) | ln AS v, k AS c, ln AS i"),
    "newlines": (lambda: [f(_lines()).alias(n) for n, f in (("lines", C.count_lf), ("first", C.find_lf), ("later", lambda t: C.find_lf(t, 20)), ("broken", C.contains_line_break))],
                 f"length({_LINES}) - length(replace({_LINES}, chr(10), '')) AS lines, strpos({_LINES}, chr(10)) - 1 AS first, CASE WHEN strpos(substr({_LINES}, 21), chr(10)) > 0 "
                 f"THEN strpos(substr({_LINES}, 21), chr(10)) + 19 ELSE -1 END AS later, strpos({_LINES}, chr(10)) > 0 OR strpos({_LINES}, chr(13)) > 0 AS broken"),
    "phred_saturated": (lambda: [C.phred_sum(F.col("qual"), "phred64").alias("score")], "CAST(list_sum(list_transform(string_split(qual, ''), lambda c: greatest(ascii(c) - 64, 0))) AS BIGINT) AS score"),
    "quality_in_range": (lambda: [C.in_range(F.ascii("qual"), "33,35,66").alias("first"), C.first_bad_quality(F.col("qual"), "33,35,66").alias("bad"), C.first_bad_quality(F.col("qual"), "33,70,40").alias("none")],
                         f"ascii(qual) BETWEEN 35 AND 66 AS first, {_bad('#-B', 'qual')} AS bad, CAST(NULL AS BIGINT) AS none"),
    "record_text": (lambda: [C.record_text(F.col("header"), F.col("seq"), F.col("qual")).alias("record")], "concat('@', header, chr(10), seq, chr(10), '+', chr(10), qual, chr(10)) AS record"),
}

SCANS = {
    "scan_plain": through(), "scan_plain_split": through(splitSize=1 << 16), "scan_gzip": through("gz"), "scan_bgzf": through("bgz"),
    "scan_bgzf_split": through("bgz", splitSize=1 << 17), "scan_zstd": through("zst"), "scan_multiline": scan_lines(True), "scan_crlf": scan_lines(False),
    "sniff_misnamed": through("fastq", single=True, name="fastq", write={"compression": "gzip"}), "scan_one_file": through("bgz", single=True, name="fastq.bgz"),
    "scan_stream_only": through("bgz", splittable=False), "scan_forced_bgzf": through("bgz", compression="bgzf"), "stream_append": stream_append, "stream_follow": stream_follow, "stream_write": stream_write,
    "scan_memory": in_memory_values,
}


def summed(*columns: str, blank: bool = False, **options):
    """Totals by the scan alone: no field crosses to Spark. With blank, a third of the reads have a blank line after them."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, df = folder(spark, "totals"), base(spark, sf_dir)
        if blank:
            lines = F.concat(C.record_text(F.col("header"), F.col("seq"), F.col("qual")), F.when(F.col("ln") % 3 == 0, "\n").otherwise(""))
            df.select(F.regexp_replace(lines, "\\n\\z", "").alias("value")).write.text(path)
        else:
            write_reads(df, path)
        return read_totals(spark, path, **options).select(*columns)

    return query


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "totals")
    write_reads(base(spark, sf_dir), path)
    return read_reads(spark, path)


def queries() -> dict:
    return {
        **SCANS, **{name: in_memory(check) for name, (check, _) in IN_MEMORY.items()},
        "base_total": summed("records", "bases"), "newline_total": summed("lines", blank=True, splitSize=1 << 16), "record_index": record_index, "record_index_bgzf": record_index_bgzf, "resync_plain": resync("fastq"), "resync_bgzf": resync("fastq.bgz"),
        "scan_long_split": scan_long_split("fastq"), "scan_long_split_bgzf": scan_long_split("fastq.bgz"), "validated_scan": validated_scan("fastq"), "validated_scan_bgzf": validated_scan("fastq.bgz"),
        "validated_scan_wrapped": validated_scan("fastq", wrapped=True), "paired_join_lanes": paired_lanes,
        "seek_resume": seek_resume, "invalid_base_offset": invalid_offsets, "guess_encoding": encoding_guess,
        "paired_join": paired(False), "paired_id_check": paired(True), "paired_count_mismatch": count_mismatch, "interleaved_pairs": interleaved_pairs, "error_taxonomy": lanes.error_taxonomy,
        "scan_bgzf_damaged": lanes.scan_bgzf_damaged, "scan_wrapped_split": lanes.scan_wrapped_split("plain"), "scan_wrapped_split_bgzf": lanes.scan_wrapped_split("bgzf"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **dict.fromkeys(SCANS, PLAIN), **{name: _sql(sql) for name, (_, sql) in IN_MEMORY.items()},
        "base_total": f"SELECT count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS bases FROM ({READS})",
        "record_index": INDEX_SQL,
        "seek_resume": f"SELECT header, seq, qual FROM (SELECT *, row_number() OVER (ORDER BY k) AS i FROM ({READS})) WHERE i > 1000",
        "invalid_base_offset": INVALID_SQL,
        "guess_encoding": f"SELECT CASE WHEN min(c) < 64 THEN 'phred33' WHEN max(c) > 74 THEN 'phred64' END AS encoding FROM (SELECT ascii(unnest(string_split(qual, ''))) AS c FROM ({READS}))",
        "paired_join": _paired_sql(False), "paired_id_check": _paired_sql(True),
        "paired_count_mismatch": f"SELECT record, error FROM ({_paired_sql(False)}) WHERE error <> '' ORDER BY record LIMIT 1",
        "interleaved_pairs": INTERLEAVED_SQL, "error_taxonomy": lanes.ERRORS_SQL, "scan_bgzf_damaged": lanes.DAMAGED_SQL,
        **dict.fromkeys(("scan_wrapped_split", "scan_wrapped_split_bgzf"), lanes.WRAPPED_SPLIT_SQL), "record_index_bgzf": INDEX_SQL,
        "newline_total": f"SELECT CAST(sum(CASE WHEN ln % 3 = 0 THEN 5 ELSE 4 END) AS BIGINT) AS lines FROM ({READS})",
        **dict.fromkeys(("resync_plain", "resync_bgzf"), f"SELECT header, seq, qual FROM ({INDEX_SQL.replace('SELECT seq,', 'SELECT header, qual, seq,', 1)}) WHERE header_offset >= {RESYNC}"),
        **dict.fromkeys(("scan_long_split", "scan_long_split_bgzf"), LONG_SQL.replace("%s", READS)), **dict.fromkeys(("validated_scan", "validated_scan_bgzf"), VALIDATED_SQL),
        "validated_scan_wrapped": WRAPPED_SQL, "paired_join_lanes": LANES_SQL.replace("%s", READS),
    }
