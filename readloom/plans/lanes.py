"""Queries over files that tasks write themselves: lanes of lineitem's reads, wrapped, or damaged each in its own way, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..api import read_reads
from ..sources import codecs, grid, sinks
from ..sources.fastq import sized
from .base import READS, base, folder, in_order, record, text

#: What is wrong with a lane: (container, damage by the writer, options of the reader, variant, kind, place of the error).
BROKEN = {
    "header": ("plain", "", {}, "InvalidFormat", "HeaderMissingAt", "header"), "plus": ("plain", "", {}, "InvalidFormat", "PlusMissing", "plus"),
    "length": ("plain", "", {}, "LengthMismatch", "", "qual"), "end": ("plain", "", {}, "UnexpectedEof", "", "qual"),
    "seq line": ("plain", "", {"format": "multiline"}, "InvalidFormat", "SeqLineEmpty", "seq"), "qual line": ("plain", "", {"format": "multiline"}, "InvalidFormat", "QualLineEmpty", "qual"),
    "long qual": ("plain", "", {"format": "multiline"}, "LengthMismatch", "", "qual"),
    "base": ("plain", "", {"validation": "bases"}, "InvalidBase", "", "seq"), "quality": ("bgzf", "", {"validation": "qualities"}, "InvalidQuality", "", "qual"),
    "gzip crc": ("gzip", "crc", {}, "InvalidFormat", "GzipTrailerCrc", "total"), "gzip size": ("gzip", "size", {}, "InvalidFormat", "GzipTrailerIsize", "total"),
    "gzip end": ("gzip", "end", {}, "InvalidFormat", "GzipTruncated", "total"), "gzip header": ("gzip", "header", {}, "InvalidFormat", "GzipHeader", "total"),
    "gzip data": ("gzip", "data", {}, "InvalidFormat", "GzipData", "total"),
    "bgzf crc": ("bgzf", "crc", {}, "InvalidFormat", "BgzfBlockCrc", "block"), "bgzf size": ("bgzf", "size", {}, "InvalidFormat", "BgzfBlockIsize", "block"),
    "bgzf data": ("bgzf", "data", {}, "InvalidFormat", "BgzfBlock", "block"), "bgzf large": ("bgzf", "large", {}, "InvalidFormat", "BgzfBlockTooLarge", "block"),
    "bgzf header": ("bgzf", "header", {"compression": "bgzf"}, "InvalidFormat", "BgzfHeader", "block"), "bgzf marker": ("bgzf", "marker", {}, "InvalidFormat", "BgzfMissingEofMarker", "total"),
    "bgzf forced": ("plain", "", {"compression": "bgzf"}, "InvalidFormat", "BgzfHeader", "start"), "bgzf place": ("bgzf", "", {"startOffset": 7 << 16}, "InvalidFormat", "BgzfVirtualOffset", "asked"),
    "bzip2": ("plain", "bzip2", {}, "Unsupported", "", "start"), "xz": ("plain", "xz", {}, "Unsupported", "", "start"), "seek in gzip": ("gzip", "", {"startOffset": 5}, "Unsupported", "", "start"),
}
GRID = sinks.BLOCK


def damaged(block: bytes, damage: str) -> bytes:
    """A BGZF block with its damage."""
    block = bytearray(block)
    if damage == "crc":
        block[-8] ^= 1
    elif damage == "size":
        block[-4] ^= 1
    elif damage == "large":
        block[-4:] = (GRID * 2).to_bytes(4, "little")
    elif damage == "data":
        block[18:-8] = b"\xff" * (len(block) - 26)
    elif damage == "header":
        block[0] ^= 1
    return bytes(block)


class Lane:
    """Writes one file piece by piece, with its damage; block tells which BGZF block is damaged."""

    def __init__(self, path: str, container: str, damage: str, block: int):
        self.container, self.damage, self.block, self.nth, self.held = container, damage, block, 0, bytearray()
        self.file, self.encoder = sinks.output(path), sinks.Encoder("gzip", 6) if container == "gzip" else None
        self.file.write({"bzip2": b"BZh", "xz": b"\xfd7zXZ\0"}.get(damage, b""))

    def add(self, data: bytes) -> None:
        if self.container == "plain":
            self.file.write(data)
        elif self.encoder:
            self.file.write(self.encoder.add(data))
        else:
            self.held += data
            while len(self.held) >= GRID:
                self.put(GRID)

    def put(self, n: int) -> None:
        block = bytearray(sinks.bgzf_block(bytes(self.held[:n]), 6))
        del self.held[:n]
        self.file.write(damaged(block, self.damage) if self.nth == self.block else block)
        self.nth += 1

    def close(self) -> None:
        if self.encoder:
            rest = bytearray(self.encoder.finish())
            if self.damage == "crc":
                rest[-8] ^= 1
            elif self.damage == "size":
                rest[-4] ^= 1
            elif self.damage == "end":
                del rest[-4:]
            rest += {"header": b"\x1f\x8b\x07" + bytes(9), "data": b"\x1f\x8b\x08" + bytes(7) + b"\xff" * 20}.get(self.damage, b"")
            self.file.write(rest)
        elif self.container == "bgzf":
            if self.held:
                self.put(len(self.held))
            self.file.write(b"" if self.damage == "marker" else codecs.BGZF_EOF)
        self.file.close()


def written_lanes(df: DataFrame, path: str, kinds: list[tuple[str, str]]) -> list[int]:
    """Writes (lane, k, block, value), a file a lane in order of k, as path/lane-N; kinds has each lane's container and damage. Returns the lanes that there are."""
    import pyarrow as pa

    def run(batches):
        now, lane, rows = None, None, []
        for b in batches:
            for n, block, value in zip(*(b[c].to_pylist() for c in ("lane", "block", "value")), strict=True):
                if n != now:
                    if lane:
                        lane.close()
                    now, lane = n, Lane(f"{path}/lane-{n}", *kinds[n], block)
                    rows.append(n)
                lane.add(value.encode("latin-1"))
        if lane:
            lane.close()
        yield pa.RecordBatch.from_pydict({"lane": pa.array(rows, pa.int64())})

    dealt = df.repartition("lane").sortWithinPartitions("lane", "k").select("lane", "block", "value")
    return [r.lane for r in dealt.mapInArrow(run, "lane bigint").collect()]


def split_lane(spark: SparkSession, df: DataFrame, path: str, container: str, damage: str = "") -> bool:
    """Writes (value) in the order of its partitions as one file, plain or BGZF, which tasks write; the block in the middle of a BGZF file has the damage. Returns whether there is anything."""
    import uuid

    import pyarrow as pa

    beside = f"{path}.parts-{uuid.uuid4().hex[:12]}"

    def run(batches):
        from pyspark import TaskContext

        name, f = f"{beside}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", None
        for b in batches:
            if b.num_rows:
                f = f or sinks.output(name)
                f.write(sinks.whole(b["value"]))
        if f:
            f.close()
            yield pa.RecordBatch.from_pydict({"file": [name]})

    files = {r.file for r in df.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, "file string").collect()}
    if not files:
        return False
    parts = [p for p in sized(beside) if p[0] in files]
    try:
        if container == "plain":
            grid.one_file(spark, parts, path, container, sinks.DEFAULT_LEVEL, None)
        else:
            grid.one_bgzf(spark, parts, path, sinks.DEFAULT_LEVEL, None, lambda number, of, block: damaged(block, damage) if number == of // 2 else block)
    finally:
        system, inner = sinks.file_system(beside)
        system.delete_dir(inner)
    return True


def laned(df: DataFrame, lanes: int) -> DataFrame:
    """Reads with their lane, number and count in it, and the block in its middle."""
    size = F.length("header") + F.length("seq") + F.length("qual") + 6
    every = Window.partitionBy("lane")
    rows = df.withColumn("lane", F.expr(f"(k div 8) % {lanes}")).withColumn("size", size)
    return rows.select(
        "lane", "k", "header", "seq", "qual", F.row_number().over(every.orderBy("k")).alias("i"), F.count("*").over(every).alias("n"),
        F.expr(f"CAST(ceil(sum(size) OVER (PARTITION BY lane) / {GRID}) AS BIGINT) div 2").alias("block"),
    )


def damaged_text() -> Column:
    """The text of a read, which the one in the middle of its lane has wrong as the lane says."""
    h, s, q, lf = F.col("header"), F.col("seq"), F.col("qual"), F.lit("\n")
    plus = F.lit("\n+\n")
    wrong = {
        "header": F.concat(F.lit("x"), h, lf, s, plus, q, lf), "plus": F.concat(F.lit("@"), h, lf, s, F.lit("\n-\n"), q, lf), "length": F.concat(F.lit("@"), h, lf, s, plus, F.expr("left(qual, length(qual) - 1)"), lf),
        "end": F.concat(F.lit("@"), h, lf, s, plus), "seq line": F.concat(F.lit("@"), h, F.lit("\n\n+\n\n")), "qual line": F.concat(F.lit("@"), h, lf, s, plus, lf, q, lf),
        "long qual": F.concat(F.lit("@"), h, lf, s, plus, q, F.lit("I\n")), "base": F.concat(F.lit("@"), h, lf, F.lit("!"), F.expr("substr(seq, 2)"), plus, q, lf),
        "quality": F.concat(F.lit("@"), h, lf, s, plus, F.lit(" "), F.expr("substr(qual, 2)"), lf),
    }
    out, names, middle = None, list(BROKEN), F.col("i") == F.expr("n div 2 + 1")
    for name, value in wrong.items():
        here = middle & (F.col("lane") == names.index(name))
        out = F.when(here, value) if out is None else out.when(here, value)
    return out.when((F.col("lane") == names.index("end")) & (F.col("i") > F.expr("n div 2 + 1")), "").otherwise(record(h, s, q))


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading each damaged lane meets, and where: reads of lineitem, a lane for each way to be wrong."""
    path = folder(spark, "broken")
    rows = laned(base(spark, sf_dir), len(BROKEN)).withColumn("value", damaged_text())
    out = None
    for n in sorted(written_lanes(rows, path, [(c, d) for c, d, *_ in BROKEN.values()])):
        name, options = list(BROKEN)[n], list(BROKEN.values())[n][2]
        found = read_reads(spark, f"{path}/lane-{n}", mode="permissive", numbered=True, **options).where("error IS NOT NULL").select(
            F.lit(name).alias("broken"), "error.variant", F.coalesce("error.kind", F.lit("")).alias("kind"), F.col("error.offset").alias("offset"), F.col("error.record").alias("record")
        )
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "broken string, variant string, kind string, offset bigint, record bigint")


def _lanes_sql(lanes: int) -> str:
    return f"""w AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY k) AS i, count(*) OVER (PARTITION BY lane) AS n, CAST(sum(size) OVER (PARTITION BY lane) AS BIGINT) AS total,
    CAST(sum(size) OVER (PARTITION BY lane ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until
  FROM (SELECT *, (k // 8) % {lanes} AS lane, length(header) + length(seq) + length(qual) + 6 AS size FROM ({READS}))),
b AS (SELECT *, ((total + {GRID - 1}) // {GRID}) // 2 * {GRID} AS hit FROM w),
m AS (SELECT lane, any_value(total) AS total, any_value(n) AS n, any_value(hit) AS hit, count(*) FILTER (until <= hit) + 1 AS behind FROM b GROUP BY lane)"""


ERRORS_SQL = f"""WITH {_lanes_sql(len(BROKEN))},
kinds(lane, broken, variant, kind, place) AS (VALUES {", ".join(f"({n}, '{name}', '{v}', '{k}', '{p}')" for n, (name, (_, _, _, v, k, p)) in enumerate(BROKEN.items()))})
SELECT broken, variant, kind, CAST(CASE place WHEN 'start' THEN 0 WHEN 'asked' THEN {7 << 16} WHEN 'total' THEN m.total WHEN 'block' THEN m.hit WHEN 'header' THEN until - size
    WHEN 'seq' THEN until - length(qual) - length(seq) - 4 WHEN 'plus' THEN until - length(qual) - 3 ELSE until - length(qual) - 1 END AS BIGINT) AS "offset",
  CAST(CASE WHEN place IN ('start', 'asked') THEN 1 WHEN place = 'total' THEN m.n + 1 WHEN place = 'block' THEN m.behind ELSE i END AS BIGINT) AS record
FROM kinds JOIN m USING (lane) JOIN w ON w.lane = kinds.lane AND w.i = w.n // 2 + 1"""

DAMAGES = ("crc", "size", "data", "header")


def scan_bgzf_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of many blocks and splits, a damaged block in the middle of each: all rows before it and one error, as an unsplit read has them."""
    path, value = folder(spark, "damaged"), record(*map(F.col, ("header", "seq", "qual"))).alias("value")
    lanes = [in_order(spark, sf_dir, f"(k div 8) % {len(DAMAGES)} = {n}").select(value) for n in range(len(DAMAGES))]
    if not any([split_lane(spark, rows, f"{path}/lane-{n}", "bgzf", DAMAGES[n]) for n, rows in enumerate(lanes)]):
        return spark.createDataFrame([], "header string, seq string, qual string, kind string, offset bigint, record bigint")
    before = text(read_reads(spark, path, mode="prefix", compression="bgzf", splitSize=1 << 15)).withColumns({"kind": F.lit(""), "offset": F.lit(None).cast("long"), "record": F.lit(None).cast("long")})
    errors = read_reads(spark, path, mode="permissive", numbered=True, compression="bgzf", splitSize=1 << 15).where("error IS NOT NULL")
    none = F.lit(None).cast("string")
    return before.union(errors.select(none.alias("header"), none.alias("seq"), none.alias("qual"), "error.kind", F.col("error.offset").alias("offset"), F.col("error.record").alias("record")))


DAMAGED_SQL = f"""WITH {_lanes_sql(len(DAMAGES))}
SELECT header, seq, qual, '' AS kind, CAST(NULL AS BIGINT) AS "offset", CAST(NULL AS BIGINT) AS record FROM b WHERE until <= hit
UNION ALL SELECT NULL, NULL, NULL, CASE lane WHEN 0 THEN 'BgzfBlockCrc' WHEN 1 THEN 'BgzfBlockIsize' WHEN 2 THEN 'BgzfBlock' ELSE 'BgzfHeader' END, hit, behind FROM m"""


def scan_wrapped_split(container: str):
    """Wrapped reads, those of an order joined to one, in many splits of two files; every third quality starts as a header does."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = folder(spark, "wrapped")
        parts = base(spark, sf_dir).groupBy(F.expr("k div 8").alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "seq", "qual"))).alias("x"))
        parts = parts.repartitionByRange("k").sortWithinPartitions("k")
        reads = parts.select("k", F.concat(F.lit("order"), F.col("k")).alias("header"), F.array_join("x.seq", "").alias("seq"), F.array_join("x.qual", "").alias("qual"))
        reads = reads.withColumn("qual", F.when(F.col("k") % 3 == 0, F.concat(F.lit("@"), F.expr("substr(qual, 2)"))).otherwise(F.col("qual")))
        lines = record(F.col("header"), *(F.regexp_replace(c, "(?s)(.{25})(?=.)", "$1\n") for c in ("seq", "qual")))
        if not any([split_lane(spark, reads.where(F.col("k") % 2 == n).select(lines.alias("value")), f"{path}/lane-{n}", container) for n in (0, 1)]):
            return text(reads)
        return text(read_reads(spark, path, format="multiline", splitSize=1 << 15 if container == "plain" else 1 << 13))

    return query


WRAPPED_SPLIT_SQL = f"""SELECT concat('order', CAST(g AS VARCHAR(20))) AS header, string_agg(seq, '' ORDER BY k) AS seq,
  CASE WHEN g % 3 = 0 THEN concat('@', substr(string_agg(qual, '' ORDER BY k), 2)) ELSE string_agg(qual, '' ORDER BY k) END AS qual
FROM (SELECT *, k // 8 AS g FROM ({READS})) GROUP BY g"""
