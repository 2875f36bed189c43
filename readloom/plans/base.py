"""What the registered queries share: reads of lineitem in both engines, folders and text columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import shared_dir

#: Reads of lineitem, in SQL that both engines read alike.
READS = """SELECT CAST(l_orderkey AS BIGINT) * 8 + CAST(l_linenumber AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS ln,
  concat('read', CAST(l_orderkey AS VARCHAR(20)), CASE WHEN l_linenumber % 3 = 0 THEN '/1' WHEN l_linenumber % 3 = 1 THEN ' 1:N:0:ACGT' ELSE '.2' END) AS header,
  translate(md5(concat('s', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20)))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq,
  translate(md5(concat('q', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20)))), '0123456789abcdef', '!#%+5?ABCDEFGHIJ') AS qual
FROM lineitem"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads are made of: (k, ln, l_orderkey) from lineitem."""
    n = F.col("l_linenumber").cast("long")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey").cast("long") * 8 + n).alias("k"), n.alias("ln"), "l_orderkey")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, ln, header, seq, qual) from lineitem, in text columns."""
    return reads_of(keys(spark, sf_dir))


def in_order(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """The same of the keys that a condition holds for, in order of k: keys are sorted, and reads made of them afterwards."""
    return reads_of(keys(spark, sf_dir).where(where).repartitionByRange("k").sortWithinPartitions("k"))


def reads_of(rows: DataFrame) -> DataFrame:
    n, o = F.col("ln"), F.col("l_orderkey").cast("string")
    name = F.concat(o, F.lit("_"), n.cast("string"))
    suffix = F.when(n % 3 == 0, "/1").when(n % 3 == 1, " 1:N:0:ACGT").otherwise(".2")
    return rows.select(
        "k", "ln", F.concat(F.lit("read"), o, suffix).alias("header"),
        F.translate(F.md5(F.concat(F.lit("s"), name)), "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"),
        F.translate(F.md5(F.concat(F.lit("q"), name)), "0123456789abcdef", "!#%+5?ABCDEFGHIJ").alias("qual"),
    )


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the folder that the driver and all executors share."""
    return f"{shared_dir(spark)}/readloom-{name}-{uuid.uuid4().hex[:12]}"


def text(df: DataFrame) -> DataFrame:
    return df.select(*(C.chars(c).alias(c) for c in ("header", "seq", "qual")))


#: A record as text.
record = C.record_text
