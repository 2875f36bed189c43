"""Line dedup (operator 5) over overlapping windows of three lines; DataFrame functions only.

Lines are the parts between line feeds. Every three consecutive lines of a text make a window, known by 128 bits of hash;
windows of white space only do not count. Of a window that occurs more than once in the corpus, the first occurrence stays:
the least in order of (id, null last; hash of the text; position). Lines that a later occurrence covers are removed, after the
covered positions of a text are merged to ranges.

Window counts are aggregated with map-side combining; only windows that repeat are kept, written to the shared folder, and met with
the occurrences in a sort-merge join of which Spark can split a hot window's rows. Texts are moved once, to meet the ranges.

Results that the cases have: null texts stay null and texts of fewer than three lines stay as they are; a text whose lines are
all removed becomes empty, its row stays; rows alike in id and text count as one document, and are treated alike; a null id is the
last in order; other columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, written

WINDOW = 3


def windows_of(lines: Column) -> Column:
    """An array of (w1, w2, pos): the hashes of each window of an array of lines."""
    n = F.size(lines)
    both = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) == "").alias("blank")))

    def window(i: Column) -> Column:
        at = [F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]
        blank = at[0]["blank"] & at[1]["blank"] & at[2]["blank"]
        return F.struct(
            F.when(~blank, F.xxhash64(*(x["a"] for x in at))).alias("w1"), F.xxhash64(*(x["b"] for x in at)).alias("w2"), i.alias("pos")
        )

    return both, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array())


def kept_lines(lines: Column, at: Column) -> Column:
    """The lines outside the three that start at each of the sorted positions `at`, merged to ranges first."""
    last = F.size(at) - 1
    starts = F.filter(at, lambda p, i: (i == 0) | (p > F.get(at, i - 1) + WINDOW))
    ends = F.transform(F.filter(at, lambda p, i: (i == last) | (F.get(at, i + 1) > p + WINDOW)), lambda p: p + WINDOW)
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("low"), F.concat(starts, F.array(F.size(lines))).alias("high"))
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["low"] + 1, g["high"] - g["low"])))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text less its repeated lines, n_lines and n_removed (long; of columns with these names, these stay)."""
    th, lines, at = fresh(docs, "th", "lines", "at")
    slim = docs.select(col(id_col).alias("id"), F.split(col(text_col).cast("string"), "\n").alias("lines"), F.xxhash64(col(text_col)).alias("th")).where(F.size("lines") >= WINDOW)
    hashes, windows = windows_of(F.col("lines"))
    found = slim.select("id", "th", "lines", hashes.alias("_hashes")).select("id", "th", F.explode(windows).alias("w")).select("w.w1", "w.w2", "id", "th", "w.pos").where("w1 IS NOT NULL")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("th"), F.col("pos"))
    repeated = written(
        found.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"), "windows"
    )
    later = (
        found.hint("shuffle_merge").join(repeated, ["w1", "w2"])
        .where(place > F.col("first"))
        .groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        .select(F.col("id").alias("_id2"), F.col("th").alias("_th2"), F.col("at").alias(at))
    )
    later = written(later, "later")
    rows = docs.withColumn(th, F.xxhash64(col(text_col)))
    later = later.select(*(F.col(c).alias(n) for c, n in zip(later.columns, fresh(rows, "id2", "th2", at), strict=True)))
    id2, th2, at2 = later.columns
    joined = rows.hint("shuffle_merge").join(later, rows[f"`{id_col}`"].eqNullSafe(later[id2]) & (rows[th] == later[th2]), "left")
    joined = joined.withColumn(lines, F.split(col(text_col).cast("string"), "\n"))
    kept = F.when(F.col(at2).isNull(), F.col(lines)).otherwise(kept_lines(F.col(lines), F.col(at2)))
    joined = joined.withColumn(at, kept)
    keep = [
        F.when(F.col(at2).isNull(), col(c)).otherwise(F.array_join(F.col(at), "\n")).alias(c) if c == text_col else col(c)
        for c in docs.columns if c.lower() not in ("n_lines", "n_removed")
    ]
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n = F.when(col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col(at2).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(at)).cast("long")
    return joined.select(*keep, n.alias("n_lines"), removed.alias("n_removed"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, pos, array_to_string(l[pos + 1 : pos + 3], chr(10)) AS k FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w WHERE regexp_matches(k, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (VALUES (0), (1), (2)) offsets(o) WHERE nth > 1),
u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM d WHERE doc_id IN (SELECT doc_id FROM c)),
k AS (
  SELECT u.doc_id, string_agg(line, chr(10) ORDER BY u.pos) FILTER (WHERE c.pos IS NULL) AS text, count(c.pos) AS n
  FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.pos = c.pos GROUP BY u.doc_id)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
