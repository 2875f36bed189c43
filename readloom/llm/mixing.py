"""Mixing sources to target weights (operator 9) by weighted fair queueing.

Sources by code point, null last, weigh 5, 2, 1, repeating. They share 100 % of all words by weight; a target stops at
`max_passes` times its source's size, and the excess is shared again by weight. Each source's documents stand in a
shuffled, reproducible order, repeated in whole passes; a document's virtual finish time is the source's words up to its
end divided by the source's target. Documents of all sources are merged by that time and cut at the total budget.

Running sums are taken in two levels, so that no source and no time range has to be in one task: the shuffled order is cut
into `BUCKETS` ranges a source and the queue into `SLICES` ranges of time; sums of ranges are aggregated with map-side combining,
and only the rows of one range are ever in order in one task. What reaches the driver are five numbers.

Results that the cases have: a null text has size 0; null doc_ids are placed by their texts, so that many of them spread over the ranges; repeated rows are ordinary rows, and those alike in order,
id, text and size are told apart arbitrarily, which leaves the rows of the result the same; a null source is a source of its
own, after all others; documents of size 0 and sources without words have target 0 or taken 0; an empty table gives an empty
result. Columns of docs with names that the result uses are replaced in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, dropped, fresh, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
BUCKETS = 4096
SLICES = 8192
LATE = 1.5
SEED = "mix"


def word_count(text):
    """The number of runs of characters other than the six ASCII white-space characters."""
    gaps = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(gaps, " +"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """sizes (known, source, source_size), one row a source -> the same with target.

    In order of size to weight, the sources at their limit come first: a source is at its limit exactly if what those before it
    leave, shared by the weights of the rest, gives it at least that. This is where resharing again and again ends.
    """
    one = Window.orderBy("unknown", "source")
    each = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sizes.withColumn("weight", each).withColumn("most", (max_passes * F.col("source_size")).cast("double"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "unknown", "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    table = table.withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn(
        "left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    table = table.withColumn("at_most", F.col("most") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    free = F.min(F.when(~F.col("at_most"), F.struct((F.col("most") / F.col("weight")).alias("r"), "unknown", "source", "left_words", "left_weight"))).over(whole)
    share = free["left_words"] * F.col("weight") / free["left_weight"]
    return table.select("unknown", "source", "source_size", F.when(F.col("at_most"), F.col("most")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_passes: int = MAX_PASSES, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """docs, or its columns to keep, with size, source_size, target and taken (words the mix takes of the document, repeats counted).

    Texts are counted once: what is kept is written with its size.
    """
    spark = docs.sparkSession
    size, unknown, source, order, tie, bucket, cum, start = fresh(docs, "size", "unknown", "source", "order", "tie", "bucket", "cum", "start")
    text = text_of(docs, text_col)
    rows = (
        docs.withColumn(size, word_count(text))
        .withColumn(unknown, col(source_col).isNull())
        .withColumn(source, F.coalesce(col(source_col).cast("string"), F.lit("")))
        .withColumn(order, F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(text))))))
        .withColumn(tie, F.xxhash64(text))
        .withColumn(bucket, F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    )
    keep = [c for c in docs.columns if (keep is None or c in keep) and c.lower() not in ("size", "source_size", "target", "taken")]
    rows = written(rows.select(*map(col, keep), size, unknown, source, order, tie, bucket), "sizes")
    slim = rows.select(*(F.col(c).alias(n) for c, n in ((size, "size"), (unknown, "unknown"), (source, "source"), (order, "order"), (tie, "tie"), (bucket, "bucket"))))
    parts = written(slim.groupBy("unknown", "source", "bucket").agg(F.sum("size").alias("words")), "ranges")
    sources = written(targets(parts.groupBy("unknown", "source").agg(F.sum("words").alias("source_size")), weights, max_passes), "sources")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    starts = written(
        parts.withColumn("start", F.sum("words").over(Window.partitionBy("unknown", "source").orderBy("bucket")) - F.col("words"))
        .drop("words")
        .join(sources, ["unknown", "source"]),
        "starts",
    )

    def placed(df: DataFrame, by: list[str], order_by: list[str], size_name: str) -> DataFrame:
        """df with the sum of sizes in the source's order up to and with the row, and the source's size and target."""
        inside = Window.partitionBy(*by).orderBy(*order_by, size_name).rowsBetween(Window.unboundedPreceding, 0)
        table = starts.select(*(F.col(c).alias(n) for c, n in zip(("unknown", "source", "bucket"), by, strict=True)), F.col("start").alias(start), "source_size", "target")
        return df.withColumn(cum, F.sum(size_name).over(inside)).hint("shuffle_merge").join(table, by).withColumn(cum, F.col(cum) + F.col(start))

    def finish(pass_no):
        return F.when(F.col("target") > 0, (F.col("source_size") * pass_no + F.col(cum)) / F.col("target"))

    passes = F.array(*map(F.lit, range(max_passes)))
    queue = placed(slim, ["unknown", "source", "bucket"], ["order", "tie"], "size").where("target > 0 AND size > 0")
    queue = written(queue.withColumn("pass", F.explode(passes)).select("size", finish(F.col("pass")).alias("time")), "queue")
    # the cut is near time 1 unless a few documents hold most words; ranges after LATE widen, so that their number stays small
    late = F.lit(LATE) + F.log2(F.col("time") / LATE)
    piece = F.floor(F.when(F.col("time") < LATE, F.col("time")).otherwise(late) * SLICES)
    slices = queue.groupBy(piece.alias("slice")).agg(F.sum("size").alias("words"), F.max("time").alias("latest"))
    running = slices.withColumn("until", F.sum("words").over(Window.orderBy("slice")))
    cut, last = running.agg(
        F.min(F.when(F.col("until") > budget, F.struct("slice", (F.col("until") - F.col("words")).alias("start")))), F.max(F.when(F.col("until") <= budget, F.col("latest")))
    ).first()
    if cut is not None:
        inside = queue.where(piece == cut["slice"]).withColumn("until", F.sum("size").over(Window.orderBy("time")) + cut["start"])
        found = inside.where(F.col("until") <= budget).agg(F.max("time")).first()[0]
        last = last if found is None else found
    taken = F.size(F.filter(F.transform(passes, finish), lambda t: t <= F.lit(last)))
    dropped(queue, parts)
    full = placed(rows, [unknown, source, bucket], [order, tie], size)
    full = full.withColumn("taken", F.when((F.col("target") > 0) & (F.col(size) > 0), taken).otherwise(0) * F.col(size))
    return full.select(*map(col, keep), F.col(size).alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """A row for each time that the mix takes a document."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    (copy,) = fresh(mixed, "copy")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).drop(copy)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS unknown, coalesce(source, '') AS source, md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), concat('null:', md5(coalesce(text, '')))))) AS h,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT unknown, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1, 2),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY unknown, source) - 1) % 3 + 1] AS weight,
    CAST(3 * source_size AS DOUBLE) AS most FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(most) OVER b, 0.0) AS left_words, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0) AS left_weight
  FROM w WINDOW b AS (ORDER BY most / weight, unknown, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT left_words, left_weight FROM l WHERE NOT most * left_weight <= weight * left_words ORDER BY most / weight, unknown, source LIMIT 1),
t AS (
  SELECT unknown, source, source_size, CASE WHEN most * left_weight <= weight * left_words THEN most
    ELSE (SELECT left_words FROM f) * weight / (SELECT left_weight FROM f) END AS target FROM l),
c AS (
  SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.unknown, d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM d JOIN t ON d.unknown = t.unknown AND d.source = t.source),
q AS (
  SELECT size, CAST(source_size * p + cum AS DOUBLE) / target AS finish FROM c, (VALUES (0), (1), (2)) passes(p) WHERE target > 0 AND size > 0),
cut AS (
  SELECT max(finish) AS last FROM (SELECT finish, sum(size) OVER (ORDER BY finish) AS until FROM q)
  WHERE until <= (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target, CASE WHEN target > 0 THEN size * (
    CAST(CAST(cum AS DOUBLE) / target <= last AS BIGINT) + CAST(CAST(source_size + cum AS DOUBLE) / target <= last AS BIGINT)
    + CAST(CAST(2 * source_size + cum AS DOUBLE) / target <= last AS BIGINT)) ELSE 0 END AS taken
FROM c, cut
"""
