"""What the operators of this subpackage share: written tables, names, process caches, components."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


#: Paths of the tables that this process has written and not dropped, in order.
MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/readloom-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    MADE.append(path)
    return out


#: Names in the catalog of those of MADE that are bucketed, by path.
NAMES: dict[str, str] = {}


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As written, dealt once by the hash of a key into as many buckets as the session has shuffle partitions: windows and joins on the key then move no row again."""
    spark = df.sparkSession
    table, buckets = f"readloom_{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/readloom-{spark.sparkContext.applicationId}-{table}"
    df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.written_at = path
    MADE.append(path)
    NAMES[path] = table
    return out


def deleted(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    for found in paths:
        if found in NAMES:
            spark.sql(f"DROP TABLE {NAMES.pop(found)}")
        path = sc._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        MADE.remove(found)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` has made, once nothing reads them any more."""
    for table in tables:
        deleted(table.sparkSession, [table.written_at])


def drop_written(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables that `written` has made since there were so many in MADE, but those to keep; results that still read them are lost."""
    stay = {t.written_at for t in keep}
    deleted(spark, [p for p in MADE[since:] if p not in stay])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever its case rules."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def process_cache(name: str, make):
    """An object that a Python worker keeps over its tasks, until another name is asked for: one cache at a time."""
    module = sys.modules.setdefault("_readloom_process_cache", types.ModuleType("_readloom_process_cache"))
    held = module.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def forget() -> None:
    """Lets go of what a Python worker remembers, so that a stage without a cache does not stand on that of another."""
    module = sys.modules.get("_readloom_process_cache")
    if module is not None:
        module.__dict__.get("held", {}).clear()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node of an edge; root is the least node.

    Alternates large-star and small-star steps. A step aggregates with map-side combining, writes the least neighbours, and
    joins them with the edges, each side dealt for the join alone, so that Spark can split a hub's rows; the number of rounds
    grows with the logarithm of the longest path. Each round's edges are written to the shared folder; nothing is collected but
    one count and one checksum.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node is tied to the least one around that node
        both = now.select("a", "b").union(now.select("b", "a"))
        nearest = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = (
            both.hint("shuffle_merge")
            .join(nearest, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = written(large, "large")
        # small star: every smaller neighbour of a node, and the node, are tied to the least of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (
            large.hint("shuffle_merge")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        before, now = now, written(small, "small")
        dropped(before, nearest, large, least)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components: no fixed point in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
