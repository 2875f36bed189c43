"""Candidate pairs of items that share a bucket, dealt out in units of bounded size, without listing the pairs.

Items have a 16-byte key and values of `bands` hash functions. Two items are a candidate pair if they agree in a band.
A bucket's leader is its least key. All buckets that one leader leads form one group, so that a large group of similar
items is shipped once for each leader and not once for each band. A mask tells in which bands an item is in a bucket of
the leader. A pair is compared exactly once: in the group of the leader of the first band in which the two agree.

A group larger than `unit_rows` items or `unit_bytes` bytes is cut into blocks by key, and every two blocks
form a unit: no task ever holds more than two blocks, and n items cost n * n / unit_rows shipped rows in place of
n * n / 2 pairs. A unit returns counts of links for each item and a spanning forest of the links, so its output is as
long as its input at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, written

RESULT = "key binary, links long, toward binary"


def memberships(items: DataFrame, unit_rows: int, unit_bytes: int) -> DataFrame:
    """items (key, bands array<long>, n_bytes long), one row a key -> (leader, i, j, key, block, mask) of the units."""
    rows = items.select("key", F.posexplode("bands").alias("band", "value"))
    shared = written(
        rows.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("key").alias("leader")).where("n > 1").drop("n"), "buckets"
    )
    led = (
        rows.hint("shuffle_merge").join(shared, ["band", "value"])
        .groupBy("leader", "key")
        .agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    )
    led = written(led.hint("shuffle_merge").join(items.select("key", "n_bytes"), "key"), "led")
    blocks = written(
        led.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
        .select("leader", F.greatest(F.ceil(F.col("n") / unit_rows), F.ceil(F.col("size") / unit_bytes), F.lit(1)).cast("int").alias("blocks")),
        "blocks",
    )
    return (
        led.hint("shuffle_merge").join(blocks, "leader")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block", "mask")
    )


def compare(units: DataFrame, payload: DataFrame, linked: Callable) -> DataFrame:
    """Joins units with payload (key, copies long, n_bytes, ...) and compares; -> (key, links, toward).

    linked(table, left, right) gets a unit's Arrow table and two index arrays, and tells which pairs are links.
    A row's links counts copies of what the item is linked to; toward is a linked item that makes the forest.
    """
    names = [c for c in payload.columns if c != "key"]
    rows = units.hint("shuffle_merge").join(payload, "key").select("leader", "i", "j", "key", "block", "mask", *names)

    def run(table: pa.Table) -> pa.Table:
        forget()
        table = table.combine_chunks()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block = table["block"].to_numpy()
        mask = table["mask"].to_numpy().view(np.uint64)
        bands = np.frombuffer(b"".join(table["band_values"].to_pylist()), dtype=np.uint64).reshape(len(table), -1)
        copies = table["copies"].to_numpy()
        keys = table["key"].to_pylist()
        links, forest = np.zeros(len(keys), np.int64), Forest(len(keys))
        rows_i = np.nonzero(block == i)[0]
        rows_j = rows_i if i == j else np.nonzero(block == j)[0]
        step = max(1, 1 << 19 >> max(1, len(rows_j)).bit_length())
        for at in range(0, len(rows_i), step):
            left, right = np.meshgrid(rows_i[at : at + step], rows_j, indexing="ij")
            left, right = left.ravel(), right.ravel()
            if i == j:
                left, right = left[(keep := left < right)], right[keep]
            both = mask[left] & mask[right]
            left, right, both = left[(keep := both != 0)], right[keep], both[keep]
            first = np.zeros(len(left), np.uint64)
            for k in range(bands.shape[1] - 1, -1, -1):
                first[bands[left, k] == bands[right, k]] = np.uint64(1 << k)
            left, right = left[(keep := first & both != 0)], right[keep]
            if len(left):
                yes = linked(table, left, right)
                left, right = left[yes], right[yes]
                links += np.bincount(left, copies[right], len(keys)).astype(np.int64)
                links += np.bincount(right, copies[left], len(keys)).astype(np.int64)
                forest.add(left, right)
        rows = np.nonzero(links)[0]
        roots = forest.roots()
        return pa.table(
            {"key": pa.array([keys[r] for r in rows], pa.binary()), "links": pa.array(links[rows]), "toward": pa.array([keys[roots[r]] for r in rows], pa.binary())}
        )

    return rows.groupBy("leader", "i", "j").applyInArrow(run, RESULT)


def settled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (key, copies, least) and what compare returned -> (key, n_links, class_id, group) for each class.

    n_links counts the other rows that a row of the class is linked to, its copies included; class_id is the least id of
    the group, which `group` names by a key.
    """
    links = written(links, "links")
    roots = components(links.select(F.col("key").alias("a"), F.col("toward").alias("b")))
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    placed = written(
        classes.select("key", "copies", "least")
        .join(counted, "key", "left")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("group")),
        "placed",
    )
    least = written(placed.groupBy("group").agg(F.min("least").alias("class_id")), "least")
    return written(placed.hint("shuffle_merge").join(least, "group").select("key", "n_links", "class_id", "group"), "named")


class Forest:
    """Connected components within a unit."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.root[left], self.root[right]
            left, right = left[(keep := a != b)], right[keep]
            if not len(left):
                return
            a, b = a[keep], b[keep]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]

    def roots(self) -> np.ndarray:
        return self.root
