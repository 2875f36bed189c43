"""N-gram Jaccard join (operator 1): MinHash bands propose, a Bayesian test prunes, exact sets decide.

Words are runs of characters other than the six ASCII white-space characters; shingles are five consecutive words, and
a text of one to four words is its own single shingle. The similarity of two texts is that of their sets of shingles.

1. Each text gives, in Arrow batches, the identity of its shingle set (128 bits) and 32 bands of four MinHash values.
   Two texts with similarity 0.8 share no band with probability (1 - 0.8^4)^32 < 5e-8.
2. Texts with the same set are one class, counted before anything is shuffled; only classes go on.
3. pair_units deals classes that share a bucket to units of bounded size; a unit compares a pair exactly once.
4. In a unit the 128 MinHash values of a pair are compared in steps of 16. After each step the pair is dropped if the
   posterior probability that its similarity reaches the threshold, under a uniform prior, is below `tolerance`.
5. The pairs left are decided by the exact sizes of intersection and union of the sets of 64-bit shingle hashes.

Results that the cases have: null text counts as empty; texts without a word all have the same, empty set and are one class; a
null doc_id is an ordinary row and is left out when the least doc_id of a class is taken (null if there is no other);
rows that repeat are copies. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, process_cache, text_of, written
from .pair_units import compare, memberships, settled

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
TOLERANCE = 1e-6
UNIT_ROWS = 512
UNIT_BYTES = 8 << 20
#: Shingles that are hashed at once; a longer text is hashed alone.
BATCH = 150_000
SPACE = " \t\n\x0b\x0c\r"


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown to `most` words."""

    most = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    """Runs of characters other than ASCII white space (str.split() would also cut at other white space)."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles_of(text: str, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out + one[k : n - size + 1 + k])
    return np.unique(out)


def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of n hash functions; fixed."""
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row of BANDS * ROWS for each set; all ones for an empty set."""
    out = np.full((len(sets), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    rows = [r for r, s in enumerate(sets) if len(s)]
    if rows:
        x = (np.concatenate([sets[r] for r in rows]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[r]) for r in rows])[:-1]])
        a, b = factors(BANDS * ROWS)
        got, space = np.empty((BANDS * ROWS, len(rows)), np.uint32), np.empty_like(x)
        for k in range(BANDS * ROWS):
            np.multiply(x, a[k], out=space)
            space += b[k]
            got[k] = np.minimum.reduceat(space, starts)
        out[rows] = got.T
    return out


def band_values(values: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band."""
    out = np.zeros((len(values), BANDS), np.uint64)
    for k in range(ROWS):
        out = mixed(out * np.uint64(3) + values[:, k::ROWS])
    return out


def batched(texts, limit: int = BATCH):
    """Texts' shingle sets in lists of about `limit` shingles."""
    hashes, now, size = process_cache("word_hashes", WordHashes), [], 0
    for text in texts:
        now.append(shingles_of(text or "", hashes))
        size += len(now[-1])
        if size >= limit:
            yield now
            now, size = [], 0
    if now:
        yield now


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signed(batches):
    """Arrow batches (.., text) -> the same columns but the text, with key, bands and n_bytes."""
    for batch in batches:
        texts = batch["_text"].to_pylist()
        keys, bands, n_bytes = [], [], []
        for sets in batched(texts):
            keys += map(set_key, sets)
            n_bytes += [8 * len(s) for s in sets]
            bands.append(band_values(minhash(sets)))
        flat = np.concatenate(bands).view(np.int64).ravel() if bands else np.zeros(0, np.int64)
        offsets = np.arange(0, BANDS * len(texts) + 1, BANDS, np.int32)
        yield pa.RecordBatch.from_pydict(
            {"_id": batch["_id"], "_th": batch["_th"], "key": pa.array(keys, pa.binary()), "bands": pa.ListArray.from_arrays(offsets, flat), "n_bytes": pa.array(n_bytes, pa.int64())}
        )


def loaded(batches):
    """Arrow batches (key, copies, text) -> payload of the units."""
    for batch in batches:
        copies, keys, at = batch["copies"], batch["key"], 0
        for sets in batched(batch["_text"].to_pylist()):
            values, n = minhash(sets), len(sets)
            bands = band_values(values)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": keys[at : at + n], "copies": copies[at : at + n], "band_values": pa.array([b.tobytes() for b in bands], pa.binary()),
                    "values": pa.array([v.tobytes() for v in values], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                }
            )
            at += n


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """The fewest matches of n MinHash values with which P(similarity >= threshold) is still at least `tolerance`.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def reaches(threshold: float, common: np.ndarray, union: np.ndarray) -> np.ndarray:
    """common / union >= threshold, in whole numbers so that ties at the threshold are exact."""
    per_mille = round(threshold * 1_000_000)
    return common * 1_000_000 >= per_mille * union


def linker(threshold: float, tolerance: float):
    """The test of candidate pairs within a unit: Bayesian pruning, then exact verification."""
    total, step = BANDS * ROWS, 16
    least = {n: least_matches(threshold, tolerance, n) for n in range(step, total + 1, step)}

    def linked(table: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        values = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint32).reshape(len(table), total)
        alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
        for n, need in least.items():
            part = slice(n - step, n)
            for at in range(0, len(alive), 65_536):
                some = alive[at : at + 65_536]
                matches[some] += (values[left[some], part] == values[right[some], part]).sum(axis=1)
            alive = alive[matches[alive] >= need]
        yes = np.zeros(len(left), bool)
        yes[alive] = exact(table, left[alive], right[alive], threshold)
        return yes

    return linked


def exact(table: pa.Table, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least threshold, from the whole sets."""
    if not len(left):
        return np.zeros(0, bool)
    used, back = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = back[: len(left)], back[len(left) :]
    blobs = table["shingles"].take(pa.array(used)).to_pylist()
    sizes = np.array([len(x) // 8 for x in blobs], np.int64)
    ids, counts = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(used)), sizes)
    common = np.zeros(len(left), np.int64)
    everywhere = counts == len(used)  # in every set of the unit: counts for every pair
    common += int(everywhere.sum())
    some = (counts > 1) & ~everywhere  # the others are in one set only
    place = np.cumsum(some) - 1
    keep = some[ids]
    owner, ids, width = owner[keep], place[ids[keep]], int(some.sum())
    if len(left) * 50 < len(used) * width / 50:  # few pairs over a wide vocabulary: merge the sorted lists
        starts = np.searchsorted(owner, np.arange(len(used) + 1))
        for k in range(len(left)):
            x, y = ids[starts[a[k]] : starts[a[k] + 1]], ids[starts[b[k]] : starts[b[k] + 1]]
            common[k] += len(np.intersect1d(x, y, assume_unique=True))
    else:  # products of 0/1 matrices, a slice of the vocabulary at a time
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        rows, columns = np.unique(a), np.unique(b)
        at_a, at_b = np.searchsorted(rows, a), np.searchsorted(columns, b)
        for low in range(0, width, 2048):
            part = slice(*np.searchsorted(ids, (low, low + 2048)))
            m = np.zeros((len(used), 2048), np.float32)
            m[owner[part], ids[part] - low] = 1
            common += (m[rows] @ m[columns].T)[at_a, at_b].astype(np.int64)
    return reaches(threshold, common, sizes[a] + sizes[b] - common)


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, unit_rows: int = UNIT_ROWS
) -> DataFrame:
    """One row for each row of docs: (id_col, class_id, n_links, group, text_hash).

    n_links counts the other rows whose similarity is at least threshold, copies of the text included; class_id is the
    least id that links reach, the row's own class included. group names the group even where ids are null;
    text_hash is the 128-bit hash of the text.
    """
    rows = docs.select(col(id_col).alias("_id"), text_of(docs, text_col).alias("_text"))
    th = F.struct(F.xxhash64("_text").alias("x"), F.xxhash64("_text", F.lit(7)).alias("y"))
    spark_rows = rows.withColumn("_th", th)
    id_type = rows.schema["_id"].dataType.simpleString()
    signs = written(
        spark_rows.select("_id", "_th", "_text").mapInArrow(signed, f"_id {id_type}, _th struct<x:bigint,y:bigint>, key binary, bands array<bigint>, n_bytes bigint"),
        "signs",
    )
    classes = written(
        signs.groupBy("key").agg(F.count("*").alias("copies"), F.min("_id").alias("least"), F.min(F.struct("_th", "_id")).alias("_at"), F.min("n_bytes").alias("n_bytes")),
        "classes",
    )
    # the empty set is one class and links with nothing else; bands of a class are those of any of its texts
    banded = signs.where("n_bytes > 0").select("key", "bands", "n_bytes").dropDuplicates(["key"])
    units = written(memberships(banded, unit_rows, UNIT_BYTES), "units")
    wanted = classes.join(units.select("key").distinct(), "key").select("key", "copies", "_at")
    found = (
        spark_rows.hint("shuffle_merge").join(wanted, (spark_rows["_th"] == wanted["_at._th"]) & spark_rows["_id"].eqNullSafe(wanted["_at._id"]))
        .select("key", "copies", "_text")
        .mapInArrow(loaded, "key binary, copies bigint, band_values binary, values binary, shingles binary")
        .groupBy("key").agg(*(F.first(c).alias(c) for c in ("copies", "band_values", "values", "shingles")))
    )
    named = settled(classes, compare(units, found, linker(threshold, tolerance)))
    return (
        signs.select("_id", "_th", "key").hint("shuffle_merge").join(named, "key")
        .select(F.col("_id").alias(id_col), "class_id", "n_links", "group", F.col("_th").alias("text_hash"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs less all rows of a group of linked texts but one: that of the least id, and of the least text hash among its rows.

    Rows alike in id and text are one row of the result. Groups without any id keep one row too.
    """
    th, id2, th2, low = fresh(docs, "th", "id2", "th2", "low")
    joined = ngram_jaccard_join(docs, id_col, text_col, **how)
    # within a class the first row by id, then by text hash: an aggregate with map-side combining
    first = joined.groupBy("group").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("th"))).alias("one"))
    chosen = first.select(F.col("one.id").alias(id2), F.col("one.th").alias(th2))
    text = text_of(docs, text_col)
    rows = docs.withColumn(th, F.struct(F.xxhash64(text).alias("x"), F.xxhash64(text, F.lit(7)).alias("y")))
    out = rows.hint("shuffle_merge").join(chosen, rows[f"`{id_col}`"].eqNullSafe(F.col(id2)) & (F.col(th) == F.col(th2)))
    twins = Window.partitionBy(id2, th2).orderBy(F.lit(0))
    return out.withColumn(low, F.row_number().over(twins)).where(F.col(low) == 1).select(*map(col, docs.columns))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_jaccard_join(docs).drop("group", "text_hash").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


#: Every pair that shares a shingle, by SQL; words and shingles as above.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM shingles),
flat AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n - count(*) AS u, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
links AS (
  SELECT x, y FROM common WHERE c * 5 >= u * 4
  UNION ALL SELECT a.doc_id, b.doc_id FROM sized a JOIN sized b ON a.n = 0 AND b.n = 0 AND a.doc_id <> b.doc_id),
reach(x, y) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
SELECT s.doc_id, class_id, coalesce(l.n, 0) AS n_links, s.doc_id = class_id AS kept
FROM sized s JOIN class ON class.x = s.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = s.doc_id
"""
