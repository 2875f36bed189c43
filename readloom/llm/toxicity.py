"""Toxicity (operator 8): subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A text is cut evenly into windows of WINDOW to 2 * WINDOW words (one, if it is shorter). A window is the average of its words' vectors, a word the
average of the vectors of its character n-grams (3 to 6, with word ends marked) and of itself, each found in a table of BUCKETS vectors
by hash; a misspelt or unseen word shares most n-grams with the words it comes from. A linear softmax over that average gives the
probabilities of the classes in the window; a text has those of its most toxic window, so that length does not dilute a few words.

Table and softmax start small at random and are trained together by gradient descent with momentum over the whole sample. While they are, a text's log odds
are the mean of its windows' ones, weighted by a softmax over them that sharpens from the plain mean. Each bucket's step is divided by the
curvature that its shares bound, so that rare and frequent n-grams learn at one pace, and its vector's length is shrunk in each step (a group lasso): an n-gram that few texts
speak for stays at zero, and clean texts stay clean. SPARSITY and the other settings were chosen on folds 1 to 4 alone.

Training rows are a bounded sample of the labelled rows: of class 0 and 1 at most `per_class` documents of at most `most_chars`
characters, in order of a hash of the id; of near copies among them (half of their five-word shingles seen before) one is kept. That bound alone
limits what the driver gets. The trained model travels as the
buckets' class scores (table times softmax: BUCKETS floats), which give the same scores as the vectors. Scoring is by row: no shuffle.

Results that the cases have: null and empty texts, and those without words, have the score of the bias
alone; null ids cannot be labelled, and count as held out; labels that are null or neither 0 nor 1, and labels of unknown ids, are ignored; rows that
repeat get the same score; without labels of both classes every score is the share of class 1 seen, or 0; extra columns stay
where `score` keeps columns, and an empty table gives an empty result. Whole texts are scored, all their windows.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, process_cache, text_of

BUCKETS = 1 << 18
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
PER_CLASS = (2500, 1000)
MOST_CHARS = 20_000
STEPS = 110
WINDOW = 32
#: The step's size, its momentum, and what is added to a bucket's curvature.
RATE, MOMENTUM, DAMPING = 1.0, 0.9, 0.01
#: What a vector's length loses in a step, over the curvature.
SPARSITY = 0.07
#: The share of all weight that the texts of class 1 have in training.
BALANCE = 0.25
#: How sharp the weights of a text's windows become.
SHARPEST = 5.0
FOLDS = 5
#: Words whose scores a worker remembers.
REMEMBERED = 300_000
WORD = re.compile(r"\w+")


def buckets_of(word: str) -> list[int]:
    """The buckets of a word's n-grams and of the word itself."""
    marked = f"<{word}>"
    size = len(marked)
    if marked.isascii():  # a character is a byte
        data = marked.encode()
        out = [zlib.crc32(data[k : k + n]) % BUCKETS for n in GRAMS for k in range(size - n + 1)]
    else:
        out = [zlib.crc32(marked[k : k + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in GRAMS for k in range(size - n + 1)]
    out.append(zlib.crc32(marked.encode("utf-8", "surrogatepass")) % BUCKETS)
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_starts(words: int) -> np.ndarray:
    """Where the windows of so many words begin, and the end."""
    n = max(1, words // WINDOW)
    return np.arange(n + 1) * words // n


def without_copies(texts: list[str]) -> list[int]:
    """The texts at least half of whose shingles of five words are in no text before them."""
    seen: set[int] = set()
    out = []
    for k, text in enumerate(texts):
        w = words_of(text)
        mine = {zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4))}
        if 2 * len(mine & seen) < len(mine):
            out.append(k)
        seen |= mine
    return out


class Bags:
    """Texts as windows of words, and words as n-grams; every index is into the next array."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        words, sizes, windows = [], [], []
        for text in texts:
            found = words_of(text)
            words.append(np.array([known.setdefault(w, len(known)) for w in found], np.int64))
            sizes.append(np.diff(window_starts(len(found))))
            windows.append(len(sizes[-1]))
        grams = [buckets_of(w) for w in known]
        self.n_texts, self.n_words, size = len(texts), len(known), np.concatenate(sizes)
        self.word, self.n_windows = np.concatenate(words), len(size)
        self.window, self.share = np.repeat(np.arange(len(size)), size), np.repeat(1 / np.maximum(size, 1), size)
        self.text = np.repeat(np.arange(len(texts)), windows)
        self.grams = np.array([len(g) for g in grams], np.int64)
        self.bucket, self.owner = np.fromiter((b for g in grams for b in g), np.int64), np.repeat(np.arange(len(grams)), self.grams)

    def odds(self, scores: np.ndarray) -> np.ndarray:
        """The average score of each window."""
        word = np.bincount(self.owner, scores[self.bucket], self.n_words) / np.maximum(self.grams, 1)
        return np.bincount(self.window, word[self.word] * self.share, self.n_windows)

    def carried(self, windows: np.ndarray) -> np.ndarray:
        """What each bucket gets of values of windows, by its share."""
        word = np.bincount(self.word, windows[self.window] * self.share, self.n_words) / np.maximum(self.grams, 1)
        return np.bincount(self.bucket, word[self.owner], BUCKETS)


def trained(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(score of class 1 less that of class 0 for each bucket, bias) after joint training.

    With two classes the gradient of every embedding is a multiple of the difference of the two softmax rows, so a step needs one
    number a bucket: how much of the error it carries.
    """
    rng = np.random.default_rng(seed)
    kept = without_copies(texts)
    bags, labels = Bags([texts[k] for k in kept]), labels[kept]
    n = len(labels)
    table = rng.uniform(-0.1 / DIMENSIONS, 0.1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    soft, bias = rng.normal(0, DIMENSIONS**-0.5, (2, DIMENSIONS)), 0.0
    pace, pace_soft, pace_bias = np.zeros(BUCKETS), np.zeros_like(soft), 0.0
    many = np.maximum(np.bincount(labels, minlength=2), 1)
    weight = np.where(labels == 1, BALANCE / many[1], (1 - BALANCE) / many[0]) * n
    for step in range(steps):
        along = soft[1] - soft[0]
        odds = bags.odds(table @ along) + bias
        most = np.full(n, -np.inf)
        np.maximum.at(most, bags.text, odds)
        part = np.exp(SHARPEST * step / steps * (odds - most[bags.text]))
        part /= np.bincount(bags.text, part, n)[bags.text]
        error = (1 / (1 + np.exp(-np.clip(np.bincount(bags.text, part * odds, n), -50, 50))) - labels) * weight
        toward = bags.carried(error[bags.text] * part)
        if step % 10 == 0:  # the windows' shares move slowly
            curvature = bags.carried(weight[bags.text] * part) / 4 + DAMPING
        pace = MOMENTUM * pace - RATE * toward / curvature
        pull = toward @ table
        pace_soft = MOMENTUM * pace_soft - RATE * np.stack([-pull, pull]) / (25 * n)
        pace_bias = MOMENTUM * pace_bias - RATE * error.sum() / (n / 4)
        table += np.outer(pace, along / (along @ along))
        length = np.sqrt((table * table).sum(axis=1) * (along @ along))
        table *= np.maximum(0, 1 - RATE * SPARSITY / (curvature * np.maximum(length, 1e-12)))[:, None]
        soft += pace_soft
        bias += pace_bias
    return (table @ (soft[1] - soft[0])).astype(np.float32), float(bias)


class WordScores(dict):
    def __init__(self, scores: np.ndarray):
        self.scores = scores.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        b = buckets_of(word)
        value = self[word] = sum(map(self.scores.__getitem__, b)) / len(b)
        return value


def scorer(scores: np.ndarray, bias: float):
    """Texts to probabilities of class 1."""
    name = f"toxicity {zlib.crc32(scores.tobytes())} {bias}"

    def run(batches):
        known = process_cache(name, lambda: WordScores(scores))
        for batch in batches:
            out = []
            for text in batch["_text"]:
                words = words_of(text.as_py())
                z = bias
                if words:
                    cuts = window_starts(len(words))
                    z += float((np.add.reduceat(np.fromiter(map(known.__getitem__, words), float, len(words)), cuts[:-1]) / np.diff(cuts)).max())
                out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names[:-1]), pa.array(out, pa.float64())], [*batch.schema.names[:-1], "_score"])

    return run


def held_out(ids):
    """Whether crc32 of the id as text is a multiple of FOLDS; a null id is."""
    return F.coalesce(F.crc32(ids.cast("string")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: tuple[int, int] = PER_CLASS, most_chars: int = MOST_CHARS):
    """The model (bucket scores, bias), learnt from labelled rows that are not held out."""
    known = labels.select(col(id_col).alias("_id"), col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").where(~held_out(F.col("_id"))).distinct()
    texts = docs.select(col(id_col).alias("_id"), text_of(docs, text_col).alias("_text")).where(F.length("_text").between(1, most_chars))
    # ids first, with a margin for texts that are absent or too long, so that few texts move
    order = F.xxhash64("_id")
    ids = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(order, "_id").limit(2 * per_class[y])
        ids = some if ids is None else ids.union(some)
    joined = texts.join(F.broadcast(ids), "_id")  # at most twice as many ids as the sample has rows
    rows = []
    for y in (0, 1):
        rows += joined.where(F.col("_y") == y).orderBy(order, "_id", F.xxhash64("_text")).limit(per_class[y]).select("_text", "_y").collect()
    y = np.array([r["_y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(BUCKETS, np.float32), math.log(share / (1 - share)) if 0 < share < 1 else (700.0 if share else -701.0)
    return trained([r["_text"] for r in rows], y)


def score(docs: DataFrame, model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of class 1 in column `name`."""
    (text,) = fresh(docs, "text")
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    numbered = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*(col(c).alias(n) for c, n in zip(keep, numbered, strict=True)), text_of(docs, text_col).alias("_text"))
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in numbered)
    out = rows.mapInArrow(scorer(*model), f"{fields}, _score double")
    return out.select(*(F.col(n).alias(c) for n, c in zip(numbered, keep, strict=True)), F.col("_score").alias(name))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
