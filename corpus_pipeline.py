"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near copies stays, sources are
mixed to their targets, and the mix is encoded and decoded again. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet in the shared folder and reads again. All but the last return the columns of documents.

Results that the cases have, by stage: null and empty texts have the score of the bias, which is clean, and stay; they have no lines to lose; all of them are one
group of near copies, of which one row stays; they have size 0, so the mix takes none of them. Rows with a null id are never learnt from, are last in the order of
line dedup and of near copies, and are placed in the mix by their texts. Rows alike in id and text have one score, lose the same lines, and are one row after the third stage; of a group
of texts alike the row of the least id stays, and of rows alike in id the one of the least text hash. Long texts are never cut, an empty table gives an empty result, and
columns beyond those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, common, line_dedup, mixing, ngram_jaccard, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled rows outside the held-out fold, predicts as toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, name="toxic_score").where("toxic_score < 0.5").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a text that loses lines gets its new length. All rows stay."""
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, the one with the least id, null last; documents without links stay."""
    return ngram_jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. Reruns agree."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the token ids and the text decoded from them, of each document of the mix."""
    return bpe.bpe(docs, bpe.default_path(), keep=("source",))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage is a trained model and the last a vocabulary's merges, which SQL cannot express; tests hold each stage, on what the one before it kept,
#: against brute force, SQL or the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(common.MADE)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop_written(spark, since=before, keep=(docs,))  # what this run's stages have left
    return docs
