"""From raw documents to training order, in stages of one operator each.

Each stage takes the documents that the one before kept and returns those that
it keeps, with the columns of documents; the last returns training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallaxis.llm import _work, mixture, resampling, semantic, simhash, superkmers
from parallaxis.llm._work import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards those labelled good keeps."""
    return resampling.keep_target(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Of rows of one doc_id one stays; rows of null doc_id all do."""
    docs = docs.select(*COLUMNS)
    found = simhash.near_copies(docs.select("doc_id", "text"))
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*COLUMNS), "text")
    ranked = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("rank", F.row_number().over(first))
    return ranked.filter("rank = 1").select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that a smaller doc_id has too; a document left without words goes, and one that loses nothing keeps its text as it is."""
    done = superkmers.remove_repeats(docs.select(*COLUMNS)).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return semantic.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each pass over them, with the words taken and the position."""
    return mixture.in_order(mixture.mix(docs.select(*COLUMNS)), list(COLUMNS))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mixture", source_mixture),
]

#: Floating-point models and latent retrieval are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _work.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
