"""The corpus pipeline: filter, deduplicate, mix and encode `documents`, one operator a stage."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, jaccard, mixing, repeats, toxicity
from lodestone.llm.common import checkpoint_dir, free_name, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. Null and empty texts are scored as empty; equal texts go or stay together."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones: sets of five words, similarity 0.8. Texts without words, null or empty, all stay; of rows equal in id and text one stays."""
    return jaccard.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that stand earlier too; n_chars follows. Documents left without text go; those that came without stay."""
    had = free_name(docs, "had_text")
    kept = repeats.without_repeats(docs.withColumn(had, F.coalesce(F.col("text") != "", F.lit(False))))
    kept = kept.where(~F.col(had) | (F.col("text") != ""))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes. A null source is a source; texts without words are repeated as often as their source as a whole."""
    return mixing.repeated(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each text (null: none); the last stage, so other columns end here."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]
#: The classifier and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again as the next one's input; only the last one's folder stays.

    Texts may be null or empty, ids shared, and columns of any name come along as far as the last stage; no documents give none.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{uuid.uuid4()}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if before is not None:  # what a written stage came from is no longer read
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{k}-{name}"
    return docs
