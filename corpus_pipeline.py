"""Corpus pipeline: quality, near-duplicates, repeated passages, leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on every document its predecessor
kept; all but the last return the columns of ``documents``.  Stages that shorten a
text set its ``n_chars`` anew.  ``run`` writes every stage's result to the shared
folder, as the stages read their input more than once.

Defined cases: null and empty texts pass every stage (there is nothing to judge, link
or cut) and have no token ids; extra columns are carried along; rows equal in id and
text are near-duplicates of each other, of which one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import fast_sketch, kn_quality, leaks, piece_bpe, suffix_dedup
from gradus.llm.common import read, stored, text_hash


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents above their language's perplexity threshold."""
    found = kn_quality.classify(docs, read(spark, sf_dir, "labels"))
    bad = found.where("not kept").select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    own = F.col("doc_id").cast("long")
    return docs.join(bad, own.eqNullSafe(F.col("__id")) & (text_hash(F.col("text").cast("string")) == F.col("__th")), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 0.8 of five-word shingles."""
    return fast_sketch.one_of_each(docs, shingle=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every repeat of a 200-byte passage but the first."""
    return _counted(suffix_dedup.cut(docs, keep="first"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages; drops documents that are mostly such."""
    return _counted(leaks.clean(docs, read(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, n_tokens and whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_bpe.encode_and_decode(docs, model)
    return coded.withColumn("lossless", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [("quality classifier", quality), ("near-duplicates", near_dedup), ("repeated passages", passages),
          ("benchmark decontamination", decontaminate), ("token ids", tokenise)]
ORACLE_SQL = None  # language model, sketches and vocabulary are beyond SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
