"""The corpus pipeline: quality classifier, language ID, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import exact_dedup, language, near_dup, packing, quality_qda
from faultline.llm.common import join_checked, staged, table
from faultline.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts."""
    rows = quality_qda.scored(docs, table(spark, sf_dir, "labels"))
    return rows.filter(F.col("score") >= quality_qda.ACCEPT).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    rejected = staged(language.identify(language.document_rows(docs)).filter("not kept").select("doc_id").distinct(), "rejected")
    return join_checked(docs, rejected, "doc_id", "left_anti", 16)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: few differing SimHash bits, or a similarity of 0.8 and more of five-word shingles."""
    return near_dup.keep_one(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences along the curve."""
    pieces = packing.pack_along_curve(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_classifier", quality), ("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("packing", pack)]

#: Discriminant scores, trigram models, XXH64 fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
