"""Thin queries over the driver's tables: each applies one operator and derives the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, grammar, hard_negatives, jaccard, language, near_dup, packing, pieces, quality_qda, quality_rules, resampling, sharding, warc
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, which every machine has at the same path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_along_curve(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages")))


def op4_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = grammar.write_shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return grammar.read_documents(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.adaptive_filter(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_qda.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= quality_qda.ACCEPT).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.identify(language.document_rows(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "lang", "posterior", "text_lang", "declared", "suffix", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.identify(language.page_rows(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "lang", "posterior", "text_lang", "declared", "host", "suffix", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dup.simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_exact_dedup, op3_warc, op4_token_grammar, op5_quality_rules, op6_sharding, op7_sentencepiece, op8_quality_classifier, op9_language_id, op10_simhash, op11_importance_resampling, op12_jaccard_join, op13_hard_negatives, language_id_pages)}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op3_warc": warc.ORACLE, "op5_quality_rules": quality_rules.ORACLE, "op11_importance_resampling": resampling.ORACLE, "op12_jaccard_join": jaccard.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
