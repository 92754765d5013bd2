"""Queries opN_<name> over the test tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import ball_clusters, chat_format, exact_dedup, jaccard_join, language_id, mixing, quality_classifier, quality_rules, secret_scan, sentencepiece_bpe, suffix_dedup, vector_codes, warc_zip
from factloom.llm.common import read_table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all their evidence, and documents with text and source; models from labelled documents."""
    docs = read_table(spark, sf_dir, "documents")
    langs, table = language_id.fit_models(docs)
    records = language_id.from_pages(read_table(spark, sf_dir, "pages")).unionByName(language_id.from_documents(docs))
    return language_id.identify(records, langs, table)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(read_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(read_table(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings")).drop("label")


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters.ball_clusters(read_table(spark, sf_dir, "embeddings"))


def op13_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_roundtrip(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_sentencepiece, op3_suffix_dedup, op4_language_id, op5_secret_scan, op6_jaccard_join, op7_mix_sources, op8_quality_rules, op9_quality_classifier, op10_chat_format, op11_vector_codes, op12_ball_clusters, op13_warc_zip)
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op6_jaccard_join": jaccard_join.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_ball_clusters": ball_clusters.ORACLE,
    "op13_warc_zip": warc_zip.ORACLE,
}
