"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns they were given: the classifier drops what it rejects, exact dedup keeps one document
of each group of equal texts, the Jaccard join one of each group of near copies, and mixing repeats or
omits documents so that each source meets its target. The last encodes and decodes what is left.

Nulls: a null text counts as empty and is rejected by the classifier; a null source is a source of its
own; a row with a null doc_id is judged like others, and only the Jaccard join leaves it alone. Ties and
repeated rows: of equal texts, and of near copies, the least doc_id stays, one row of it. Very long
texts pass whole through every stage. Empty tables give no rows. doc_id must be a whole number, as the Jaccard
stage orders and packs ids; other types are refused at the start. Further columns, whatever their names,
are carried along to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from factloom.llm import exact_dedup, jaccard_join, mixing, quality_classifier, queries, sentencepiece_bpe
from factloom.llm.common import read_table, release, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_kept(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies_removed(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates_removed(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mix),
    ("SentencePiece", tokens),
]

#: The classifier's training and the segment coder are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    if not isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError(f"doc_id is {docs.schema['doc_id'].dataType.simpleString()}; the pipeline needs whole numbers")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = store(out, f"pipeline-{k}")
            release(docs)  # what a stage was given is not read again once its result is stored
        docs = out
    return docs
