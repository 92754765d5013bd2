"""Uploads: files to validated documents, keys of the object store, and ingestion without duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.base import first_match
from factloom.operators.sinks import insert_if_absent

MB = 1024 * 1024
MOST_MB, MOST_PAGES, SIGNATURE_WINDOW = 50, 300, 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, size of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.col("length").alias("size"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_key(digest: Column) -> Column:
    return F.concat(F.lit("documents/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".pdf"))


def page_key(digest: Column, page: Column) -> Column:
    return F.concat(F.lit("pages/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("/"), F.lpad(page.cast("string"), 4, "0"), F.lit(".png"))


def safe_key(key: Column) -> Column:
    """Whether a key stays inside the store's root."""
    return ~key.startswith("/") & ~key.rlike(r"(^|/)\.\.(/|$)")


def with_page_counts(files: DataFrame, open_pdf: Callable[[bytes], int]) -> DataFrame:
    """Adds page_count and open_error; `open_pdf` is the one place where a PDF library is needed."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            counts, errors = [], []
            for raw in pdf["content"]:
                try:
                    counts.append(open_pdf(bytes(raw)))
                    errors.append(None)
                except Exception as e:  # a broken file is a row, not a failed job
                    counts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(page_count=counts, open_error=errors)

    return files.mapInPandas(run, f"{_ddl(files)}, page_count int, open_error string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def validate_uploads(files: DataFrame, most_mb: int = MOST_MB, most_pages: int = MOST_PAGES) -> DataFrame:
    """Adds reason (null if the file is sound) and content_hash; the first failing check decides."""
    window = F.substring(F.col("content"), 1, SIGNATURE_WINDOW)
    signed = F.position(F.lit("255044462D"), F.hex(window)) % 2 == 1
    reason = first_match([
        (F.col("size") == 0, "empty_file"), (F.col("size") > most_mb * MB, "too_large"), (~signed, "not_a_pdf"), (F.lower("open_error").contains("password"), "encrypted"),
        (F.col("open_error").isNotNull(), "malformed"), (F.col("page_count") == 0, "no_pages"), (F.col("page_count") > most_pages, "too_many_pages"),
    ])
    return files.withColumn("reason", reason).withColumn("content_hash", F.when(reason.isNull(), content_hash(F.col("content"))))


def collection_name_error(name: Column) -> Column:
    """Why a collection may not be called so: names have 1 to 200 characters, blanks around them aside; null if it may."""
    n = F.length(F.trim(name))
    return F.when(name.isNull() | (n == 0), "empty_name").when(n > 200, "name_too_long")


def ingest(validated: DataFrame, stored: DataFrame, collection_id: str) -> tuple[DataFrame, DataFrame]:
    """(new documents to append, outcome of every file: accepted, duplicate or rejected) for one collection."""
    sound = validated.where("reason is null").withColumn("collection_id", F.lit(collection_id))
    new = insert_if_absent(stored, sound, ["collection_id", "content_hash"], ["path"])
    taken = new.select("path").withColumn("is_new", F.lit(True))
    outcome = validated.join(taken, "path", "left").select("path", first_match([(F.col("reason").isNotNull(), "rejected"), (F.col("is_new"), "accepted")], "duplicate").alias("outcome"), "reason")
    return new.withColumn("storage_key", document_key(F.col("content_hash"))), outcome
