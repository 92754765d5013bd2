"""Writes that may be repeated: insert if absent, replacement of deterministic by model verdicts, and bucketed tables.

A bucketed table is a Parquet folder partitioned by `bucket`, the hash of its key. A batch reads and rewrites only
the buckets that its keys fall into: what is read is pruned to these partitions, and what is written
replaces these partitions only, when the job commits. A killed write leaves the old files in place, and doing it again
has the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of a bucketed table.
BUCKETS = 64


def insert_if_absent(stored: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows of `new` to append: first of their key by `order`, and of a key not stored yet."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    rows = new.withColumn("__n", first).where("__n = 1").drop("__n")
    on = None
    s = stored.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    for k in key:
        c = rows[k].eqNullSafe(s[f"__{k}"])
        on = c if on is None else on & c
    return rows.join(s, on, "left_anti")


def upgrade(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored and new rows by key: a model's row beats a deterministic one, else the stored row stays."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(*key).orderBy((F.col("method") == "model").desc(), "__new"))
    return both.withColumn("__n", best).where("__n = 1").drop("__n", "__new")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def bucket_of(*key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read_or_none(spark: SparkSession, path: str, exists_only: bool = False) -> DataFrame | bool | None:
    """A Parquet table (or, if asked, just True), or None where no row has been written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if exists_only or not fs.exists(p):
        return fs.exists(p) or None
    # A partitioned write of no rows leaves a folder with nothing but its mark.
    return spark.read.parquet(path) if any(f.getPath().getName()[0] not in "_." for f in fs.listStatus(p)) else None


def touched(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame | None:
    """Those buckets of a bucketed table that rows (with `bucket`) fall into; None before the first write."""
    table = read_or_none(spark, path)
    if table is None:
        return None
    found = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many rows as buckets at most
    return table.where(F.col("bucket").isin(found))


def append_new(spark: SparkSession, path: str, new: DataFrame, key: list[str], order: list, bucket_by: list[str], buckets: int = BUCKETS) -> None:
    """Appends to a bucketed table the rows whose key it does not hold yet; `bucket_by` is part of the key."""
    rows = new.withColumn("bucket", bucket_of(*bucket_by, buckets=buckets)).persist()
    table = touched(spark, path, rows)
    found = insert_if_absent(rows.limit(0) if table is None else table, rows, key, order)
    found.write.mode("append").partitionBy("bucket").parquet(path)
    rows.unpersist()


def upsert(spark: SparkSession, path: str, new: DataFrame, bucket_by: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Replaces the touched buckets of a bucketed table by merge(their rows, new rows), which must not change `bucket_by` of a row."""
    rows = new.withColumn("bucket", bucket_of(*bucket_by, buckets=buckets)).persist()
    table = touched(spark, path, rows)
    merged = merge(rows.limit(0) if table is None else table, rows)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    rows.unpersist()
