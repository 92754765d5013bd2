"""Intermediate tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows of a few numbers each are sent to every task.
MOST_BROADCAST = 250_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without it a local master takes a local one, a cluster none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written and read back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_small(table: DataFrame) -> DataFrame:
    """A stored table marked for broadcast if a count shows that it is small."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def dealt(table: DataFrame) -> DataFrame:
    """A table of short rows dealt evenly to tasks before costly work a row: a small file alone is read by one task or two."""
    spark = table.sparkSession
    return table.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: So many different readings are sent to every task at most.
MOST_READINGS = 50_000


def read_once(rows: DataFrame, keys: list[str], readings: dict[str, Column], name: str) -> DataFrame:
    """rows (stored, as they are read twice) with the columns that `readings` make of the `keys`. Where few combinations of keys differ, each is read once
    and joined; where more than MOST_READINGS do, every row is read for itself. The rows are the same either way."""
    few = stored(rows.select(*keys).distinct(), f"{name}-keys")
    if few.count() > MOST_READINGS:
        return rows.select("*", *[c.alias(n) for n, c in readings.items()])
    found = stored(dealt(few).select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[c.alias(n) for n, c in readings.items()]), name)
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(found[f"__key_{k}"]) for k in keys])
    return rows.join(F.broadcast(found), same, "left").drop(*[f"__key_{k}" for k in keys])


def read_each_once(rows: DataFrame, readings: dict[str, tuple[list[str], Column]], name: str) -> DataFrame:
    """rows with the columns that `readings` make, each of its own keys, as read_once does it for one set of keys; rows are gone through once for all keys and
    need not be stored. Joined by broadcast, they keep the order and the places that they have."""
    kinds = {k: rows.schema[k].dataType for keys, _ in readings.values() for k in keys}
    one = lambda i, own: F.struct(F.lit(i).alias("__of"), *[(F.col(k) if k in own else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()])
    few = stored(rows.select(F.explode(F.array(*[one(i, keys) for i, (keys, _) in enumerate(readings.values())])).alias("k")).select("k.*").distinct(), f"{name}-keys")
    counts = dict(few.groupBy("__of").count().collect())
    for i, (column, (keys, made)) in enumerate(readings.items()):
        if counts.get(i, 0) > MOST_READINGS:
            rows = rows.withColumn(column, made)
            continue
        found = stored(dealt(few.where(F.col("__of") == i)).select(*[F.col(k).alias(f"__key_{k}") for k in keys], made.alias(column)), f"{name}-{column}")
        same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(found[f"__key_{k}"]) for k in keys])
        rows = rows.join(F.broadcast(found), same, "left").drop(*[f"__key_{k}" for k in keys])
    return rows
