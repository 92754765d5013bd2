"""Exact deduplication by an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text. A bucket is a key prefix of `depth` bits. The
directory opens with about one bucket for `capacity` keys and is doubled while any bucket is overfull:
the keys of overfull buckets, and only those, are dealt to the two buckets of the next depth; the
others stay as they are. Each level is written to the shared folder by owner tasks, which
hold contiguous key ranges; a bucket and all that it splits into stay with one owner, so a split moves
keys inside a task. Keys differ, so splitting ends by 64 bits at the latest.

The index decides every row. A key met once is settled by its own entry. Keys met more often are
chains: the texts behind them are aggregated where they are read (one row a text and salt), sent to
the owner of their bucket, and compared byte by byte there, so texts that collide part company. Rows take
their group from the owners' answers; a key that the index lacks has none.

Nulls: a null text counts as empty; a null doc_id loses to any other id of its group. Ties and
repeated rows: the smallest doc_id stays; of rows that repeat that very doc_id all are marked as
kept. Very long texts are taken whole. Empty tables give no rows. Only doc_id and text are read;
other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WS, apart, partitions, release, store, text_of

#: A hot text reaches its owner in so many rows at most, whatever the number of tasks that met it.
SALTS = 256
MOST_BITS = 64


def normalised(docs: DataFrame):
    return F.regexp_replace(text_of(docs), WS, " ")


def prefix(key: Column, depth: int) -> Column:
    """Top `depth` bits of a key, as a number."""
    return F.shiftrightunsigned(key, MOST_BITS - depth) if depth else F.lit(0).cast("long")


def first_depth(keys: int, capacity: int) -> int:
    """Depth of the directory that a table of so many keys opens with: its buckets are full on average, at most."""
    return max(0, math.ceil(math.log2(max(1, keys) / capacity)))


def owner_of(key: Column, depth: int, owners: int) -> Column:
    """The task that holds a key: contiguous ranges of the buckets of the opening directory."""
    return F.floor(prefix(key, depth) * owners / F.lit(2**depth)).cast("int")


def build_index(entries: DataFrame, capacity: int) -> DataFrame:
    """Index files (owner, bucket, depth, h, n, first, text_sha256), a bucket of at most `capacity` keys.

    entries: doc_id, h, text_sha256. first is the least doc_id of a key; text_sha256 one of its texts'.
    """
    owners = partitions(entries.sparkSession)
    keys = entries.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("text_sha256").alias("text_sha256"))
    open_ = store(keys, "exact-keys")
    depth = opening = first_depth(open_.count(), capacity)
    index = None
    while True:
        placed = open_.withColumn("owner", owner_of(F.col("h"), opening, owners)).withColumn("bucket", prefix(F.col("h"), depth))
        # Owners take their ranges and count their buckets without another shuffle.
        held = F.count("*").over(Window.partitionBy("owner", "bucket"))
        level = placed.repartitionById(owners, "owner").withColumn("held", held).withColumn("depth", F.lit(depth))
        level = store(level.select("owner", "bucket", "depth", "held", "h", "n", "first", "text_sha256"), "exact-level")
        full = level.where(F.lit(True) if depth == MOST_BITS else F.col("held") <= capacity).drop("held")
        index = full if index is None else index.unionByName(full)
        if depth == MOST_BITS:
            return index
        release(open_)
        open_ = level.where(F.col("held") > capacity).select("h", "n", "first", "text_sha256")
        if open_.isEmpty():
            return index
        depth += 1


def directory(index: DataFrame) -> DataFrame:
    """Directory entries (bucket, depth, first_slot, slots) at the global depth: a bucket of less depth fills several slots."""
    deepest = index.agg(F.max("depth")).first()[0] or 0
    width = F.expr(f"shiftleft(1L, {deepest} - depth)")
    return index.select("bucket", "depth").distinct().select("bucket", "depth", (F.col("bucket") * width).alias("first_slot"), width.alias("slots"))


def compare_chains(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Groups (h, text_sha256, keep_id, group_size) of the keys met twice or more, by the owners of their buckets."""
    owners = partitions(docs.sparkSession)
    chains = store(index.where("n > 1").select("h", "owner", "bucket"), "exact-chains")
    rivals = docs.select("doc_id", normalised(docs).alias("norm")).withColumn("h", F.xxhash64("norm")).join(chains, "h")
    rivals = rivals.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    met = rivals.groupBy("salt", "owner", "bucket", "h", "norm").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    owned = met.repartitionById(owners, "owner")
    # Equal hashes are one chain; grouping by the whole text as well tells its members apart by their bytes.
    groups = owned.groupBy("owner", "bucket", "h", "norm").agg(F.min("first").alias("keep_id"), F.sum("n").alias("group_size"))
    return groups.select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, capacity: int = 128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(docs)
    entries = store(docs.select("doc_id", F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256")), "exact-entries")
    return answer(entries, docs, build_index(entries, capacity))


def answer(entries: DataFrame, docs: DataFrame, index: DataFrame) -> DataFrame:
    """The entries with the groups that an index gives them."""
    single = index.where("n = 1").select("h", "text_sha256", F.col("first").alias("keep_id"), F.col("n").alias("group_size"))
    groups = store(single.unionByName(compare_chains(docs, index)), "exact-groups")
    out = entries.join(groups, ["h", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def exact_copies_removed(docs: DataFrame, capacity: int = 128) -> DataFrame:
    """The documents that stay, with the columns they came with: one row of each normalised text.

    Rows are told apart by id and text, so rows that repeat an id, or have none, are judged each by its
    own text. Rows that repeat an id and text are copies of each other too, and one of them stays.
    """
    judged = exact_dedup(docs, capacity).where("group_size > 1")
    judged = store(judged.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("times")), "exact-judged")
    # Only rows whose id is judged are shuffled with their texts; the others stay where they are read.
    clear, rest = apart(docs, store(judged.where("not kept or times > 1").select("doc_id").distinct(), "exact-listed"), "doc_id")
    sha = F.sha2(normalised(rest), 256)
    same = lambda t: rest["doc_id"].eqNullSafe(t["doc_id"]) & (sha == t["text_sha256"])
    lost, again = judged.where("not kept"), judged.where("kept and times > 1")
    stay = rest.join(lost, same(lost), "left_anti")
    if again.isEmpty():
        return clear.union(stay)
    single = stay.join(again, same(again), "left_anti")
    # Of repeated rows one stays; they differ at most in white space and in other columns. A row is one struct meanwhile, so no column of its own is in the way.
    repeated = stay.join(again, same(again), "left_semi")
    once = repeated.select(F.struct(F.col("doc_id"), F.sha2(normalised(repeated), 256)).alias("key"), F.struct(*[repeated[f"`{c}`"].alias(c) for c in docs.columns]).alias("row")).dropDuplicates(["key"])
    return clear.union(single).union(once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
