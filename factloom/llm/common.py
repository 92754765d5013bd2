"""Shared helpers of the corpus operators: shared-folder tables and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the control characters 9 to 13.
WS = r"[\x20\x09-\x0D]+"
#: Texts go through the vectorised functions in pieces of this many bytes (one text at least).
CHUNK_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a local default only where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again (what was made of them has been stored itself)."""
    for t in tables:
        spark, path = t.sparkSession, getattr(t, "stored_at", None)
        if path:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Up to so many rows of a few numbers each are sent to every task.
MOST_BROADCAST = 250_000


def sized(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it is counted to be small; else a shuffle joins it."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


#: Bits of a filter for each key, and at most (64 MB; beyond it lets more rows through, but loses none).
KEY_BITS, MOST_BITS = 16, 1 << 29


def narrowed(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows joined with a stored table of distinct keys. Where these are too many to broadcast, a bitmap of their hashes goes to every
    task instead, and only rows that it lets through (about one in KEY_BITS of the others) are shuffled to be joined."""
    n = keys.count()
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(keys), key)
    bits = min(MOST_BITS, 1 << (KEY_BITS * n - 1).bit_length())
    slot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(slot).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__map"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    some = rows.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "__bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return some.drop("__bucket", "__map").join(keys, key)


def apart(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(clear, rest): rows whose `key` is surely not in a stored table of keys, told by a bitmap of their hashes that goes to every task,
    and all others (those that are listed, and about one in KEY_BITS besides). No row is shuffled, and no column of rows is in the way."""
    bits = min(MOST_BITS, 1 << max(15, (KEY_BITS * keys.count() - 1).bit_length()))
    slot = lambda t: F.pmod(F.xxhash64(t[key]), F.lit(bits)) + 1
    made = keys.groupBy(F.bitmap_bucket_number(slot(keys)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(keys))).alias("map"))
    maps = F.broadcast(store(made, "key-maps"))
    at = F.bitmap_bit_position(slot(rows))
    byte = F.conv(F.hex(F.substring(maps["map"], (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    listed = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    met = rows.join(maps, F.bitmap_bucket_number(slot(rows)) == maps["bucket"], "left")
    own = [rows[f"`{c}`"] for c in rows.columns]
    return met.where(~listed).select(*own), met.where(listed).select(*own)


def id_type(docs: DataFrame) -> str:
    """Type of doc_id, for schemas that carry it along."""
    return docs.schema["doc_id"].dataType.simpleString()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives what Arrow has freed back after every batch: workers outlive their tasks, and
    what they hold on to counts against their executor in all later stages."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pool = pa.default_memory_pool()
        for out in run(batches):
            yield out
            del out
            pool.release_unused()
        pool.release_unused()

    return each


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectorised hashing -------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    filled = 1
    while filled < n:  # doubling: powers[f:2f] = powers[:f] * base**f
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 2**64))
        filled += step
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(1 << 20, 1 << (n - 1).bit_length())
        _powers["up"], _powers["down"] = _power(_BASE, m), _power(pow(_BASE, -1, 2**64), m)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, code: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of code[data[t]] * base**t for t in [i, j)."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=out[1:])
    return out


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """Row ranges [i, j) of at most `most` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one more at the end)."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, code: np.ndarray = LOWER_CODE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the word index at which each row begins."""
    starts, ends, rows = word_bounds(data, offsets)
    s = prefix_sums(data, code)
    _, down = powers(len(data) + 1)
    h = mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, rows


_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's word shingles; a shorter row is one shingle, an empty row none."""
    words, rows = word_hashes(data, offsets)
    n = len(words)
    full = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * _SHINGLE[k]
    full = mix(full)
    out = []
    for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if j - i >= width:
            out.append(np.unique(full[i : j - width + 1]))
        elif j > i:
            short = np.uint64(j - i) + (words[i:j] * _SHINGLE[: j - i]).sum(dtype=np.uint64)
            out.append(mix(np.array([short ^ np.uint64(0x5851F42D4C957F2D)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
