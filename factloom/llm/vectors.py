"""Integer vectors: what the code compression and the clustering share.

Vectors become whole numbers once, in the JVM; everything after that is exact. Distances are compared as
squares; where a root is needed as a bound it is rounded to the safe side.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components (rows times width) that a task works on at once.
PIECE = 1 << 20


def most_component(width: int) -> int:
    """Largest component with which no squared distance of this width can leave 64 bits."""
    return math.isqrt((2**63 - 1) // max(1, width)) // 2


def whole_vectors(table: DataFrame, scale: int, width: int | Column, *carried: str) -> DataFrame:
    """Rows (carried columns, v) of vectors of this width, each component x as floor(scale * x).

    Left out: null vectors, vectors of another width, and those that hold a null, a NaN, an infinity or a number
    so large that a squared distance would not fit a long.
    """
    size = F.size("embedding")
    most = F.floor(F.sqrt(F.lit(float(2**63 - 1)) / F.greatest(size, F.lit(1))) / 2) - 1
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < most / scale))
    # NaN is greater than any number in Spark's order, so it does not fit either.
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.where(F.col("embedding").isNotNull() & (size == width) & fits).select(*carried, v.alias("v"))


def first_vectors(vectors: DataFrame, order: Column, n: int, key: str = "vec_id") -> list[list[int]]:
    """The vectors of the n least different ids by `order`, ascending; of rows that repeat an id, the least vector.

    Each turn takes n rows by a bounded sort; further turns are needed only where ids repeat.
    """
    found: dict = {}
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), order.alias("rank"), "v")
    while len(found) < n:
        turn = rows.orderBy("rank", "id", "v").limit(n).collect()
        for r in turn:
            found.setdefault((r["rank"], r["id"]), list(r["v"]))
        if len(turn) < n:
            break
        rank, key_ = turn[-1]["rank"], turn[-1]["id"]
        rows = rows.where((F.col("rank") > F.lit(rank)) | ((F.col("rank") == F.lit(rank)) & (F.col("id") > F.lit(key_))))
    return [found[k] for k in sorted(found)[:n]]


def matrix(column, width: int) -> np.ndarray:
    """A list column of an Arrow batch as rows of whole numbers."""
    return np.asarray(column.flatten()).reshape(len(column), width).astype(np.int64, copy=False)


def listed(rows: np.ndarray):
    """Rows of a matrix as an Arrow list column."""
    import pyarrow as pa

    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def root_down(squares: np.ndarray) -> np.ndarray:
    """Whole roots, rounded down, exact for every 64-bit square."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    r = root_down(squares)
    return r + (r * r < squares)


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, entry by entry so that memory stays that of the rows."""
    out = np.empty((len(x), len(entries)), np.int64)
    for j, e in enumerate(entries):
        d = x - e
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def mean_down(sums: list[int], count: int) -> list[int]:
    return [s // count for s in sums]


def summed(partials: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Task sums (key, n, sums) added up by key: {key: (count, sums)}; as many rows as there are keys and components."""
    long = partials.select("key", "n", F.posexplode("sums").alias("pos", "s"))
    rows = long.groupBy("key", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    out: dict[int, tuple[int, dict]] = {}
    for r in rows:
        out.setdefault(r["key"], (int(r["n"]), {}))[1][r["pos"]] = int(r["s"])
    return {k: (n, [s[p] for p in range(len(s))]) for k, (n, s) in out.items()}


def long_sum(column: str) -> Column:
    """Sum as a long; null where it would not fit."""
    return F.expr(f"try_cast(sum(cast({column} as decimal(38,0))) as bigint)")
