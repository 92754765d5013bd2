"""Product codes of vectors, with codebooks trained by Yinyang Lloyd on whole numbers.

A vector is cut into parts, and each part is replaced by the number of its nearest entry in the codebook of
its position. Per part the entries are clustered into a few groups once. A row carries, beside its codes, an
upper bound on the distance to its entry and one lower bound for each group on the distances to the group's
other entries. When entries move, the bounds are widened by their drift; only where a group's lower bound
does not lie above the upper bound are its entries looked at, with exact squared distances, so that ties
go to the lower number. Bounds are whole numbers rounded to the safe side: a group that is skipped is
strictly farther.

Each round is one pass over the rows, stored in the shared folder with codes and bounds (the table of the
round before is deleted), and one over its codes for the sums of each entry. Sums are added up in the tasks
first, so a hot code costs no more than others. Codebooks are parts x entries whole-number rows, whatever
the input's size.

Results in special cases: rows are left out if the vector is null, empty, holds a null, NaN or infinite component or one so large
that squared distances would not fit a long, or has another width than the first kept vector (by vec_id; that width is a
multiple of the number of parts). Rows without vec_id are coded but start no codebook. Repeated rows each
get their row; of rows that repeat a vec_id, one starts an entry. Fewer different ids than entries make a
smaller codebook. Null labels count together; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import release, sized, store
from factloom.llm.vectors import PIECE, first_vectors, listed, long_sum, matrix, mean_down, root_down, root_up, squared_distances, summed, whole_vectors

#: A lower bound where a group has no other entry.
FAR = 1 << 60


def entry_groups(book: np.ndarray, groups: int) -> np.ndarray:
    """Group of each entry: a few rounds of clustering of the entries themselves, begun with entries far apart."""
    centres = [0]
    while len(centres) < min(groups, len(book)):
        centres.append(int(squared_distances(book, book[centres]).min(axis=1).argmax()))
    means = book[centres].astype(np.float64)
    for _ in range(5):
        home = ((book[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.stack([book[home == g].mean(axis=0) if (home == g).any() else means[g] for g in range(len(means))])
    return home


def others(d2: np.ndarray, code: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Lower bound on the distance to the members other than the row's own entry."""
    apart = np.where(members[None, :] == code[:, None], -1, root_down(d2))
    return np.where(apart < 0, FAR, apart).min(axis=1, initial=FAR)


def first_assignment(x: np.ndarray, book: np.ndarray, home: np.ndarray, groups: int):
    """(code, upper, lower, squared distance) by looking at every entry."""
    d2 = squared_distances(x, book)
    code = d2.argmin(axis=1)  # the first of equals
    own = d2[np.arange(len(x)), code]
    lower = np.full((len(x), groups), FAR, np.int64)
    for g in range(groups):
        members = np.flatnonzero(home == g)
        if len(members):
            lower[:, g] = others(d2[:, members], code, members)
    return code, root_up(own), lower, own


def next_assignment(x: np.ndarray, book: np.ndarray, home: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray):
    """(code, upper, lower, groups scanned) after the entries moved by at most `drift`."""
    groups = lower.shape[1]
    upper = upper + drift[code]
    lower = lower - np.array([drift[home == g].max(initial=0) for g in range(groups)])
    rows = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    if not len(rows):
        return code, upper, lower, 0
    y, old, low = x[rows], code[rows], lower[rows]
    off = y - book[old]
    own = np.einsum("ij,ij->i", off, off)
    scan = low <= root_up(own)[:, None]  # with the exact distance fewer groups are left
    best, best2 = old.copy(), own.copy()
    seen = []
    for g in range(groups):
        r, members = np.flatnonzero(scan[:, g]), np.flatnonzero(home == g)
        if not (len(r) and len(members)):
            continue
        d2 = squared_distances(y[r], book[members])
        at = d2.argmin(axis=1)
        found, found2 = members[at], d2[np.arange(len(r)), at]
        better = (found2 < best2[r]) | ((found2 == best2[r]) & (found < best[r]))
        best[r[better]], best2[r[better]] = found[better], found2[better]
        seen.append((g, r, members, d2))
    for g, r, members, d2 in seen:
        low[r, g] = others(d2, best[r], members)
    left = np.flatnonzero((best != old) & ~scan[np.arange(len(rows)), home[old]])
    low[left, home[old[left]]] = np.minimum(low[left, home[old[left]]], root_down(own[left]))
    code, lower = code.copy(), lower.copy()
    code[rows], upper[rows], lower[rows] = best, root_up(best2), low
    return code, upper, lower, int(scan.sum())


def _assign(table: DataFrame, books: list[np.ndarray], homes: list[np.ndarray], groups: int, drifts: list[np.ndarray] | None, final: bool) -> DataFrame:
    """One pass: codes and bounds of every row; the last pass gives the squared error instead of bounds."""
    parts, wide = len(books), books[0].shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            step = max(1, PIECE // (parts * wide))
            for begin in range(0, whole.num_rows, step):
                b = whole.slice(begin, step)
                x = matrix(b.column("v"), parts * wide)
                codes = np.empty((len(x), parts), np.int64)
                upper, lower, error = codes.copy(), np.empty((len(x), parts, groups), np.int64), np.zeros(len(x), np.int64)
                if drifts is not None:
                    was, up, low = matrix(b.column("codes"), parts), matrix(b.column("upper"), parts), matrix(b.column("lower"), parts * groups).reshape(lower.shape)
                for p in range(parts):
                    part = x[:, p * wide : (p + 1) * wide]
                    if drifts is None:
                        codes[:, p], upper[:, p], lower[:, p], _ = first_assignment(part, books[p], homes[p], groups)
                    else:
                        codes[:, p], upper[:, p], lower[:, p], _ = next_assignment(part, books[p], homes[p], was[:, p], up[:, p], low[:, p], drifts[p])
                    if final:
                        off = part - books[p][codes[:, p]]
                        error += np.einsum("ij,ij->i", off, off)
                kept = [b.column("vec_id"), b.column("label")]
                if final:
                    text = pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([*kept, text, pa.array(error)], ["vec_id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, b.column("v"), listed(codes), listed(upper), listed(lower.reshape(len(x), -1))], ["vec_id", "label", "v", "codes", "upper", "lower"])

    ids = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    rest = "code string, error bigint" if final else "v array<bigint>, codes array<bigint>, upper array<bigint>, lower array<bigint>"
    return table.mapInArrow(run, f"{ids}, {rest}")


def _part_sums(table: DataFrame, parts: int, wide: int, entries: int) -> DataFrame:
    """Each task's count and component sums of the parts that have one code: (key = part * entries + code, n, sums)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, wide), np.int64)
        for b in batches:
            x, codes = matrix(b.column("v"), parts * wide), matrix(b.column("codes"), parts)
            for p in range(parts):
                for c in np.unique(codes[:, p]):
                    mine = codes[:, p] == c
                    n[p * entries + c] += mine.sum()
                    sums[p * entries + c] += x[mine, p * wide : (p + 1) * wide].sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(n[used]), listed(sums[used])], ["key", "n", "sums"])

    return table.select("v", "codes").mapInArrow(run, "key bigint, n bigint, sums array<bigint>")


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry moved, rounded up."""
    out = []
    for a, b in zip(old.tolist(), new.tolist(), strict=True):
        d2 = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        r = math.isqrt(d2)
        out.append(r + (r * r < d2))
    return np.array(out, np.int64)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4, scale: int = 4096) -> DataFrame:
    """vectors (vec_id, embedding, label) to (vec_id, label, code, error, label_error, codebooks_sha256)."""
    rows, books = train(vectors, parts, entries, rounds, groups, scale)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    by_label = store(rows.groupBy(F.col("label").alias("own_label")).agg(long_sum("error").alias("label_error")), "codes-labels")
    out = rows.join(sized(by_label), rows["label"].eqNullSafe(F.col("own_label")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """Stored rows (vec_id, label, code, error) and the codebooks, one array of entries for each part."""
    size = F.size("embedding")
    cut = whole_vectors(vectors.where((size > 0) & (size % parts == 0)), scale, size, "vec_id", "label")
    first = cut.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return cut.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    width = len(first[0]["v"])
    cut = cut.where(F.size("v") == width)
    seeds = np.array(first_vectors(cut, F.lit(0), entries), np.int64).reshape(-1, parts, width // parts)
    if not len(seeds):  # no row has an id: the first vector is the one entry
        seeds = np.array([first[0]["v"]], np.int64).reshape(1, parts, width // parts)
    books = [seeds[:, p].copy() for p in range(parts)]
    k = len(seeds)
    homes = [entry_groups(b, groups) for b in books]
    table, drifts = cut, None
    for _ in range(rounds):
        was, table = table, store(_assign(table, books, homes, groups, drifts, False), "codes-round")
        release(was)
        found = summed(_part_sums(table, parts, width // parts, k))
        new = [np.array([mean_down(found[p * k + c][1], found[p * k + c][0]) if p * k + c in found else b[c].tolist() for c in range(k)], np.int64) for p, b in enumerate(books)]
        drifts, books = [_drift(a, b) for a, b in zip(books, new, strict=True)], new
    out = store(_assign(table, books, homes, groups, drifts, True), "codes")
    release(table)
    return out, books


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same by looking at every entry each round, rounds written out."""
    ctes = [f"""
k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT any_value(len(v)) // {parts} AS d FROM k),
p AS MATERIALIZED (SELECT vec_id, p, v[p * d + 1 : p * d + d] AS x FROM k, w, range({parts}) AS r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))"""]
    near = lambda i: f"""
a{i} AS MATERIALIZED (SELECT vec_id, p.p, arg_min(e, (list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), e)) AS e, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))) AS d2
  FROM p JOIN c{i} AS c ON c.p = p.p GROUP BY vec_id, p.p)"""  # noqa: E731
    for i in range(rounds):
        ctes.append(near(i))
        ctes.append(f"""
m{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (SELECT a.p, a.e, i, sum(x[i]) AS s, count(*) AS n FROM a{i} AS a JOIN p ON p.vec_id = a.vec_id AND p.p = a.p, w, range(1, 1025) AS r(i) WHERE i <= d GROUP BY ALL) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m ON m.p = o.p AND m.e = o.e)""")
    ctes.append(near(rounds))
    return f"""
WITH {",".join(ctes)},
f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d2)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN f ON f.vec_id = k.vec_id, h
"""


ORACLE = oracle()
