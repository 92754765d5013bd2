"""Centroid clustering in which whole balls of vectors are assigned at once.

Each task packs its rows, some hundred at a time, into metric trees and stores them: a node is a ball with its
centre, radius, count and sum, and covers a stretch of the tree's rows. A round sends the centroids (a
few rows) to the tasks. If a ball's farthest point from one centroid is nearer than its nearest point to any
other, by the triangle inequality with radii and roots rounded to the safe side, its count and sum go to that
centroid as they are; else its two halves are tried, and at the leaves exact squared distances decide, ties
for the smaller number. Tasks return one sum a centroid, so nothing is shuffled by cluster and a hot cluster
or vector costs no more than another. Trees are written once; rounds only read them.

Results in special cases: rows are left out if the vector is null, has another width, holds a null, NaN or infinite
component, or one so large that squared distances would not fit a long. Rows without vec_id are clustered but start no
centroid. Repeated rows each get their row; of rows that repeat a vec_id, one starts a centroid. Fewer different ids than
clusters make fewer clusters. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import release, store
from factloom.llm.vectors import first_vectors, listed, long_sum, matrix, mean_down, root_down, root_up, squared_distances, summed, whole_vectors

#: Rows of one tree, and rows below which a ball is not halved.
TREE_ROWS, LEAF_ROWS = 1024, 16


def build_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the rows, and nodes that cover stretches of it; `second` is the second child (the first follows its parent), 0 at leaves."""
    order = np.arange(len(x))
    start, end, second, radius, centre, total = [], [], [], [], [], []
    open_ = [(0, len(x), -1)]
    while open_:
        a, b, parent = open_.pop()
        me = len(start)
        if parent >= 0:
            second[parent] = me
        y = x[order[a:b]]
        s = y.sum(axis=0)
        c = s // (b - a)
        d2 = squared_distances(y, c[None])[:, 0]
        start.append(a), end.append(b), second.append(0), total.append(s), centre.append(c), radius.append(int(root_up(d2.max()[None])[0]))
        if b - a <= leaf_rows:
            continue
        p = y[d2.argmax()]
        to_p = squared_distances(y, p[None])[:, 0]
        if not to_p.any():
            continue  # equal vectors
        right = to_p > squared_distances(y, y[to_p.argmax()][None])[:, 0]
        half = order[a:b]
        cut = a + int((~right).sum())
        order[a:b] = np.concatenate([half[~right], half[right]])
        open_ += [(cut, b, me), (a, cut, -1)]  # the first half is next
    as_array = lambda v: np.array(v, np.int64)
    return order, {"start": as_array(start), "end": as_array(end), "second": as_array(second), "radius": as_array(radius), "centre": np.stack(centre), "total": np.stack(total)}


def tree_clusters(x: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray, whole) -> np.ndarray:
    """Cluster of each row of a tree (in the tree's order); `whole(node, cluster)` hears of balls assigned at once."""
    out = np.empty(len(x), np.int64)
    level = np.zeros(1, np.int64)
    leaves = []
    while len(level):
        d2 = squared_distances(tree["centre"][level], centroids)
        best = d2.argmin(axis=1)
        at = np.arange(len(level))
        near = root_up(d2[at, best])
        rest = root_down(d2)
        rest[at, best] = np.iinfo(np.int64).max
        r = tree["radius"][level]
        sure = rest.min(axis=1) - r > near + r
        for node, cluster in zip(level[sure].tolist(), best[sure].tolist(), strict=True):
            out[tree["start"][node] : tree["end"][node]] = cluster
            whole(node, cluster)
        open_ = level[~sure]
        inner = open_[tree["second"][open_] > 0]
        leaves += open_[tree["second"][open_] == 0].tolist()
        level = np.concatenate([inner + 1, tree["second"][inner]])
    for node in leaves:
        rows = slice(tree["start"][node], tree["end"][node])
        out[rows] = squared_distances(x[rows], centroids).argmin(axis=1)  # the first of equals
        whole(node, None)
    return out


_NODE = ("start", "end", "second", "radius")


def _trees(vectors: DataFrame, width: int, tree_rows: int) -> DataFrame:
    """Rows to trees: ids and vectors in the tree's order, and its nodes; one row a tree."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for begin in range(0, whole.num_rows, tree_rows):
                b = whole.slice(begin, tree_rows)
                x = matrix(b.column("v"), width)
                order, tree = build_tree(x)
                ids = b.column("vec_id").take(pa.array(order))
                columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), listed(x[order].reshape(1, -1))]
                columns += [listed(tree[n].reshape(1, -1)) for n in (*_NODE, "centre", "total")]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "points", *_NODE, "centre", "total"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"ids array<{kind}>, points array<bigint>, " + ", ".join(f"{n} array<bigint>" for n in (*_NODE, "centre", "total")))


def _opened(batch, width: int) -> Iterator[tuple]:
    """Ids, vectors and nodes of each tree of a batch."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        flat = lambda n: np.asarray(row.column(n).flatten())  # noqa: B023, E731
        tree = {n: flat(n) for n in _NODE} | {n: flat(n).reshape(-1, width) for n in ("centre", "total")}
        yield row.column("ids").flatten(), flat("points").reshape(-1, width), tree


def _cluster_sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each task's count and component sums of every centroid's vectors: (key = cluster, n, sums)."""
    k, width = centroids.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, x, tree in _opened(batch, width):
                exact: list[int] = []

                def whole(node: int, cluster: int | None) -> None:
                    if cluster is None:
                        exact.append(node)  # noqa: B023
                    else:
                        n[cluster] += tree["end"][node] - tree["start"][node]  # noqa: B023
                        sums[cluster] += tree["total"][node]  # noqa: B023

                found = tree_clusters(x, tree, centroids, whole)
                if exact:
                    rows = np.concatenate([np.arange(tree["start"][e], tree["end"][e]) for e in exact])
                    for c in np.unique(found[rows]):
                        mine = rows[found[rows] == c]
                        n[c] += len(mine)
                        sums[c] += x[mine].sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(n[used]), listed(sums[used])], ["key", "n", "sums"])

    return trees.mapInArrow(run, "key bigint, n bigint, sums array<bigint>")


def _assigned(trees: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """Rows (vec_id, cluster, distance) of all trees."""
    width = centroids.shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ids, x, tree in _opened(batch, width):
                found = tree_clusters(x, tree, centroids, lambda *_: None)
                off = x - centroids[found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(np.einsum("ij,ij->i", off, off))], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def ball_clusters(vectors: DataFrame, clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """vectors (vec_id, embedding) to (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Centroids start as the vectors whose ids have the least sha256 of `<seed>:<vec_id>`.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    cut = whole_vectors(vectors, scale, width, "vec_id")
    first = first_vectors(cut, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), clusters)
    if not first:  # no row, or none with an id
        first = [list(r["v"]) for r in cut.orderBy("v").limit(1).collect()]
    if not first:
        none = cut.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid_sha256": F.lit("")})
    centroids = np.array(first, np.int64)
    trees = store(_trees(cut, width, tree_rows), "balls")
    for _ in range(rounds):
        found = summed(_cluster_sums(trees, centroids))
        centroids = np.array([mean_down(found[c][1], found[c][0]) if c in found else centroids[c].tolist() for c in range(len(centroids))], np.int64)
    rows = store(_assigned(trees, centroids, kind), "ball-clusters")
    release(trees)
    own = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    fits = lambda s: F.lit(int(s) if s < 2**63 else None).cast("long")
    inertia = F.lit(None).cast("long")
    for c, s in own.items():
        inertia = F.when(F.col("cluster") == c, fits(s)).otherwise(inertia)
    return rows.withColumns({"cluster_inertia": inertia, "inertia": fits(sum(own.values())), "centroid_sha256": F.array(*map(F.lit, digests))[F.col("cluster")]})


def oracle(clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same by looking at every centroid for each vector, rounds written out."""
    square = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    ctes = [f"""
k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS e, v AS c FROM k QUALIFY e < {clusters})"""]
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT vec_id, arg_min(e, ({square}, e)) AS e, min({square}) AS d2 FROM k, c{i} GROUP BY vec_id)"
    for i in range(rounds):
        ctes.append(near(i))
        ctes.append(f"""
m{i} AS (SELECT e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (SELECT a.e, i, sum(v[i]) AS s, count(*) AS n FROM a{i} AS a JOIN k ON k.vec_id = a.vec_id, range(1, {width + 1}) AS r(i) GROUP BY ALL) GROUP BY e),
c{i + 1} AS MATERIALIZED (SELECT o.e, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m ON m.e = o.e)""")
    ctes.append(near(rounds))
    return f"""
WITH {",".join(ctes)}
SELECT vec_id, a.e::INT AS cluster, d2::BIGINT AS distance, sum(d2) OVER (PARTITION BY a.e)::BIGINT AS cluster_inertia, sum(d2) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON c.e = a.e
"""


ORACLE = oracle()
