"""Code compression and ball clustering against plain loops over whole numbers, on awkward rows and real ones."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from factloom.llm import ball_clusters, vector_codes
from factloom.llm.vectors import root_down, root_up

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, codes int, cluster int, own_label int, ids string"


def whole(v, scale, width=None):
    if v is None or not v or (width and len(v) != width) or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(points, centres, rounds):
    """Exact Lloyd: centres after the rounds and the last assignment (index, squared distance)."""
    near = lambda p: min((square(p, c), i) for i, c in enumerate(centres))[::-1]
    for _ in range(rounds):
        mine = {}
        for p in points:
            mine.setdefault(near(p)[0], []).append(p)
        centres = [[sum(col) // len(mine[i]) for col in zip(*mine[i], strict=True)] if i in mine else c for i, c in enumerate(centres)]
    return centres, [near(p) for p in points]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, whole(v, scale), label) for i, v, label in rows]
    kept = [r for r in kept if r[1]]
    width = len(kept[0][1]) // parts
    own = sorted((i, v) for i, v, _ in kept if i is not None)
    seeds = [v for k, (i, v) in enumerate(own) if k == 0 or own[k - 1][0] != i][:entries]
    books, codes, errors = [], [""] * len(kept), [0] * len(kept)
    for p in range(parts):
        cut = lambda v: v[p * width : (p + 1) * width]  # noqa: B023, E731
        book, near = lloyd([cut(v) for _, v, _ in kept], [cut(v) for v in seeds], rounds)
        books += book
        for k, (e, d2) in enumerate(near):
            codes[k] += f"{e:02x}"
            errors[k] += d2
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b).encode()).hexdigest()
    total = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=repr)


def codes_of(df, **options):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(df, **options).collect()), key=repr)


def plain_clusters(rows, k=8, rounds=10, width=64, scale=1024):
    kept = [(i, whole(v, scale, width)) for i, v, _ in rows]
    kept = [r for r in kept if r[1]]
    order = sorted({i for i, _ in kept if i is not None}, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]
    centres, near = lloyd([v for _, v in kept], [min(v for j, v in kept if j == i) for i in order], rounds)
    own = {}
    for c, d2 in near:
        own[c] = own.get(c, 0) + d2
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d2, own[c], sum(own.values()), sha[c]) for (i, _), (c, d2) in zip(kept, near, strict=True)), key=repr)


def clusters_of(df, **options):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in ball_clusters.ball_clusters(df, **options).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", -1, -2, -3, "clash") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward():
    """Copies in a large group, ties on a coarse grid, repeated ids, null ids and labels, and vectors to be left out."""
    rng = random.Random(11)
    grid = lambda: [rng.choice((-2, -1, 0, 1, 2)) / 64 for _ in range(64)]
    hot = grid()
    rows = [(i, grid(), i % 4) for i in range(150)] + [(1000 + i, hot, None) for i in range(90)] + [(5, grid(), 1), (5, hot, 2), (None, grid(), None), (None, grid(), 3)]
    bad = [None, [], [0.5] * 63, [None] + [0.1] * 63, [float("nan")] + [0.1] * 63, [0.1] * 63 + [float("inf")], [0.1] * 63 + [float("-inf")]]
    return rows, [(-i - 1, v, 0) for i, v in enumerate(bad)]


def test_vector_codes_are_those_of_plain_lloyd(spark, awkward):
    rows, bad = awkward
    assert codes_of(frame(spark, rows + bad)) == plain_codes(rows)
    for entries, groups, rounds in ((16, 1, 3), (5, 9, 2), (300, 6, 1)):
        assert codes_of(frame(spark, rows), entries=entries, groups=groups, rounds=rounds) == plain_codes(rows, entries=entries, rounds=rounds)


def test_vector_codes_on_real_rows_and_without_rows(spark):
    real = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert codes_of(real) == plain_codes([tuple(r) for r in real.collect()])
    none = frame(spark, [(1, None, 0)])
    assert vector_codes.vector_codes(none).columns == vector_codes.vector_codes(real).columns
    assert codes_of(none) == codes_of(frame(spark, [])) == [] == clusters_of(none) == clusters_of(frame(spark, []))


def test_bounds_spare_most_scans_and_never_err():
    rng = np.random.default_rng(3)
    x = rng.integers(-400, 400, (3000, 8)) // 100 * 100  # a coarse grid: many exact ties
    book = x[:16].copy()
    home = vector_codes.entry_groups(book, 4)
    code, up, low, _ = vector_codes.first_assignment(x, book, home, 4)
    scanned = []
    for _ in range(8):
        new = np.array([x[code == c].sum(axis=0) // max(1, (code == c).sum()) if (code == c).any() else book[c] for c in range(16)])
        drift = vector_codes._drift(book, new)
        book = new
        code, up, low, n = vector_codes.next_assignment(x, book, home, code, up, low, drift)
        d2 = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        scanned.append(n / (4 * len(x)))
        assert (code == d2.argmin(axis=1)).all() and (up**2 >= d2[np.arange(len(x)), code]).all()
        for g in range(4):
            rest = np.where((home == g)[None] & (np.arange(16)[None] != code[:, None]), d2, np.iinfo(np.int64).max).min(axis=1)
            assert (np.maximum(low[:, g], 0) ** 2 <= rest).all()
    assert scanned[-1] < 0.5


def test_roots_are_rounded_to_the_safe_side():
    s = np.array([0, 1, 2, 3, 4, 2**52 + 1, (2**31 - 1) ** 2 - 1, (2**31 - 1) ** 2, 3037000499**2, 2**63 - 1], np.int64)
    assert root_down(s[:8]).tolist() == [math.isqrt(v) for v in s[:8].tolist()]
    assert root_up(s[:8]).tolist() == [math.isqrt(v) + (math.isqrt(v) ** 2 < v) for v in s[:8].tolist()]


def test_ball_clusters_are_those_of_plain_lloyd(spark, awkward):
    rows, bad = awkward
    assert clusters_of(frame(spark, rows + bad), tree_rows=70) == plain_clusters(rows)
    assert clusters_of(frame(spark, rows[:3]), rounds=2) == plain_clusters(rows[:3], rounds=2)


def test_ball_clusters_on_real_rows(spark):
    real = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert clusters_of(real) == plain_clusters([tuple(r) for r in real.collect()])


def test_trees_cover_their_rows_and_assign_whole_balls():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 8, (300, 6)) for c in (-900, 0, 900)] + [np.full((200, 6), 40)]).astype(np.int64)
    order, tree = ball_clusters.build_tree(x, 8)
    y = x[order]
    assert sorted(order.tolist()) == list(range(len(x)))
    for a, b, r, c, s in zip(tree["start"], tree["end"], tree["radius"], tree["centre"], tree["total"], strict=True):
        assert (((y[a:b] - c) ** 2).sum(axis=1) <= r * r).all() and (y[a:b].sum(axis=0) == s).all()
    centroids = np.array([[-800] * 6, [10] * 6, [900] * 6])
    balls, leaves = [], []
    found = ball_clusters.tree_clusters(y, tree, centroids, lambda node, c: (leaves if c is None else balls).append(node))
    assert (found == ((y[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert not leaves and len(balls) < 12 and sum(tree["end"][n] - tree["start"][n] for n in balls) == len(x)
