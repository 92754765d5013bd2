"""Pruned nearest neighbours against brute force, and their lists kept up batch by batch."""

from __future__ import annotations

import random

import numpy as np
import pytest

from factloom.operators import neighbours
from factloom.streaming import jobs


def brute(rows, against, k):
    out = {}
    for i, coll, doc, model, v in rows:
        near = []
        for j, c2, d2, m2, w in against:
            if (c2, m2) == (coll, model) and d2 != doc:
                a, b = np.asarray(v, np.float64), np.asarray(w, np.float64)
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                near.append((round(1 - float(a @ b / norm), 9) if norm else 1.0, j))
        out[i] = [j for _, j in sorted(near)[:k]]
    return out


def lists(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["left_id"], []).append(r["right_id"])
    return out


@pytest.fixture(scope="module")
def clustered():
    """Tight clusters, one of them a third of all rows, exact copies, a zero vector, two collections and two models."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 16))
    rows = []
    for i in range(600):
        c = 0 if i % 3 == 0 else i % 12
        v = (centres[c] + rng.normal(0, 0.03, 16)).astype(np.float32).tolist()
        rows.append((f"c{i:03}", f"k{int(i % 10 == 0)}", f"d{i % 23}", "wide" if i % 50 == 7 else "m", v[:8] if i % 50 == 7 else v))
    copy = rows[5][4]
    rows += [(f"x{i:02}", "k0", f"e{i % 5}", "m", copy) for i in range(40)] + [("zero", "k0", "z", "m", [0.0] * 16)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, jobs.VECTORS)


def test_search_is_exact_and_skips_blocks(spark, clustered):
    v = frame(spark, clustered + [("none", "k0", "d", "m", None), ("nan", "k0", "d", "m", [float("nan")] * 16)])
    found, pairs = neighbours.search(v, v, 5, block_rows=32)
    assert lists(found) == {i: n for i, n in brute(clustered, clustered, 5).items() if n}
    met = [r["met"] for r in pairs.collect()]
    assert len(met) > 200 and sum(met) < 0.6 * len(met)


def test_search_without_structure_is_exact_too(spark):
    rng = random.Random(4)
    rows = [(f"c{i}", "k", f"d{i % 7}", "m", [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    one = [r for r in rows if r[0].startswith("c1")]
    found, _ = neighbours.search(frame(spark, one), frame(spark, rows), 4, block_rows=16)
    assert lists(found) == brute(one, rows, 4)
    assert neighbours.search(frame(spark, []), frame(spark, rows), 4)[0].count() == 0 == neighbours.search(frame(spark, rows), frame(spark, []), 4)[0].count()


def test_lists_do_not_depend_on_the_order_of_batches(spark, clustered, tmp_path):
    rows = [r for r in clustered if r[1] == "k0" and r[3] == "m"][:150] + [r for r in clustered if r[1] == "k1"][:20]
    random.Random(1).shuffle(rows)
    args = [str(tmp_path / n) for n in ("vectors", "nearest", "found")]
    batches = [rows[:90], rows[90:]]
    for b in (*batches, batches[0]):  # the last one is a replay
        jobs.add_vectors(spark, frame(spark, b), *args, k=4, block_rows=32)
    assert lists(spark.read.parquet(args[1])) == {i: n for i, n in brute(rows, rows, 4).items() if n}
    # A pair is found from the side of the claim that came later.
    want, seen = set(), []
    for b in batches:
        seen = seen + b
        want |= {tuple(sorted((i, j))) for i, near in brute(b, seen, 4).items() for j in near}
    pairs = [(r["claim_a_id"], r["claim_b_id"]) for r in spark.read.parquet(args[2]).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) >= want


def test_vectors_stream(spark, clustered, tmp_path):
    rows = [r for r in clustered if r[1] == "k1"]
    args = [str(tmp_path / n) for n in ("in", "vectors", "nearest", "found", "checkpoint")]
    for part in (rows[:25], rows[25:]):
        frame(spark, part).write.mode("append").parquet(args[0])
        jobs.watch_vectors(spark, *args, k=3).awaitTermination()
    assert lists(spark.read.parquet(args[2])) == {i: n for i, n in brute(rows, rows, 3).items() if n}


def test_the_nearest_of_two_blocks_are_sorted_alone():
    """Ties at the k-th place go to the least ids, as if all were sorted; rows of one document are no neighbours."""
    import numpy as np
    import pandas as pd

    from factloom.operators.neighbours import _nearest

    rng = np.random.default_rng(3)
    side = lambda n, name: pd.DataFrame({"id": [f"{name}{i:03}" for i in rng.permutation(n)], "document_id": [f"d{i}" for i in rng.integers(0, 4, n)], "unit": list(rng.integers(-1, 2, (n, 3)).astype(float))})
    for n, m, k in ((30, 200, 15), (5, 15, 15), (5, 9, 15), (40, 60, 1)):
        a, b = side(n, "a"), side(m, "b")
        got = _nearest(k)(("col",), a, b)
        want = []
        for x in a.itertuples():
            near = sorted((round(1 - float(np.dot(x.unit, y.unit)), 12), y.id) for y in b.itertuples() if y.document_id != x.document_id)
            want += [(x.id, i, d) for d, i in near[:k]]
        assert sorted(zip(got["left_id"], got["right_id"], got["distance"], strict=True)) == sorted(want)
