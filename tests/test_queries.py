"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
import re

import duckdb
import pytest

from factloom.plans import queries
from factloom.plans.fixture import BASE, table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(spark, duck, frame, sql):
    df = frame(spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.sql(sql)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    same(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


def test_ingest_tells_files_with_one_beginning_apart(spark, tmp_path):
    texts = [(1, "the same beginning, one end"), (2, "the same beginning, another end"), (3, "the same beginning, one end"), (4, "the same beginning, stored"), (5, "the same beginning, stored")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r["path"]): r["outcome"] for r in queries.QUERIES["s02_ingest"](spark, str(tmp_path)).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "duplicate", 4: "duplicate", 5: "duplicate"}


def test_exact_candidates_pair_generic_subjects(spark):
    claims = table(spark, SF, "claims")
    generic = claims.where("suppkey % 7 = 0 and status in ('accepted', 'needs_review') and predicate = 'ebitda'").select("id", "collection_id", "document_id").collect()
    want = {(min(a["id"], b["id"]), max(a["id"], b["id"])) for a in generic for b in generic if a["collection_id"] == b["collection_id"] and a["document_id"] != b["document_id"]}
    got = {(r["claim_a_id"], r["claim_b_id"]) for r in queries.QUERIES["j07_exact_candidates"](spark, SF).collect()}
    assert want and want <= got


@pytest.mark.parametrize("name", ["f2_06_differences", "f7_01_checks", "f7_05_routes", "r04_verdicts"])
def test_pairs_of_claims_move_lines_once_by_order(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)]
    by_line = [m for m in moved if m & {"l_orderkey", "orderkey"}]
    assert by_line and all(m == {"l_orderkey"} for m in by_line)  # not by line number, nor once more as claims
