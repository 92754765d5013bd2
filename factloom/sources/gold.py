"""Gold set: JSON source and its validation as data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "documents array<struct<id:string,pages:int>>, "
    "claims array<struct<id:string,document:string,physical_page:int,subject:string,predicate:string,numeric_value:string,scale:string,period_label:string,scope:string,evidence_kind:string>>, "
    "pairs array<struct<id:string,claim_a:string,claim_b:string,expected_label:string>>"
)


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, claims, pairs) of a gold-set file; a file that does not fit the schema raises on use."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    return rows("documents"), rows("claims"), rows("pairs")


def gold_problems(documents: DataFrame, claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """(problem, id) rows; none if the gold set is sound."""
    twice = lambda df, name: df.groupBy("id").count().where("count > 1").select(F.lit(name).alias("problem"), "id")
    d = documents.select(F.col("id").alias("document"), "pages").dropDuplicates(["document"])
    j = claims.join(d, "document", "left")
    unknown = j.where("pages is null").select(F.lit("unknown document").alias("problem"), "id")
    past = j.where("physical_page >= pages").select(F.lit("page past the end").alias("problem"), "id")
    known = claims.select(F.col("id").alias("member")).distinct()
    members = pairs.select("id", F.explode(F.array("claim_a", "claim_b")).alias("member")).join(known, "member", "left_anti")
    stray = members.select(F.lit("unknown claim").alias("problem"), "id").distinct()
    own = pairs.where("claim_a = claim_b").select(F.lit("compares a claim with itself").alias("problem"), "id")
    out = twice(claims, "duplicate claim")
    for x in (unknown, past, twice(pairs, "duplicate pair"), stray, own):
        out = out.unionByName(x)
    return out
