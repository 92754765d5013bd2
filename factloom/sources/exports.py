"""JSON and Markdown exports of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.reads import LABEL_RANK


def sample_claims(claims: DataFrame, n: int = 40) -> DataFrame:
    """The first claims by status and figure (largest first, none before all)."""
    return claims.orderBy("status", F.col("numeric_value").cast("decimal(38,10)").desc_nulls_first(), "id").limit(n)


def sample_relationships(relationships: DataFrame, n: int = 30) -> DataFrame:
    """The first relationships: model verdicts first, then by label."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LABEL_RANK]), F.col("label"))
    return relationships.orderBy((F.col("method") == "model").desc(), rank, "id").limit(n)


def method_counts(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("method").agg(F.count("*").alias("n"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


#: A Markdown table of more rows than this is refused: reports are made of aggregates.
MOST_ROWS = 1000


def markdown_table(df: DataFrame, title: str) -> str:
    """A small result (an aggregate) as a Markdown table, whole; larger results are an error."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{title}: more than {MOST_ROWS} rows do not make a report")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return f"## {title}\n\n{head}" + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)


def markdown_report(title: str, parts: dict[str, DataFrame]) -> str:
    """A report: a table for each named aggregate, in the order given."""
    return f"# {title}\n\n" + "\n".join(markdown_table(df, name) for name, df in parts.items())


def export_document(claims: DataFrame, relationships: DataFrame, registry: DataFrame) -> DataFrame:
    """One row a part (part, value as JSON): the samples, the vocabulary and the counts by method, to be written as one folder."""
    as_json = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("value"))
    parts = [as_json(sample_claims(claims), "claims"), as_json(sample_relationships(relationships), "relationships"), as_json(registry, "predicates"), as_json(method_counts(relationships), "methods")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
