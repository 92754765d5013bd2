"""Queries over durable jobs, incremental state and spending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import pandas as pd

from factloom.operators import durable, spending
from factloom.operators.state import RETRIES, RETRY_CAP, RETRY_DELAY, STALL_SECONDS
from factloom.plans.fixture import table, with_tables

#: The test events stand hours apart; here they follow each other within minutes.
FASTER, START_US = 128, 1_704_067_200_000_000


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as documents, their events as what happens to jobs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "error", "fail")
    kind = F.coalesce(kind, F.when((F.col("event_type") == "purchase") | (F.col("value") > 40), "advance").otherwise("beat"))
    return e.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("document_id"), "event_id", F.expr(f"(unix_micros(cast(ts as timestamp)) - {START_US}) div {FASTER}").alias("at_us"), kind.alias("kind"))


def t01_durable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of all jobs until an hour after the last event."""
    e = job_events(spark, sf_dir)
    last = e.agg(F.max("at_us")).first()[0] or 0
    return durable.replay(e, last + 3600 * durable.SECOND)


_S = durable.SECOND
_ROW = lambda when, at, state, reason="NULL", job="job", attempt="attempt", stage="stage": f"CASE WHEN {when} THEN {{'job': {job}, 'at_us': {at}, 'state': {state}, 'attempt': {attempt}, 'stage': {stage}, 'reason': {reason}}} END"
_DELAY = lambda n: f"least({RETRY_CAP}, {RETRY_DELAY} * (1 << greatest({n} - 1, 0))) * {_S}"

#: One event of every document a step; what falls due before it comes first.
T01 = f"""
WITH RECURSIVE b AS (SELECT 'd' || user_id AS document_id, event_id, (epoch_us(ts) - {START_US}) // {FASTER} AS moment,
  CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'error' THEN 'fail' ELSE CASE WHEN event_type = 'purchase' OR value > 40 THEN 'advance' ELSE 'beat' END END AS kind FROM events),
x AS (SELECT * FROM b UNION ALL SELECT DISTINCT document_id, 9223372036854775807, (SELECT max(moment) FROM b) + {3600 * _S}, 'end' FROM b),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY moment, event_id) AS n FROM x),
r AS (
SELECT document_id, 0::BIGINT AS n, 0::BIGINT AS job, 'none' AS status, 0 AS attempt, NULL::VARCHAR AS stage, 0::BIGINT AS started, 0::BIGINT AS last, false AS stalled, 0::BIGINT AS due,
  NULL::STRUCT(job BIGINT, at_us BIGINT, state VARCHAR, attempt INTEGER, stage VARCHAR, reason VARCHAR)[] AS made FROM e WHERE e.n = 1
UNION ALL
SELECT document_id, n, CASE WHEN opens THEN job + 1 ELSE job END, CASE WHEN opens THEN 'queued' WHEN begins THEN 'running' WHEN lost AND attempt > {RETRIES} THEN 'ended' WHEN lost THEN 'waiting' WHEN moved = 'completed' THEN 'ended' ELSE status END,
  CASE WHEN opens THEN 0 WHEN begins THEN attempt + 1 ELSE attempt END, CASE WHEN opens OR lost THEN NULL WHEN begins THEN 'parsing' ELSE coalesce(moved, stage) END,
  CASE WHEN begins THEN moment ELSE started END, CASE WHEN begins OR alive THEN moment ELSE last END, stalled AND NOT (opens OR begins OR lost OR alive), CASE WHEN lost THEN moment + {_DELAY("attempt")} ELSE due END,
  list_filter(fell || [{_ROW("refused", "moment", "'refused'")}, {_ROW("opens AND status = 'running'", "moment", "'superseded'")}, {_ROW("opens", "moment", "'queued'", job="job + 1", attempt="0", stage="NULL")},
    {_ROW("begins", "moment", "'parsing'", attempt="attempt + 1", stage="'parsing'")}, {_ROW("lost", "moment", f"CASE WHEN attempt > {RETRIES} THEN 'failed' ELSE 'waiting' END", "'failed'", stage="NULL")},
    {_ROW("alive AND stalled", "moment", "'resumed'")}, {_ROW("moved IS NOT NULL", "moment", "moved", stage="moved")}], lambda v: v IS NOT NULL)
FROM (
SELECT *, kind = 'enqueue' AND (status IN ('none', 'ended') OR (status = 'running' AND stalled)) AS opens, kind = 'enqueue' AND NOT (status IN ('none', 'ended') OR (status = 'running' AND stalled)) AS refused,
  kind = 'start' AND status = 'queued' AS begins, kind = 'fail' AND status = 'running' AS lost, kind IN ('beat', 'advance') AND status = 'running' AS alive,
  CASE WHEN kind = 'advance' AND status = 'running' THEN CASE stage WHEN 'parsing' THEN 'extracting' WHEN 'extracting' THEN 'normalizing' WHEN 'normalizing' THEN 'comparing' ELSE 'completed' END END AS moved
FROM (
SELECT document_id, n, job, CASE WHEN status = 'waiting' AND due <= moment THEN 'queued' ELSE status END AS status, attempt, stage, started, last, stalled, due, moment, kind,
  fell || [{_ROW("status = 'waiting' AND due <= moment", "due", "'ready'")}] AS fell
FROM (
SELECT document_id, n, job, CASE WHEN expires AND attempt > {RETRIES} THEN 'ended' WHEN expires THEN 'waiting' ELSE status END AS status, attempt, CASE WHEN expires THEN NULL ELSE stage END AS stage, started, last,
  (stalled OR silent) AND NOT expires AS stalled, CASE WHEN expires THEN started + {3600 * _S} + {_DELAY("attempt")} ELSE due END AS due, moment, kind,
  [{_ROW("silent", f"last + {STALL_SECONDS * _S}", "'stalled'")}, {_ROW("expires", f"started + {3600 * _S}", f"CASE WHEN attempt > {RETRIES} THEN 'failed' ELSE 'waiting' END", "'expired'", stage="NULL")}] AS fell
FROM (
SELECT r.* EXCLUDE (n, made), e.n, e.moment, e.kind, status = 'running' AND started + {3600 * _S} < moment AS expires, status = 'running' AND NOT stalled AND last + {STALL_SECONDS * _S} < least(moment, started + {3600 * _S}) AS silent
FROM r JOIN e ON e.document_id = r.document_id AND e.n = r.n + 1)))))
SELECT document_id, m.job AS job, m.at_us AS at_us, m.state AS state, m.attempt AS attempt, m.stage AS stage, m.reason AS reason FROM (SELECT document_id, unnest(made) AS m FROM r)
"""

class ByLength:
    """A stand-in for a model: what a call costs follows from its prompt."""

    model_name = "by-length"

    def classify(self, prompts: pd.Series) -> pd.DataFrame:
        n = prompts.str.len()
        return pd.DataFrame({"label": "insufficient_context", "rationale": "", "prompt_tokens": n, "completion_tokens": n % 7})


def o07_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pairs that a budget of 20 tokens a pair reaches; estimates are double the cost."""
    r = table(spark, sf_dir, "relationships")
    p = r.select("claim_a_id", "claim_b_id", F.concat_ws(" ", "label", "claim_a_id", "claim_b_id").alias("prompt"), (F.length("label") - F.when(F.col("method") == "model", 5).otherwise(0)).alias("promise"))
    p = p.withColumn("estimate", 2 * (F.length("prompt") + F.length("prompt") % 7))
    return spending.spend(p, ByLength(), 20 * p.count()).select("claim_a_id", "claim_b_id", "prompt_tokens", "completion_tokens")


O07 = f"""
{with_tables("relationships")}, p AS (SELECT claim_a_id, claim_b_id, len(label || ' ' || claim_a_id || ' ' || claim_b_id) AS n, len(label) - CASE WHEN method = 'model' THEN 5 ELSE 0 END AS promise FROM relationships)
SELECT claim_a_id, claim_b_id, n::INT AS prompt_tokens, (n % 7)::INT AS completion_tokens FROM p
QUALIFY coalesce(sum(n + n % 7) OVER (ORDER BY promise DESC, claim_a_id, claim_b_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20 * (SELECT count(*) FROM p)
"""

_ALL = {t01_durable_jobs: T01, o07_spending: O07}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL.items() if sql}
