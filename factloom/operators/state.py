"""Runs and issues: what a job system keeps, as aggregates over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.base import first_match

STAGES = ("queued", "parsing", "extracting", "normalizing", "comparing", "completed", "completed_with_issues", "failed")
TERMINAL = STAGES[5:]
STALL_SECONDS = 300
OPEN = ("open", "retrying")
# The processor's retry policy.
RETRIES, RETRY_DELAY, RETRY_CAP = 5, 5, 300


# When an extraction gives up, how often and long it pauses, and the longest wait between two calls.
GIVE_UP, GIVE_UP_ANY, DOCUMENT_TOKENS = 4, 12, 1_500_000
COOLDOWNS, COOLDOWN_SECONDS = 2, 45
LONGEST_WAIT_MS = 30_000


def next_stage(stage: Column) -> Column:
    """The stage after a working one; null for those that end a run."""
    steps = dict(zip(STAGES[:5], STAGES[1:6], strict=True))
    return first_match([(stage == a, b) for a, b in steps.items()])


def stage_events(events: DataFrame) -> DataFrame:
    """Stage changes (run_id, at, stage) with the stage before and whether the change is allowed.

    A run starts queued, moves on by one stage at a time, and may end from any working stage; an ended run
    starts over from any working stage, as stages can be run again.
    """
    before = F.lag("stage").over(Window.partitionBy("run_id").orderBy("at", "stage"))
    e = events.withColumn("before", before)
    ok = first_match([
        (F.col("before").isNull(), F.col("stage") == "queued"), (is_terminal(F.col("before")), ~is_terminal(F.col("stage"))), (is_terminal(F.col("stage")), F.col("before") != "queued"),
    ], next_stage(F.col("before")) == F.col("stage"))
    return e.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def give_up(attempts: DataFrame, budget: int = DOCUMENT_TOKENS, most: int = GIVE_UP, most_any: int = GIVE_UP_ANY) -> DataFrame:
    """Attempts (document_id, seq, outcome, tokens) with `stopped`: why the attempt is not made any more, else null.

    outcome: ok, malformed, or another failure. Tokens spent before are looked at first, then failures in a row
    since the last success: those that are not malformed, and all. The run stops at the first such place.
    """
    line = Window.partitionBy("document_id").orderBy("seq")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    a = attempts.withColumn("__spent", F.coalesce(F.sum("tokens").over(past), F.lit(0))).withColumn("__run", F.coalesce(F.sum((F.col("outcome") == "ok").cast("int")).over(past), F.lit(0)))
    # Failures of the run of failures that goes on when this attempt's turn comes.
    since = Window.partitionBy("document_id", "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("outcome") != "ok"
    a = a.withColumn("__any", F.coalesce(F.sum(failed.cast("int")).over(since), F.lit(0))).withColumn("__hard", F.coalesce(F.sum((failed & (F.col("outcome") != "malformed")).cast("int")).over(since), F.lit(0)))
    why = first_match([(F.col("__spent") >= budget, "token_budget_exhausted"), ((F.col("__hard") >= most) | (F.col("__any") >= most_any), "extraction_abandoned")])
    first = F.first(F.col("__why"), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return a.withColumn("__why", why).withColumn("stopped", first).drop("__spent", "__run", "__any", "__hard", "__why")


def cooldowns(throttled: DataFrame, most: int = COOLDOWNS, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Throttled calls (document_id, seq) with pause_seconds: the first ones of a document wait, later ones (null) fail."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("seq"))
    return throttled.withColumn("pause_seconds", F.when(n <= most, F.lit(seconds)))


def call_wait_ms(attempt: Column, retry_after_seconds: Column, jitter: Column) -> Column:
    """Milliseconds before a provider is called again (attempt from 0, jitter from 0 to 1): what it asks for, else half to all of a doubling ceiling."""
    ceiling = F.least(F.lit(float(LONGEST_WAIT_MS)), F.lit(1000.0) * F.pow(F.lit(2.0), attempt.cast("double")))
    return F.coalesce(retry_after_seconds.cast("double") * 1000, F.round(ceiling * (0.5 + jitter * 0.5))).cast("long")


def is_terminal(stage: Column) -> Column:
    return stage.isin(*TERMINAL)


def is_stalled(now: Column) -> Column:
    """Not ended, not waiting, and silent for more than five minutes."""
    last = F.coalesce("heartbeat_at", "started_at", "created_at")
    return ~is_terminal(F.col("stage")) & (F.col("stage") != "queued") & (F.unix_timestamp(now) - F.unix_timestamp(last) > STALL_SECONDS)


def upsert_issues(events: DataFrame) -> DataFrame:
    """Issues from their events (run_id, failure_kind, physical_page, message, seen_at): one row for each run, kind and page.

    Attempts are counted, the newest message and time are kept, and the first time as created_at; an
    issue that came again is being retried. A null page is a page of its own.
    """
    g = events.groupBy("run_id", "failure_kind", "physical_page").agg(
        F.count("*").alias("attempt_count"), F.min("seen_at").alias("created_at"), F.max("seen_at").alias("last_attempt_at"), F.max_by("message", F.struct("seen_at", "message")).alias("message")
    )
    return g.withColumn("resolution", F.when(F.col("attempt_count") > 1, "retrying").otherwise("open"))


def resolve_issues(issues: DataFrame, starts: DataFrame) -> DataFrame:
    """Open issues of a run that were not met again since its last attempt began are resolved (starts: run_id, attempt_started_at)."""
    j = issues.join(starts, "run_id", "left")
    old = F.col("resolution").isin(*OPEN) & (F.coalesce("last_attempt_at", "created_at") < F.col("attempt_started_at"))
    return j.withColumn("resolution", F.when(old, "resolved").otherwise(F.col("resolution"))).drop("attempt_started_at")


def abandon_issues(issues: DataFrame, kinds: list[str]) -> DataFrame:
    return issues.withColumn("resolution", F.when(F.col("failure_kind").isin(*kinds), "abandoned").otherwise(F.col("resolution")))


def final_stages(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Each run's last stage: failed, completed with issues (open, retrying or abandoned ones), or completed."""
    left = issues.groupBy("run_id").agg(F.count_if(F.col("resolution").isin(*OPEN, "abandoned")).alias("unresolved"))
    j = runs.join(left, "run_id", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))
    return j.withColumn("stage", first_match([(F.col("failed"), "failed"), (F.col("unresolved") > 0, "completed_with_issues")], "completed"))


def latest_progress(updates: DataFrame) -> DataFrame:
    """Progress overwrites: the last update of a run counts (run_id, at, done, total)."""
    return updates.groupBy("run_id").agg(F.max_by(F.struct("done", "total"), F.struct("at", "done")).alias("p"), F.max("at").alias("heartbeat_at")).select("run_id", "p.done", "p.total", "heartbeat_at")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each document's newest run."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("created_at").desc(), F.col("run_id").desc()))
    return runs.withColumn("__n", n).where("__n = 1").drop("__n")


def may_rerun(now: Column) -> Column:
    """Whether stages of a run may be started again."""
    return is_terminal(F.col("stage")) | is_stalled(now)


def stages_to_run(stage_names: list[str], selected: list[str] | None) -> list[str]:
    return [s for s in stage_names if selected is None or s in selected]


def job_failure_kind(message: Column, code: Column) -> Column:
    """Kind of a job's failure by its message; all of these may be retried."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return first_match([
        (text.rlike("429|rate.?limit"), "rate_limited"), (text.rlike("time.?out|timed out"), "timeout"), (F.coalesce(code, F.lit("")) == "ECONNREFUSED", "connection_refused"),
    ], "unexpected_error")


def extraction_failure_kind(kind: Column) -> Column:
    return first_match([(kind.isin("throttled", "rate_limited"), "extraction_throttled"), (kind.isin("schema_mismatch", "unparsable_json"), "extraction_malformed")], "extraction_failed")


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next attempt: doubling from five, at most five minutes."""
    return F.least(F.lit(RETRY_CAP), RETRY_DELAY * F.pow(F.lit(2), attempt - 1)).cast("int")
