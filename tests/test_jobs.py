"""Durable jobs: the machine event by event, and the stream against the table, with replays, disorder and late events."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest

from factloom.operators import durable
from factloom.streaming import jobs

S = durable.SECOND


def run(events, until=10**9):
    job, out = durable.Job(), []
    for at, kind in events:
        out += job.event(at * S, kind)
    out += job.elapse(until * S)
    return [(c[1] // S, c[2], c[3]) for c in out]


def test_a_job_runs_through_its_stages():
    got = run([(0, "enqueue"), (1, "start"), *((k * 100, "advance") for k in range(1, 6)), (600, "enqueue")])
    assert got == [(0, "queued", 0), (1, "parsing", 1), (100, "extracting", 1), (200, "normalizing", 1), (300, "comparing", 1), (400, "completed", 1), (600, "queued", 0)]


def test_one_open_job_a_document():
    assert run([(0, "enqueue"), (1, "enqueue"), (2, "start"), (3, "enqueue")], 4)[1:] == [(1, "refused", 0), (2, "parsing", 1), (3, "refused", 1)]
    assert run([(0, "start"), (1, "beat"), (2, "fail"), (3, "advance")]) == []


def test_retries_wait_longer_each_time_and_end():
    at, events = 0, [(0, "enqueue")]
    for n in range(6):
        events += [(at + 1, "start"), (at + 2, "fail")]
        at += 2 + min(300, 5 * 2**n)
    got = [c for c in run(events) if c[1] in ("ready", "failed")]
    assert [c[2] for c in got] == [1, 2, 3, 4, 5, 6] and got[-1][1] == "failed"
    assert [b - a for (a, *_), (b, *_) in zip(got, got[1:], strict=False)] == [12, 22, 42, 82, 2]


def test_start_before_the_delay_has_passed_does_nothing():
    assert run([(0, "enqueue"), (1, "start"), (2, "fail"), (6, "start"), (7, "start")], 8)[2:] == [(2, "waiting", 1), (7, "ready", 1), (7, "parsing", 2)]


def test_silence_and_expiry():
    got = run([(0, "enqueue"), (0, "start"), (300, "beat"), (601, "beat"), (902, "enqueue"), (903, "start")], 4504)
    assert got == [(0, "queued", 0), (0, "parsing", 1), (600, "stalled", 1), (601, "resumed", 1), (901, "stalled", 1), (902, "superseded", 1), (902, "queued", 0), (903, "parsing", 1), (1203, "stalled", 1), (4503, "waiting", 1)]
    assert run([(0, "enqueue"), (0, "start"), *((k * 299, "beat") for k in range(1, 13))], 3601)[2:] == [(3600, "waiting", 1)]


@pytest.fixture
def state_store(spark):
    spark.conf.set(*jobs.STATE_STORE)
    yield spark
    spark.conf.unset(jobs.STATE_STORE[0])


def test_stream_gives_the_changes_of_the_table(state_store, tmp_path):
    spark, rng = state_store, random.Random(8)
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()) * S
    kinds = ["enqueue", "start", "start", "beat", "advance", "advance", "fail", "start"]
    events = [(f"d{rng.randrange(4)}", k, start + k * 40 * S + rng.randrange(30 * S), rng.choice(kinds)) for k in range(360)]
    # Arrival: out of order by less than the lateness, and a quarter of the events again, in the same or a later file.
    arrived = sorted(events, key=lambda e: e[2] + rng.randrange(500 * S))
    files = [arrived[k : k + 60] for k in range(0, 360, 60)]
    for k in range(6):
        files[k] = files[k] + rng.sample(files[k], 15) + (rng.sample(files[k - 1], 15) if k else [])
    late = [("d0", 9000 + k, start + k * S, "beat") for k in range(5)]
    files.append([("d0", 9999, events[-1][2] + 9000 * S, "beat")])
    files.append([*late, ("d1", 9998, events[-1][2] + 9001 * S, "beat")])
    args = [str(tmp_path / n) for n in ("in", "changes", "checkpoint")]
    for f in files:  # one file a batch, and the query stopped and started again between them
        spark.createDataFrame(f, jobs.JOB_EVENTS).coalesce(1).write.mode("append").parquet(args[0])
        q = jobs.watch_jobs(spark, *args)
        q.awaitTermination()
    changes = spark.read.parquet(args[1]).collect()
    settled = int(datetime.fromisoformat([p["eventTime"]["watermark"] for p in q.recentProgress if p.get("eventTime")][-1].replace("Z", "+00:00")).timestamp()) * S
    assert settled > events[-1][2] + 3600 * S
    table = durable.replay(spark.createDataFrame(events + events[:50], jobs.JOB_EVENTS), settled)
    key = lambda r: (r["document_id"], r["at_us"], r["job"], r["state"], r["attempt"], r["stage"], r["reason"])
    want = sorted((key(r) for r in table.collect()), key=repr)
    assert sorted((key(r) for r in changes), key=repr) == want and len(want) > 100
    assert {"stalled", "resumed", "superseded", "refused", "waiting", "ready", "completed"} <= {c[3] for c in want}
