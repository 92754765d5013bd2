"""Durable document jobs as a state machine: one open job a document, retries, expiry and silence.

`replay` runs it over a table of events, `streaming.jobs.watch_jobs` over a stream with keyed state and timers;
both go through `Job`, so that they give the same changes.

Events (document_id, event_id, at_us, kind), at_us in microseconds:

- enqueue: opens a job, unless one is open (refused); an open job that fell silent is given up for the new one,
- start: a queued job begins an attempt in its first stage,
- beat: the running attempt is alive; advance: it is alive and enters its next stage, or is completed,
- fail: the attempt is lost. A lost attempt waits, longer each time, and is queued again; after the last retry the job has failed.

Between events time passes: an attempt that takes longer than the expiry is lost, one that is silent for more
than five minutes is stalled until its next sign of life. Where several fall together, expiry comes before
silence, and what has fallen due comes before an event of that time. Events of one time go by event_id; a
repeated event counts once; events that do not apply change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame

from factloom.operators.state import RETRIES, RETRY_CAP, RETRY_DELAY, STAGES, STALL_SECONDS

# Fixed value: seconds after which an attempt counts as lost.
EXPIRY_SECONDS = 3600
WORKING = STAGES[1:6]
SECOND = 1_000_000
CHANGES = "document_id string, job bigint, at_us bigint, state string, attempt int, stage string, reason string"
FIELDS = "job bigint, status string, attempt int, stage string, started bigint, last bigint, stalled boolean, due bigint"


@dataclass
class Job:
    """A document's latest job. status: none, queued, running, waiting or ended."""

    job: int = 0
    status: str = "none"
    attempt: int = 0
    stage: str | None = None
    started: int = 0
    last: int = 0
    stalled: bool = False
    due: int = 0

    def change(self, at: int, state: str, reason: str | None = None) -> tuple:
        return (self.job, at, state, self.attempt, self.stage, reason)

    def lose(self, at: int, reason: str) -> tuple:
        self.stage, self.stalled = None, False
        if self.attempt > RETRIES:
            self.status = "ended"
            return self.change(at, "failed", reason)
        self.status, self.due = "waiting", at + min(RETRY_CAP, RETRY_DELAY << (self.attempt - 1)) * SECOND
        return self.change(at, "waiting", reason)

    def wake(self) -> int | None:
        """When the next thing happens without an event."""
        if self.status == "waiting":
            return self.due
        if self.status != "running":
            return None
        expiry, silence = self.started + EXPIRY_SECONDS * SECOND, self.last + STALL_SECONDS * SECOND
        return expiry if self.stalled else min(expiry, silence)

    def elapse(self, until: int) -> Iterator[tuple]:
        """Changes that time alone brings before `until`."""
        while (at := self.wake()) is not None:
            if self.status == "waiting" and at <= until:
                self.status = "queued"
                yield self.change(at, "ready")
            elif self.status == "running" and at < until:
                if at == self.started + EXPIRY_SECONDS * SECOND:
                    yield self.lose(at, "expired")
                else:
                    self.stalled = True
                    yield self.change(at, "stalled")
            else:
                return

    def event(self, at: int, kind: str) -> Iterator[tuple]:
        """Changes up to an event and by it."""
        yield from self.elapse(at)
        if kind == "enqueue":
            if self.status in ("queued", "waiting") or (self.status == "running" and not self.stalled):
                yield self.change(at, "refused")
                return
            if self.status == "running":
                yield self.change(at, "superseded")
            self.job, self.status, self.attempt, self.stage, self.stalled = self.job + 1, "queued", 0, None, False
            yield self.change(at, "queued")
        elif kind == "start" and self.status == "queued":
            self.status, self.attempt, self.stage, self.started, self.last, self.stalled = "running", self.attempt + 1, WORKING[0], at, at, False
            yield self.change(at, self.stage)
        elif self.status == "running" and kind == "fail":
            yield self.lose(at, "failed")
        elif self.status == "running" and kind in ("beat", "advance"):
            if self.stalled:
                yield self.change(at, "resumed")
            self.last, self.stalled = at, False
            if kind == "advance":
                self.stage = WORKING[WORKING.index(self.stage) + 1]
                self.status = "ended" if self.stage == WORKING[-1] else "running"
                yield self.change(at, self.stage)

    def values(self) -> tuple:
        return tuple(asdict(self).values())


def replay(events: DataFrame, until_us: int) -> DataFrame:
    """State changes of all jobs before `until_us`, from events (document_id, event_id, at_us, kind) in any order.

    Documents are dealt out by key and their events arrive sorted; a task holds one document's state, however
    many events it has. Events without document, time or kind are left out.
    """
    names = [c.split()[0] for c in CHANGES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, job, before = None, Job(), None
        for b in batches:
            rows: list[tuple] = []
            for d, event_id, at, kind in zip(b["document_id"], b["event_id"], b["at_us"], b["kind"], strict=True):
                if d != document:
                    rows += [(document, *c) for c in job.elapse(until_us)]
                    document, job, before = d, Job(), None
                if (at, event_id) != before:
                    rows += [(d, *c) for c in job.event(int(at), kind)]
                    before = (at, event_id)
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame([(document, *c) for c in job.elapse(until_us)], columns=names)

    e = events.where(f"document_id is not null and at_us < {int(until_us)} and kind is not null").select("document_id", "event_id", "at_us", "kind")
    return e.repartition("document_id").sortWithinPartitions("document_id", "at_us", "event_id").mapInPandas(run, CHANGES)
