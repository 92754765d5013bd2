"""Durable processing as Structured Streaming: uploads, issue events and incremental comparison.

Each stream has a checkpoint, and each batch writes through sinks that may be repeated: outcomes by their
batch's own folder, documents, claims and pairs by key. A replayed batch neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from factloom.operators import durable, neighbours
from factloom.operators.candidates import comparable_claims, exact_candidates
from factloom.operators.sinks import append_new, bucket_of, read_or_none, touched, upsert
from factloom.sources.uploads import document_key, ingest, validate_uploads


def settle_uploads(spark: SparkSession, files: DataFrame, batch_id: int, documents: str, outcomes: str, collection_id: str) -> None:
    """Outcome of each file of a batch, then its new documents; safe to repeat.

    Outcomes go to the batch's own folder and are settled once: documents are only appended after that, so a
    batch without outcomes has left no documents to be mistaken for older ones. A replay takes the outcomes as they
    are and appends what is missing.
    """
    checked = validate_uploads(files).drop("content")
    folder = f"{outcomes}/batch_id={batch_id}"
    if read_or_none(spark, f"{folder}/_SUCCESS", exists_only=True) is None:
        stored = touched(spark, documents, checked.where("content_hash is not null").select(bucket_of("content_hash").alias("bucket")))
        empty = checked.withColumn("collection_id", F.lit(collection_id)).select("collection_id", "content_hash").limit(0)
        _, outcome = ingest(checked, empty if stored is None else stored.select("collection_id", "content_hash"), collection_id)
        outcome.write.mode("overwrite").parquet(folder)
    accepted = spark.read.parquet(folder).where("outcome = 'accepted'").select("path")
    new = checked.join(accepted, "path", "left_semi").withColumn("collection_id", F.lit(collection_id)).withColumn("storage_key", document_key(F.col("content_hash")))
    append_new(spark, documents, new, ["collection_id", "content_hash"], ["path"], ["content_hash"])


def watch_uploads(spark: SparkSession, folder: str, documents: str, outcomes: str, checkpoint: str, collection_id: str, prepare: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Files that appear in a folder become documents; `prepare` adds page_count and open_error."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        settle_uploads(spark, prepare(batch.select("path", "content", F.col("length").alias("size"))), batch_id, documents, outcomes, collection_id)

    w = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def issue_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Streaming count of issue events (run_id, failure_kind, at) by day; events later than `late` do not count."""
    w = events.withWatermark("at", late)
    return w.groupBy(F.window("at", window).alias("day"), "failure_kind").agg(F.count("*").alias("events"), F.approx_count_distinct("run_id").alias("runs"))


def watch_claims(spark: SparkSession, claims_folder: str, schema: str, stored: str, candidates: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """New claims meet all stored claims and each other; pairs are appended once, whatever the order of arrival.

    Claims are kept in buckets of their collection, pairs in buckets of their first claim; a batch reads only those it touches.
    """
    arriving = spark.readStream.schema(schema).parquet(claims_folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        append_new(spark, stored, batch, ["collection_id", "id"], ["document_id"], ["collection_id"])
        around = touched(spark, stored, batch.select(bucket_of("collection_id").alias("bucket")))
        pairs = exact_candidates(comparable_claims(batch), comparable_claims(around))
        append_new(spark, candidates, pairs, ["claim_a_id", "claim_b_id"], ["collection_id"], ["claim_a_id"])
        batch.unpersist()

    w = arriving.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


VECTORS = "id string, collection_id string, document_id string, model string, embedding array<float>"


def add_vectors(spark: SparkSession, batch: DataFrame, vectors: str, nearest: str, found: str, k: int = 15, block_rows: int = 4096) -> None:
    """A batch of claims' vectors enters the neighbour lists; safe to repeat, and the lists do not depend on the order of batches.

    Stored: the vectors, in buckets of their collection; each claim's list of its k nearest claims of other documents, in
    buckets of the claim; and the pairs that a claim brought up when it arrived, from its own side. A stored claim's list
    is changed only by new claims nearer than its k-th, which is the reach that its search starts with.
    """
    batch = batch.dropDuplicates(["collection_id", "id"]).persist()
    append_new(spark, vectors, batch, ["collection_id", "id"], ["document_id"], ["collection_id"])
    around = touched(spark, vectors, batch.select(bucket_of("collection_id").alias("bucket"))).drop("bucket")
    around = around.join(batch.select("collection_id").distinct(), "collection_id", "left_semi")
    own, _ = neighbours.search(batch, around, k, block_rows)
    own = own.persist()
    older = around.join(batch.select("collection_id", "id"), ["collection_id", "id"], "left_anti")
    lists = read_or_none(spark, nearest)
    if lists is not None:
        reach = lists.where(F.col("rank") == k).select(F.col("left_id").alias("id"), F.col("distance").alias("reach"))
        older = older.join(reach, "id", "left")
    theirs, _ = neighbours.search(older, batch, k, block_rows)
    both = own.unionByName(theirs).select("collection_id", "left_id", "right_id", "distance", "rank")
    upsert(spark, nearest, both, ["left_id"], lambda old, new: neighbours.merge(old, new, k))
    pairs = own.select("collection_id", F.least("left_id", "right_id").alias("claim_a_id"), F.greatest("left_id", "right_id").alias("claim_b_id"), "distance")
    append_new(spark, found, pairs, ["claim_a_id", "claim_b_id"], ["distance"], ["claim_a_id"])
    own.unpersist()
    batch.unpersist()


def watch_vectors(spark: SparkSession, vectors_folder: str, vectors: str, nearest: str, found: str, checkpoint: str, k: int = 15, once: bool = True) -> StreamingQuery:
    """Vectors that appear in a folder enter the stored neighbour lists, batch by batch."""
    arriving = spark.readStream.schema(VECTORS).parquet(vectors_folder)
    w = arriving.writeStream.foreachBatch(lambda batch, _: add_vectors(spark, batch, vectors, nearest, found, k)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


#: Keyed state with timers needs a state store with column families.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
JOB_EVENTS = "document_id string, event_id bigint, at_us bigint, kind string"


class JobProcessor(StatefulProcessor):
    """One document's job as keyed state.

    Events wait, by time and id, until the watermark has passed them, and are then applied in order; so the
    order of arrival does not matter, and one that arrives twice is kept once. What comes after its time has
    been settled is late, or a replay, and is dropped. Timers stand at waiting events and at the job's own next change.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", durable.FIELDS)
        self.waiting = handle.getMapState("waiting", "at_us bigint, event_id bigint", "kind string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        for r in rows:
            if r["at_us"] is not None and r["kind"] is not None and r["at_us"] >= settled:
                self.waiting.updateValue((r["at_us"], r["event_id"]), (r["kind"],))
                self.handle.registerTimer(r["at_us"] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        job = durable.Job(*self.job.get()) if self.job.exists() else durable.Job()
        due = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] < until)
        changes: list[tuple] = []
        for (at, event_id), kind in due:
            changes += job.event(at, kind)
            self.waiting.removeKey((at, event_id))
        changes += job.elapse(until)
        self.job.update(job.values())
        wake = job.wake()
        if wake is not None:
            self.handle.registerTimer(max(wake, until) // 1000 + 1)
        for c in changes:
            yield Row(**dict(zip(("document_id", "job", "at_us", "state", "attempt", "stage", "reason"), (key[0], *c), strict=True)))

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming state changes of document jobs from events (document_id, event_id, at_us, kind), settled once the watermark passes them."""
    e = events.where("document_id is not null").withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return e.groupBy("document_id").transformWithState(JobProcessor(), durable.CHANGES, "Append", "eventTime")


def watch_jobs(spark: SparkSession, events_folder: str, changes: str, checkpoint: str, late: str = "10 minutes", once: bool = True, files_a_batch: int = 1000) -> StreamingQuery:
    """Job events that appear in a folder become state changes in another, each once; needs STATE_STORE to be set."""
    arriving = spark.readStream.schema(JOB_EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(events_folder)
    w = job_changes(arriving, late).writeStream.format("parquet").option("path", changes).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
