"""Streams: windowed event counts with a watermark, and the fetch ledger's state machine by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Attempts before an artifact is dead; seconds of a lease, and between an error and the next claim.
ATTEMPTS, LEASE, BACKOFF = 5, 15 * 60, 5 * 60
FINAL = ("done", "skipped", "superseded", "dead")
_STATE = "key bigint, state string, attempts int, until bigint, events bigint"

def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of tumbling windows by event type; works on a stream (with a watermark) and on a table."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def drained(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The events table as a stream, run until it is read through; all windows, also open ones."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"windows_{uuid.uuid4().hex}"
    out = event_windows(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.table(name)


def step(state: str, attempts: int, until: int, action: str, at: int) -> tuple[str, int, int]:
    """The state of an artifact after an action at a second: enqueue, reopen, claim, done, skip, supersede, fail.

    A claim takes what is pending, what failed BACKOFF ago, or what is claimed under a lease that ran out, and counts
    as an attempt; after ATTEMPTS the artifact is dead. Only a claim under its lease ends as done, skipped or failed.
    Final states change by reopen only. Actions that do not fit change nothing.
    """
    if action == "reopen":
        return "pending", 0, 0
    if state in FINAL or action == "enqueue":
        return state, attempts, until
    if action == "supersede":
        return "superseded", attempts, 0
    if action == "claim" and (state == "pending" or at >= until):
        return ("dead", attempts, 0) if attempts >= ATTEMPTS else ("claimed", attempts + 1, at + LEASE)
    if state == "claimed" and at < until:
        if action == "fail":
            return ("dead", attempts, 0) if attempts >= ATTEMPTS else ("error", attempts, at + BACKOFF)
        if action in ("done", "skip"):
            return "done" if action == "done" else "skipped", attempts, 0
    return state, attempts, until


def replayed(actions: DataFrame) -> DataFrame:
    """(key, state, attempts, until, events) after all actions (key, action, at in seconds, id) of each key, in the order of (at, id).

    A task reads its keys' actions in order and holds one state, whatever the length of a key's history. The order
    within a key is the state machine's own: one key's actions cannot be dealt to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, ("pending", 0, 0), 0
        for b in batches:
            out = []
            for k, action, at in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if k != key:
                    if n:
                        out.append((key, *held, n))
                    key, held, n = k, ("pending", 0, 0), 0
                held, n = step(*held, action, at), n + 1
            if out:
                yield _states(out)
        if n:
            yield _states([(key, *held, n)])

    a = actions.where("key is not null").select(F.col("key").cast("bigint").alias("key"), "action", F.col("at").cast("bigint").alias("at"), "id")
    return a.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, _STATE)


def _states(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in _STATE.split(", ")])


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    *held, n = state.get if state.exists else ("pending", 0, 0, 0)
    for r in pd.concat(frames).sort_values(["at", "id"]).itertuples():
        held, n = step(*held, r.action, int(r.at)), n + 1
    state.update((*held, n))
    yield pd.DataFrame([(key[0], *held, n)], columns=[x.split()[0] for x in _STATE.split(", ")])


def tracked(actions: DataFrame) -> DataFrame:
    """The stream of replayed(): a row for each key that a micro-batch moved. Actions that come later than a batch are applied after it."""
    return actions.groupBy("key").applyInPandasWithState(_advance, _STATE, "state string, attempts int, until bigint, events bigint", "update", GroupStateTimeout.NoTimeout)


def actions_of(events: DataFrame) -> DataFrame:
    """The events table as actions on artifacts."""
    names = {"view": "claim", "click": "done", "error": "fail", "signup": "reopen", "purchase": "enqueue"}
    action = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in names.items()), F.lit("enqueue"))
    return events.select(F.col("user_id").alias("key"), action.alias("action"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("id"))
