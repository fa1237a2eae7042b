"""The state of each upload job, kept by a stateful stream; jobs that never end are found by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOST = "No result within the time limit."
ENDED = ("completed", "failed")
# Stands for a time that is not known, where a null would turn whole numbers into floats.
NO_TIME = -(1 << 62)

_STATE = ("event_seq long, version long, created long, started long, ended long, last long, lost boolean, "
          "status string, fields string")
_ROWS = "job_id string, version long, created long, started long, ended long, lost boolean, status string, fields string"


def _earlier(a: int, b: int) -> int:
    return b if a == NO_TIME else a if b == NO_TIME else min(a, b)


def track_jobs(events: DataFrame, delay: str, lost_after: int, keep_for: int) -> DataFrame:
    """The current row of each job whenever it changes, from a stream of job events.

    ``events(job_id, event_seq, status, at, ...)`` are those of ``ingest.ingest_batch``; the row has
    their other columns of the latest event and ``created_at, started_at, completed_at``, as
    ``plans.ingestion.job_states``, and a ``version`` that grows by one with each row of the job.

    A job whose latest event says ``processing`` becomes ``failed`` with the error ``LOST`` when the
    watermark (``delay`` behind the latest event) has passed its time by ``lost_after`` seconds. A
    later event overrules that. What has ended is forgotten after ``keep_for`` seconds, so the state
    holds the jobs that wait or run and those that ended lately; each takes one row of fixed width,
    however many events it has.

    Events without a job or a number have no place and are left out; one without a time sets none.
    Equal events change nothing; of two with one number the first met counts.
    """
    names = [c for c in events.columns if c not in ("job_id", "event_seq", "status", "at")]
    fields = events.select(*names).schema

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            seq, version, created, started, ended, last, lost, status, kept = state.get
        else:
            seq, version, created, started, ended, last, lost, status, kept = NO_TIME, 0, NO_TIME, NO_TIME, NO_TIME, NO_TIME, False, None, "{}"
        if state.hasTimedOut:
            if lost or status in ENDED:
                state.remove()
                return
            lost = True
        before = (seq, created, started, ended)
        for frame in frames:
            for number, name, at, rest in zip(frame["event_seq"], frame["status"], frame["micros"], frame["fields"]):
                number, at = int(number), int(at)
                if name == "queued":
                    created = _earlier(created, at)
                elif name == "processing":
                    started = _earlier(started, at)
                elif name in ENDED:
                    ended = _earlier(ended, at)
                if number > seq:
                    seq, status, last, kept, lost = number, name, at, rest, False
        changed = state.hasTimedOut or before != (seq, created, started, ended)
        version += int(changed)
        state.update((seq, version, created, started, ended, last, lost, status, kept))
        if last != NO_TIME:
            limit = lost_after + keep_for if lost else lost_after if status == "processing" else keep_for if status in ENDED else None
            if limit is not None:
                # A timer must lie ahead of the watermark.
                state.setTimeoutTimestamp(max(last // 1000 + limit * 1000, state.getCurrentWatermarkMs() + 1))
        if changed:
            over = last + lost_after * 1_000_000 if lost else NO_TIME
            yield pd.DataFrame({
                "job_id": [key[0]], "version": [version], "created": [created], "started": [started],
                "ended": [_earlier(ended, over)], "lost": [lost], "status": [status], "fields": [kept],
            })

    rows = events.where("job_id is not null and event_seq is not null").withWatermark("at", delay).select(
        F.col("job_id").cast("string").alias("job_id"), F.col("event_seq").cast("long").alias("event_seq"), "status", "at",
        F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(NO_TIME)).alias("micros"),
        F.coalesce(F.to_json(F.struct(*names)) if names else F.lit(None), F.lit("{}")).alias("fields"),
    ).groupBy("job_id").applyInPandasWithState(step, _ROWS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    time = lambda c: F.when(F.col(c) != NO_TIME, F.timestamp_micros(c))
    error = F.when(F.col("lost"), F.lit(LOST))
    if "error" in names:
        error = F.coalesce(error, "f.error")
    return rows.withColumn("f", F.from_json("fields", fields)).select(
        "job_id", "version", F.when(F.col("lost"), "failed").otherwise(F.col("status")).alias("status"),
        *[F.col("f")[c].alias(c) for c in names if c != "error"], error.alias("error"),
        time("created").alias("created_at"), time("started").alias("started_at"), time("ended").alias("completed_at"),
    )


def start_tracking(events: DataFrame, out: str, delay: str, lost_after: int, keep_for: int) -> StreamingQuery:
    """Write the rows of ``track_jobs`` for all events that are there, then stop; a repeated batch rewrites its folder."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/job_rows/batch_id={batch_id}")

    return (
        track_jobs(events, delay, lost_after, keep_for).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def tracked_jobs(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each job that ``start_tracking`` has written."""
    rows = spark.read.parquet(f"{out}/job_rows").drop("batch_id")
    # A job that comes back after it was forgotten starts its versions anew: later batches go first.
    names = [c for c in rows.columns if c != "job_id"]
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(\d+)", 1).cast("long")
    newest = F.max_by(F.struct(*names), F.struct(batch, "version"))
    return rows.groupBy("job_id").agg(newest.alias("now")).select("job_id", "now.*")
