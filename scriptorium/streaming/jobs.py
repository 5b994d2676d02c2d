"""Job states: an append-only event log instead of files that are overwritten.

Events: ``(job_id, ts, status, stage, timeout_seconds)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["queued", "running"]
TIMEOUT_SECONDS = 600


def latest(events: DataFrame) -> DataFrame:
    """One row for each job: the last event's fields, the time its clock started.

    The clock starts when the job first runs, so waiting in the queue doesn't count
    against its timeout; a job that never ran has its first event's time.  All come from one aggregation with partial sums; a busy job costs a row per task.
    """
    last = F.max(F.struct("ts", "event_id", "status", "stage", "timeout_seconds")).alias("last")
    return events.groupBy("job_id").agg(last, F.coalesce(F.min(F.when(F.col("status") == "running", F.col("ts"))), F.min("ts")).alias("started_at"), F.count(F.lit(1)).alias("n_events")).select(
        "job_id", "last.status", "last.stage", "last.timeout_seconds", F.col("last.ts").alias("updated_at"), "started_at", "n_events"
    )


def reconcile(jobs: DataFrame, now: Column, default_timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Running jobs past their timeout fail; a timeout of zero or less never does."""
    limit = F.coalesce("timeout_seconds", F.lit(default_timeout))
    late = (F.col("status") == "running") & (limit > 0) & (F.unix_micros(now) - F.unix_micros(F.col("started_at").cast("timestamp")) > limit * 1_000_000)
    return jobs.withColumns(
        {
            "failure_kind": F.when(late, "timeout"),
            "status": F.when(late, "failed").otherwise(F.col("status")),
        }
    )


def interrupted(jobs: DataFrame) -> DataFrame:
    """After a restart, jobs that were active have failed."""
    active = F.col("status").isin(*ACTIVE)
    return jobs.withColumns({"failure_kind": F.when(active, "interrupted"), "status": F.when(active, "failed").otherwise(F.col("status"))})


def worker_exit(jobs: DataFrame, exits: DataFrame) -> DataFrame:
    """Active jobs whose worker has ended, ``exits(job_id, exit_code)``, have failed; the
    code is noted.  Jobs that are done stay as they are, whatever the worker returned."""
    joined = jobs.join(exits.groupBy("job_id").agg(F.max("exit_code").alias("exit_code")), "job_id", "left")
    gone = F.col("status").isin(*ACTIVE) & F.col("exit_code").isNotNull()
    return joined.withColumns({"failure_kind": F.when(gone, "worker_exit"), "status": F.when(gone, "failed").otherwise(F.col("status"))})


def listing(jobs: DataFrame) -> DataFrame:
    """Jobs in the order of a list: the last updated first, ties by job_id."""
    return jobs.orderBy(F.desc("updated_at"), "job_id")


def timeline(events: DataFrame) -> DataFrame:
    """``(job_id, seq, stage, entered_at, left_at)``: the stages a job went through; a
    stage lasts until another one is reported, the last one is open."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    entered = events.withColumn("before", F.lag("stage").over(order)).filter(~F.col("stage").eqNullSafe(F.col("before")) | F.col("before").isNull())
    return entered.select(
        "job_id",
        F.row_number().over(order).alias("seq"),
        "stage",
        F.col("ts").alias("entered_at"),
        F.lead("ts").over(order).alias("left_at"),
    )


def live(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "running").agg(F.count(F.lit(1)).alias("live_workers"))


def stream_latest(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The same latest state over a stream of events, for update or complete mode."""
    return events.withWatermark("ts", watermark).groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status", "stage")).alias("last"))


def run_available(events: DataFrame, checkpoint: str, sink) -> None:
    """Process what is there and stop: ``sink(frame, epoch)`` sees each batch."""
    events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
