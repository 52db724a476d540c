"""A queue of jobs as a versioned table, and the one process that works it off.

The queue is small (a row per job); what a handler does with its tables is distributed.
Every change is a new version of the table, so a lost driver finds the queue as it
was before or after a step. One process may write at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..sources import versions

JOBS = "id long, type string, user_id string, status string, attempts int, run_after timestamp, error string"
POLL_SECONDS = 5.0
#: What a finished job sets off, for the same user.
CHAINED = {"initial_sync": ("extract_commitments", "backfill_history"), "incremental_sync": ("extract_commitments",)}
SYNCS = ("initial_sync", "incremental_sync", "backfill_history")


def enqueued(jobs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The queue with a job for each (type, user_id) of ``wanted``, numbered on."""
    last = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    ranked = wanted.groupBy().agg(F.array_sort(F.collect_list(F.struct("type", "user_id"))).alias("w")).select(F.posexplode("w").alias("n", "w"))  # the few jobs of one step
    new = ranked.crossJoin(F.broadcast(last)).select((F.col("__last") + F.col("n") + 1).alias("id"), "w.type", "w.user_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), now.alias("run_after"), F.lit(None).cast("string").alias("error"))
    return jobs.unionByName(new)


class Dispatcher:
    """Handlers by job type over the queue at ``root``."""

    def __init__(self, spark: SparkSession, root: str, invalidate: Callable[[str], None] | None = None):
        self.spark, self.root, self.invalidate = spark, root, invalidate
        self.handlers: dict[str, Callable[[Row], None]] = {}

    def register(self, job_type: str):
        def keep(handler: Callable[[Row], None]):
            self.handlers[job_type] = handler
            return handler

        return keep

    def jobs(self) -> DataFrame:
        return versions.read(self.spark, self.root, JOBS)

    def enqueue(self, now: Column, *wanted: tuple[str, str | None]) -> None:
        if wanted:
            rows = self.spark.createDataFrame(list(wanted), "type string, user_id string")
            versions.replace(enqueued(self.jobs(), rows, now).coalesce(1), self.root)

    def _settle(self, job: Row, status: str, now: Column, error: str | None = None) -> None:
        jobs, mine = self.jobs(), F.col("id") == job["id"]
        if status == "retry":
            after = incremental.failed(jobs.where(mine), now).unionByName(jobs.where(~mine))
        else:
            after = jobs.withColumn("status", F.when(mine, status).otherwise(F.col("status")))
        versions.replace(after.withColumn("error", F.when(mine, F.lit(error)).otherwise(F.col("error"))).coalesce(1), self.root)

    def run_once(self, now: Column) -> bool:
        """Takes and works off at most one job; false where none is due. A handler that
        fails puts its job back, a type without a handler fails for good."""
        job = incremental.due_jobs(self.jobs(), now).first()
        if job is None:
            return False
        versions.replace(incremental.claimed(self.jobs(), now).coalesce(1), self.root)
        handler = self.handlers.get(job["type"])
        if handler is None:
            self._settle(job, "failed", now, f"no handler for {job['type']}")
            return True
        try:
            handler(job)
        except Exception as e:  # a job's failure is the job's, not the queue's
            self._settle(job, "retry", now, f"{type(e).__name__}: {e}")
            return True
        self._settle(job, "done", now)
        self.enqueue(now, *[(t, job["user_id"]) for t in CHAINED.get(job["type"], ())])
        if self.invalidate and job["user_id"] and job["type"] in SYNCS:
            self.invalidate(job["user_id"])
        return True

    def poll(self, stop: Callable[[], bool], seconds: float = POLL_SECONDS, schedule: Callable[[], None] | None = None) -> int:
        """Works until ``stop``: jobs one after another, a pause where none is due."""
        done = 0
        while not stop():
            if schedule:
                schedule()
            if self.run_once(F.current_timestamp()):
                done += 1
            else:
                time.sleep(seconds)
        return done
