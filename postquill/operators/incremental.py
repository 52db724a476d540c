"""Upserts, queues and schedules as set operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRY_SECONDS, MAX_ATTEMPTS = 60, 3
STALE_MINUTES = 15
DUE_SOON_DAYS = 7


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The rows of ``new`` that a table with unique ``keys`` would accept, to be appended."""
    best = Window.partitionBy(*keys).orderBy(order if order is not None else F.xxhash64(*new.columns))
    first = new.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    return first.join(table.select(*keys), keys, "left_anti").select(*new.columns)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The table after the update: of rows with equal keys the last in ``new`` wins."""
    best = Window.partitionBy(*keys).orderBy((order if order is not None else F.xxhash64(*new.columns)).desc())
    last = new.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    return table.join(last.select(*keys), keys, "left_anti").select(*table.columns).unionByName(last.select(*table.columns))


def cascade_delete(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone.select(key), key, "left_anti").select(*child.columns)


def suggestions(commitments: DataFrame, existing: DataFrame) -> DataFrame:
    """One pending suggestion per dated commitment that has none yet."""
    new = commitments.where(F.col("due_at").isNotNull()).select(F.col("id").alias("commitment_id"), "user_id", F.lit("pending").alias("status"))
    return insert_ignore(existing, new, ["commitment_id"])


def transition(rows: DataFrame, ids: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """Status changes that are allowed only from ``source``; other rows stay."""
    marked = rows.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return marked.withColumn("status", F.when(F.col("__hit") & (F.col("status") == source), target).otherwise(F.col("status"))).select(*rows.columns)


def due_jobs(jobs: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The oldest queued jobs that may run: what a single claimer takes next."""
    return jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now)).orderBy("run_after", "id").limit(limit)


def claimed(jobs: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The queue after a claim."""
    taken = due_jobs(jobs, now, limit).select("id").withColumn("__t", F.lit(True))
    rows = jobs.join(taken, "id", "left")
    hit = F.coalesce("__t", F.lit(False))
    return rows.withColumns({"status": F.when(hit, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + hit.cast("int")}).select(*jobs.columns)


def failed(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after their run failed: queued again, later each time, until they are given up."""
    again = F.col("attempts") < MAX_ATTEMPTS
    later = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + F.col("attempts").cast("long") * RETRY_SECONDS * 1_000_000)
    return jobs.withColumns({"status": F.when(again, "queued").otherwise("failed"), "run_after": F.when(again, later).otherwise(F.col("run_after"))})


def due_syncs(state: DataFrame, jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Users whose mailbox is ready, stale and not queued or running already."""
    stale = F.col("last_sync_utc").isNull() | (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_sync_utc").cast("timestamp")) >= minutes * 60)
    busy = jobs.where((F.col("type") == "sync") & F.col("status").isin("queued", "running")).select("user_id")
    return state.where((F.col("status") == "ready") & stale).join(busy, "user_id", "left_anti").select("user_id")


def due_digests(settings: DataFrame, now: Column) -> DataFrame:
    sent = F.col("last_sent_utc")
    return settings.where(F.col("enabled") & (F.hour(now) == F.col("send_hour_utc")) & (sent.isNull() | (F.to_date(sent) < F.to_date(now)))).select("user_id")


def digest(commitments: DataFrame, pending: DataFrame, messages: DataFrame, last: DataFrame, now: Column) -> DataFrame:
    """user_id, due_soon, pending, new_messages (since the last digest, else a day)."""
    day = F.to_date(now)
    soon = commitments.where(F.col("due_at").between(day, F.date_add(day, DUE_SOON_DAYS))).groupBy("user_id").agg(F.count(F.lit(1)).alias("due_soon"))
    wait = pending.where("status = 'pending'").groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"))
    since = last.groupBy("user_id").agg(F.max("created_at").alias("since"))
    start = F.coalesce("since", now - F.expr("INTERVAL 1 DAY"))
    fresh = messages.join(since, "user_id", "left").where(F.col("date_utc") > start).groupBy("user_id").agg(F.count(F.lit(1)).alias("new_messages"))
    every = soon.join(wait, "user_id", "full_outer").join(fresh, "user_id", "full_outer")
    return every.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("due_soon", "pending", "new_messages")])


def eta_seconds(started: Column, now: Column, current: Column, total: Column) -> Column:
    """Remaining seconds by the pace so far; null until there is progress."""
    elapsed = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp"))
    return F.when((current > 0) & total.isNotNull(), elapsed / current * (total - current))


def commitments_in_window(commitments: DataFrame, start: Column, end: Column) -> DataFrame:
    return commitments.where(F.col("due_at").between(start, end)).orderBy("due_at", F.desc("confidence"), "message_id")


def window_count(commitments: DataFrame, start: Column, end: Column) -> DataFrame:
    return commitments.where(F.col("due_at").between(start, end)).agg(F.count(F.lit(1)).alias("n"), F.min("due_at").alias("earliest"), F.max("due_at").alias("latest"))
