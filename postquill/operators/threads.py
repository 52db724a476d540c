"""Thread reconstruction: reply headers, subject buckets, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import participants
from ..session import materialise
from .components import connected_components

# Fixed values.
MESSAGE_ID = r"<[^<>@\s]+@[^<>@\s]+>"
WINDOW_DAYS = 90
MAX_BUCKET = 50
MIN_SUBJECT = 4


def header_edges(messages: DataFrame) -> DataFrame:
    """(a, b) for every message id that In-Reply-To or References names. Of rows with
    the same message id the last by key is the target."""
    named = F.concat_ws(" ", F.coalesce("in_reply_to", F.lit("")), F.coalesce("references", F.lit("")))
    refs = messages.select(F.col("dedup_key").alias("a"), F.explode(F.regexp_extract_all(named, F.lit(MESSAGE_ID), F.lit(0))).alias("__ref"))
    target = messages.where(F.coalesce("message_id", F.lit("")) != "").groupBy(F.col("message_id").alias("__ref")).agg(F.max("dedup_key").alias("b"))
    return refs.join(target, "__ref").where("a <> b").select("a", "b").distinct()


def subject_edges(messages: DataFrame, window_seconds: int = WINDOW_DAYS * 86400, max_bucket: int = MAX_BUCKET, people: Column | None = None) -> DataFrame:
    """(a, b) between a message and its predecessor in time in the same subject bucket,
    if both are dated, close, and share a participant. Buckets over ``max_bucket`` are
    broadcasts and are dropped before any window is formed over them."""
    light = messages.where(F.length("subject_norm") >= MIN_SUBJECT).select("subject_norm", "dedup_key", "date_utc", (people if people is not None else participants()).alias("__who"))
    sizes = light.groupBy("subject_norm").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n").between(2, max_bucket)).select("subject_norm")
    rows = light.join(sizes, "subject_norm")
    by_time = Window.partitionBy("subject_norm").orderBy(F.col("date_utc").asc_nulls_last(), "dedup_key")
    pair = rows.select(
        F.col("dedup_key").alias("b"), F.lag("dedup_key").over(by_time).alias("a"), "date_utc", "__who",
        F.lag("date_utc").over(by_time).alias("__before"), F.lag("__who").over(by_time).alias("__whom"),
    )
    close = F.unix_micros(F.col("date_utc").cast("timestamp")) - F.unix_micros(F.col("__before").cast("timestamp")) <= window_seconds * 1_000_000
    return pair.where(F.col("a").isNotNull() & close & F.arrays_overlap("__who", "__whom")).select("a", "b")


def assign_threads(messages: DataFrame, **limits) -> DataFrame:
    """dedup_key, thread_id: the key of the earliest message of its component."""
    edges = header_edges(messages).unionByName(subject_edges(messages, **limits))
    return thread_ids(messages, edges)


def _refs(messages: DataFrame) -> DataFrame:
    named = F.concat_ws(" ", F.coalesce("in_reply_to", F.lit("")), F.coalesce("references", F.lit("")))
    return messages.select("dedup_key", F.explode(F.regexp_extract_all(named, F.lit(MESSAGE_ID), F.lit(0))).alias("__ref"))


def update_threads(known: DataFrame, threads: DataFrame, new: DataFrame, **limits) -> DataFrame:
    """(dedup_key, thread_id) of the ``new`` messages and of all ``known`` ones in a thread that
    they can change; ``threads`` (dedup_key, thread_id) are those of ``known``.

    A thread can change if it has a message in a subject bucket of a new one (where a late
    message may come between two others, or make the bucket a broadcast), or one that names a
    new message, is named by one, or shares its message id. Other threads keep all their edges,
    as both ends of an edge are in one thread. So only these threads are put together again, and
    the result with the other threads is that of ``assign_threads`` over all messages.
    """
    ids = lambda df: df.where(F.coalesce("message_id", F.lit("")) != "").select(F.col("message_id").alias("__ref")).distinct()
    subjects = new.where(F.length("subject_norm") >= MIN_SUBJECT).select("subject_norm").distinct()
    same_id = known.select("dedup_key", F.col("message_id").alias("__ref")).join(ids(new).unionByName(_refs(new).select("__ref")).distinct(), "__ref", "left_semi")
    seeds = known.join(subjects, "subject_norm", "left_semi").select("dedup_key").unionByName(_refs(known).join(ids(new), "__ref", "left_semi").select("dedup_key")).unionByName(same_id.select("dedup_key"))
    changed = threads.join(seeds.distinct(), "dedup_key", "left_semi").select("thread_id").distinct()
    keys = materialise(threads.join(changed, "thread_id", "left_semi").select("dedup_key").unionByName(new.select("dedup_key")), "threads-open")
    every = known.unionByName(new, allowMissingColumns=True)
    touched = materialise(every.join(keys, "dedup_key", "left_semi"), "threads-touched")
    # buckets count with all their messages, edges with both ends in the changed threads
    whole = every.join(touched.where(F.length("subject_norm") >= MIN_SUBJECT).select("subject_norm").distinct(), "subject_norm", "left_semi")
    inside = subject_edges(whole, **limits).join(keys.select(F.col("dedup_key").alias("a")), "a", "left_semi").join(keys.select(F.col("dedup_key").alias("b")), "b", "left_semi")
    return thread_ids(touched, header_edges(touched).unionByName(inside.select("a", "b")))


def thread_ids(messages: DataFrame, edges: DataFrame) -> DataFrame:
    comp = connected_components(edges)
    light = messages.select("dedup_key", "date_utc").join(comp.select(F.col("id").alias("dedup_key"), "component"), "dedup_key", "left")
    light = light.withColumn("component", F.coalesce("component", "dedup_key"))
    first = light.groupBy("component").agg(F.min_by("dedup_key", F.struct(F.col("date_utc").isNull(), "date_utc", "dedup_key")).alias("thread_id"))
    return light.join(first, "component").select("dedup_key", "thread_id")


def thread_stats(messages: DataFrame, **limits) -> DataFrame:
    """One row of counts. Links are counted by identities that do not depend on any
    order: header links = n - components of the header edges; heuristic links =
    those components less the final ones."""
    headers, subjects = header_edges(messages), subject_edges(messages, **limits)
    max_bucket = limits.get("max_bucket", MAX_BUCKET)

    def parts(edges: DataFrame) -> DataFrame:
        return thread_ids(messages, edges).groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))

    by_header = parts(headers).agg(F.count(F.lit(1)).alias("header_parts"))
    final = parts(headers.unionByName(subjects)).agg(
        F.sum("n").alias("messages"), F.count(F.lit(1)).alias("threads"), F.count_if(F.col("n") > 1).alias("multi_message_threads"),
        F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest_thread"),
    )
    skipped = messages.where(F.length("subject_norm") >= MIN_SUBJECT).groupBy("subject_norm").count().agg(F.count_if(F.col("count") > max_bucket).alias("oversized_buckets_skipped"))
    one = lambda df: df.withColumn("__k", F.lit(1))
    row = one(final).join(one(by_header), "__k").join(one(skipped), "__k")
    return row.select(
        "messages", "threads", "multi_message_threads", "singletons", (F.col("messages") - F.col("header_parts")).alias("linked_by_header"),
        (F.col("header_parts") - F.col("threads")).alias("linked_by_heuristic"), "oversized_buckets_skipped", "largest_thread",
    )
