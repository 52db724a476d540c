"""Incremental ingestion as micro-batches over table-backed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_bulk
from ..operators.chunking import chunk_changes, chunked
from ..operators.corpus import first_copies, new_bulk_rows
from ..operators.indexes import load_or_build
from ..operators import segments
from ..operators.threads import assign_threads, update_threads
from ..schemas import BULK, MESSAGES
from ..sources import versions
from ..sources.tables import read_if_there


def ingest_batch(spark: SparkSession, batch: DataFrame, root: str, batch_id: int) -> None:
    """Adds the new, non-bulk messages of a batch; bulk ones only as counts. Rows carry
    their batch id and a batch that is run again replaces itself, so a restart after
    a lost driver neither loses nor repeats messages."""
    known = read_if_there(spark, f"{root}/messages", MESSAGES + ", batch long").where(F.col("batch") != batch_id)
    bulk = read_if_there(spark, f"{root}/bulk", BULK + ", batch long").where(F.col("batch") != batch_id)
    seen = known.select("dedup_key").unionByName(bulk.select("dedup_key"))
    fresh = first_copies(batch).join(seen, "dedup_key", "left_anti").select(*batch.columns)
    for part, name in ((new_bulk_rows(batch, seen), "bulk"), (fresh.where(~is_bulk()), "messages")):
        part.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/batch={batch_id}")


def ingest(stream: DataFrame, root: str, parse: Callable[[DataFrame], DataFrame]):
    """A query that ingests whatever there is and stops; offsets are in the checkpoint."""
    spark = stream.sparkSession
    return (
        stream.writeStream.foreachBatch(lambda df, i: ingest_batch(spark, parse(df), root, i))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )


def staged(messages: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """Recent mail first, the complement at the same cutoff later: together everything once."""
    recent = F.coalesce(F.col("date_utc") >= cutoff, F.lit(False))
    return messages.where(recent), messages.where(~recent)


def rethread(spark: SparkSession, root: str, **limits) -> DataFrame:
    """Threads of all messages anew, as the next version of ``threaded``: a late message can
    join threads that were apart. The version before stays readable until the new one is whole."""
    messages = read_if_there(spark, f"{root}/messages", MESSAGES + ", batch long").drop("batch", "thread_id")
    versions.replace(messages.join(assign_threads(messages, **limits), "dedup_key", "left"), f"{root}/threaded")
    return versions.read(spark, f"{root}/threaded")


THREAD_LOG = "dedup_key string, thread_id string, batch long"


def current_threads(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(dedup_key, thread_id) as the last batch that changed them says."""
    log = read_if_there(spark, f"{root}/thread_log", THREAD_LOG)
    log = log if before is None else log.where(F.col("batch") < before)
    return log.groupBy("dedup_key").agg(F.max_by("thread_id", "batch").alias("thread_id"))


def rethread_batch(spark: SparkSession, root: str, batch_id: int, **limits) -> DataFrame:
    """Threads after a batch of ``ingest``: only threads that its messages can change are put
    together again, and written as the batch's entry of a log. Run again, it replaces its entry."""
    every = read_if_there(spark, f"{root}/messages", MESSAGES + ", batch long")
    known, new = every.where(F.col("batch") < batch_id).drop("batch"), every.where(F.col("batch") == batch_id).drop("batch")
    changed = update_threads(known, current_threads(spark, root, batch_id), new, **limits)
    changed.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/thread_log/batch={batch_id}")
    return spark.read.parquet(f"{root}/thread_log/batch={batch_id}")


def reindex_batch(spark: SparkSession, root: str, batch_id: int, strategy: str = "thread_aware", text: Column | None = None, order: tuple[str, ...] = ("date_utc",), **how) -> None:
    """Chunks of the threads that ``rethread_batch`` changed, put into the segmented index at
    ``root/segments``; the rest of the index is not touched."""
    messages = read_if_there(spark, f"{root}/messages", MESSAGES + ", batch long").where(F.col("batch") <= batch_id).drop("batch")
    after = read_if_there(spark, f"{root}/thread_log", THREAD_LOG).where(F.col("batch") == batch_id).drop("batch")
    changes = chunk_changes(messages, current_threads(spark, root, batch_id), after, strategy, F.col("body_new") if text is None else text, list(order), **how)
    segments.apply(changes, f"{root}/segments")


def reindex(spark: SparkSession, root: str, strategy: str = "thread_aware", text: Column | None = None, order: tuple[str, ...] = ("date_utc",), **how) -> str:
    """Chunks and lexical index of the threaded messages; the folder of the index. An index
    whose chunks did not change stays as it is."""
    messages = versions.read(spark, f"{root}/threaded")
    chunks = chunked(strategy, messages, F.col("body_new") if text is None else text, list(order), **how)
    versions.replace(chunks, f"{root}/chunks")
    kept = versions.read(spark, f"{root}/chunks").select(F.col("chunk_id").alias("id"), "text")
    return load_or_build(kept, f"{root}/index")
