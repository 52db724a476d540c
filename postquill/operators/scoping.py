"""Which messages a job looks at: scopes, filters and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPED_CLASSES = ("temporal", "entity")
RECENT_DAYS = 14


def with_mapped(rows: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of ``mapping`` (one row a key), null where it has none."""
    return rows.drop(value).join(mapping.select(key, value), key, "left")


def eval_scoped(messages: DataFrame, questions: DataFrame, classes: tuple[str, ...] = SCOPED_CLASSES) -> DataFrame:
    """Messages of the whole threads that the labelled messages of some query classes are in."""
    wanted = questions.where(F.col("query_class").isin(*classes)).select(F.explode("relevant_message_ids").alias("dedup_key")).distinct()
    threads = messages.join(wanted, "dedup_key", "left_semi").select("thread_id").distinct()
    return messages.join(threads, "thread_id", "left_semi").select(*messages.columns)


def since(messages: DataFrame, cutoff: Column | None = None, limit: int | None = None) -> DataFrame:
    """Dated messages from ``cutoff`` on, and of those the first ``limit`` by date and key."""
    rows = messages if cutoff is None else messages.where(F.col("date_utc") >= cutoff)
    return rows if limit is None else rows.orderBy(F.col("date_utc").asc_nulls_last(), "dedup_key").limit(limit)


def recent(messages: DataFrame, now: Column, days: int = RECENT_DAYS) -> DataFrame:
    return messages.where(F.col("date_utc") >= now - F.make_interval(days=F.lit(days)))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """``rows`` with ``value`` of their key, ``default`` where it is missing or empty."""
    found = with_mapped(rows, table, key, value)
    return found.withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit(default)))


def message_texts(chunks: DataFrame) -> DataFrame:
    """dedup_key and its chunks' texts in order, joined by spaces."""
    parts = F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("text", F.lit("")).alias("text"))))
    return chunks.groupBy("dedup_key").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def owned(rows: DataFrame, user: str) -> DataFrame:
    """One user's rows; the filter reaches the scan."""
    return rows.where(F.col("user_id") == user)


def conversation_turns(turns: DataFrame, conversations: DataFrame, user: str) -> DataFrame:
    """The turns of a user's conversations (id, user_id); nobody else's are seen."""
    return turns.join(owned(conversations, user).select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")


def holds_marker(messages: DataFrame, markers: tuple[str, ...], column: str = "sender") -> bool:
    """Whether any row holds one of the markers, for a guard before a corpus is shown; rows
    are read until the first that does."""
    has = [F.contains(F.coalesce(column, F.lit("")), F.lit(m)) for m in markers]
    return not messages.where(F.greatest(*has, F.lit(False)) if has else F.lit(False)).isEmpty()


def bound(statement: str, values: dict, **rows: DataFrame) -> DataFrame:
    """The rows of a SQL statement over ``rows`` (named in it in braces) with ``values`` bound to
    its markers (``:name``). Values are literals of the plan and never part of the text, so
    what a user types cannot change the statement; a null is bound as null."""
    spark = next(iter(rows.values())).sparkSession
    return spark.sql(statement, args=values, **rows)
