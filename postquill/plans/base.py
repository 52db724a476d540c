"""Relations of the library as views of the test tables, and a registry decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with the SQL it must agree with."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Query vectors: every id divisible by 20, against all vectors.
EVERY = "vec_id % 20 = 0"


def query_number():
    """Number of a query vector among all of them, from 0."""
    return F.floor(F.col("qid") / 20).cast("long")


def rows(spark: SparkSession, values: str) -> DataFrame:
    """A literal table, written so that both engines read it."""
    return spark.sql(f"SELECT * FROM {values}")


def event_messages(spark: SparkSession, sf: str) -> DataFrame:
    """events as light messages: sender is the user, recipients the event type."""
    e = table(spark, sf, "events")
    return e.select(
        F.format_string("%012d", "event_id").alias("dedup_key"), F.lit("").alias("message_id"), F.lit("").alias("in_reply_to"), F.lit("").alias("references"),
        F.concat_ws("-", "event_type", F.floor(F.col("user_id") / 3).cast("long").cast("string")).alias("subject_norm"), F.col("user_id").cast("string").alias("sender"),
        F.lit("").alias("recipients"), F.lit("").alias("cc"), F.col("ts").cast("timestamp").alias("date_utc"),
    )


EVENT_MESSAGES = """
msgs AS (SELECT printf('%012d', event_id) AS dedup_key, event_type || '-' || (user_id // 3)::VARCHAR AS subject_norm,
         user_id::VARCHAR AS sender, ts::TIMESTAMP AS date_utc FROM events)
"""


def document_messages(spark: SparkSession, sf: str) -> DataFrame:
    """documents as messages: sender is the source, recipients the language."""
    d = table(spark, sf, "documents")
    prefix = F.element_at(F.array(*map(F.lit, ("Re: ", "FW: Fwd: ", "", "AW[2]: ", " sv : "))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        F.col("doc_id").cast("string").alias("message_id"), F.col("source").alias("sender"), F.col("lang").alias("recipients"), F.lit("").alias("cc"),
        F.concat(prefix, F.substring("text", 1, 20)).alias("subject"), F.lit(None).cast("timestamp").alias("date_utc"), F.col("text").alias("body"), F.col("text").alias("body_new"),
        (F.col("doc_id") % 97 == 0).alias("has_list_unsubscribe"), F.format_string("%012d", "doc_id").alias("source_path"),
    )


def label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(EVERY).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
