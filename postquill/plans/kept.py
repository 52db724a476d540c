"""Queries over what is kept and carried on: segments, threads, sketches, streams, counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import observed, segments, sketches, threads
from ..session import materialise, shared_dir, table
from ..streaming import pairs, state
from .archive import _COMPONENTS, _COPIES, _HALF_DAY, _copies
from .base import event_messages, query
from .retrieval import DEPTH, _bm25, _questions


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


# -- segmented index

_FINAL = """texts AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 AND doc_id % 11 <> 0 THEN coalesce(text, '') || ' ' || coalesce(source, '') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 3 = 0)"""


@query("WITH " + _FINAL + "," + _bm25("texts") + " SELECT qid, id, score, rank FROM bm")
def segmented_search(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of inserts, changed texts, deletions, and some of the deleted back again:
    the run is that of an index built from what is left."""
    root, n = _root(spark, "segments"), F.col("doc_id")
    docs = table(spark, sf, "documents").select(n, n.cast("string").alias("id"), "text", "source")
    later = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("source", F.lit("")))
    batches = (
        docs.where("doc_id % 2 = 0").withColumn("gone", F.lit(False)), docs.where("doc_id % 2 = 1").withColumn("gone", F.lit(False)),
        docs.where("doc_id % 7 = 0").withColumns({"text": later, "gone": F.lit(False)}), docs.where("doc_id % 11 = 0").withColumn("gone", F.lit(True)),
        docs.where("doc_id % 33 = 0").withColumn("gone", F.lit(False)),
    )
    for batch in batches:
        segments.apply(batch.select("id", "text", "gone"), root, fan=2)
    return segments.scan(spark, root, _questions(spark, sf), DEPTH).drop("run")


def _block_max(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    root = _root(spark, "segments")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(False).alias("gone"))
    segments.apply(docs, root)
    return segments.search(spark, root, _questions(spark, sf), 10)


@query("WITH texts AS (SELECT doc_id::VARCHAR AS id, text FROM documents)," + _bm25("texts") + " SELECT qid, id, score, rank FROM bm WHERE rank <= 10")
def bm25_block_max(spark: SparkSession, sf: str) -> DataFrame:
    return _block_max(spark, sf)[0].drop("run")


@query()
def block_max_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Postings that each question reads, of all of its terms."""
    return _block_max(spark, sf)[1]


# -- threads carried on

_BATCHES = (3, 1, 0, 2)


@query(_COMPONENTS + " SELECT dedup_key, thread_id FROM th")
def incremental_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Messages in four batches that cut through all threads: later ones join threads that were apart."""
    every = event_messages(spark, sf).withColumn("__batch", F.col("dedup_key").cast("long") % 4)
    known, found = every.limit(0).drop("__batch"), None
    for batch in _BATCHES:
        new = every.where(F.col("__batch") == batch).drop("__batch")
        before = found if found is not None else known.select("dedup_key", F.col("dedup_key").alias("thread_id"))
        changed = materialise(threads.update_threads(known, before, new, window_seconds=_HALF_DAY), "threads-changed")
        found = materialise(before.join(changed.select("dedup_key"), "dedup_key", "left_anti").unionByName(changed), "threads")
        known = known.unionByName(new)
    return found


# -- sketches

_WEEK = "date_trunc('week', ts::TIMESTAMP)::DATE"


@query(f"SELECT {_WEEK} AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close, true AS q90_close FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def sketched_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks merged from the sketches of their days, held against exact counts and ranks: users
    within 5 % (3 standard errors) or one, quantiles within 3 % of the rows or one row."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = materialise(sketches.daily(e, "ts", ["event_type"], "user_id", "value"), "sketch-days")
    week = F.to_date(F.date_trunc("week", "day"))
    found = materialise(sketches.merged(days, week, ["event_type"]), "sketch-weeks")
    rows = e.withColumn("day", F.to_date("ts"))
    exact = rows.groupBy(week.alias("window"), "event_type").agg(F.countDistinct("user_id").alias("users"))
    out = found.join(exact, ["window", "event_type"])
    for q, name in ((0.5, "median_close"), (0.9, "q90_close")):
        errors = sketches.rank_errors(found, rows, week, ["event_type"], "value", q).withColumnRenamed("rank_error", name)
        out = out.join(errors, ["window", "event_type"])
    near = lambda c: (F.col(c) <= F.greatest(F.lit(0.03), 1 / F.col("n"))).alias(c)
    return out.select(F.col("window").alias("week"), "event_type", "n", "users", (F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), 0.05 * F.col("users"))).alias("users_close"), near("median_close"), near("q90_close"))


# -- counters gathered on the way


@query("WITH " + _COPIES + " SELECT (SELECT count(*) FROM cp) AS n_parsed, (SELECT count(*) FROM cp) - count(*) AS n_dupe, count(*) FILTER (bulk) AS n_bulk, count(*) FILTER (NOT bulk) AS n_kept, count(*) FILTER (NOT bulk) AS n_written FROM fc")
def observed_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel's counters from the one pass that writes what is kept."""
    counted = observed.filtered(_copies(spark, sf))
    kept = materialise(counted.rows.select("dedup_key", "source_path"), "observed")
    made = observed.funnel(counted.counters())
    return kept.agg(*[F.lit(v).cast("long").alias(k) for k, v in made.items()], F.count(F.lit(1)).alias("n_written"))


# -- streams over a table, run until it is read

def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of files."""
    e = table(spark, sf, "events")
    e = e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").where("ts IS NOT NULL")
    root = _root(spark, "stream")
    e.write.parquet(root)
    return spark.readStream.schema(e.schema).parquet(root)


def _ran(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives out until its source is read, as a table."""
    root = _root(spark, "stream-out")
    stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first FROM events WHERE ts IS NOT NULL) WHERE ts = first GROUP BY user_id")
def stream_first_copies(spark: SparkSession, sf: str) -> DataFrame:
    """First events of users, by state that outlives a batch: the limit is longer than the table's time."""
    rows = _stream(spark, sf).withColumn("order_key", F.concat_ws(":", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.format_string("%020d", "event_id")))
    return _ran(spark, state.first_copies(rows, "user_id", "order_key", "ts", 3650 * 86400, "3650 days")).select("user_id", "event_id")


_PAIRED = """WITH e AS (SELECT *, (SELECT max(ts) FROM events) AS latest FROM events WHERE ts IS NOT NULL), l AS (SELECT * FROM e WHERE event_id % 2 = 0), r AS (SELECT * FROM e WHERE event_id % 2 = 1)"""


@query(_PAIRED + " SELECT l.event_id, r.event_id AS next_event_id FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 6 HOUR WHERE r.event_id IS NOT NULL OR l.ts < l.latest - INTERVAL 7 DAY")
def stream_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events and those that follow within 6 hours, from two streams. Rows without a partner come
    when the watermark (5 days behind here) allows; those of the last 7 days are left out on both sides."""
    left, right = _stream(spark, sf).where("event_id % 2 = 0"), _stream(spark, sf).where("event_id % 2 = 1")
    out = _ran(spark, pairs.followed(left, right, "user_id", "ts", "6 HOURS", "5 days"))
    latest = table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("__latest"))
    kept = out.join(latest, F.col("next_event_id").isNotNull() | (F.col("ts") < F.col("__latest") - F.expr("INTERVAL 7 DAYS")))
    return kept.select("event_id", "next_event_id")
