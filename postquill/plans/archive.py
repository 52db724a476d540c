"""Queries: corpus building, threads, sampling, dates, windows, incremental upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.predicates import commitment_problems
from ..operators import corpus, incremental, sampling, threads
from ..session import table
from ..streaming import windows
from .base import EVENT_MESSAGES, document_messages, event_messages, query, rows

# -- corpus

_DOCMSG = r"""dm AS (SELECT *, doc_id::VARCHAR AS message_id, ['Re: ', 'FW: Fwd: ', '', 'AW[2]: ', ' sv : '][doc_id % 5 + 1] || substr(text, 1, 20) AS subject FROM documents)"""
_KEYED = _DOCMSG + ", ck AS (SELECT *, 'sha256:' || sha256(concat_ws(chr(0), source, lang, '', subject, 'None', substr(text, 1, 8000))) AS dedup_key FROM dm)"


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    m = document_messages(spark, sf)
    return m.withColumn("dedup_key", text.content_key("sender", "recipients", "cc", "subject", "date_utc", "body"))


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose subject does not tell copies apart."""
    m = document_messages(spark, sf).withColumn("subject", F.lit("s")).withColumn("sender", F.lit("a"))
    return m.withColumn("dedup_key", text.content_key("sender", "recipients", "cc", "subject", "date_utc", "body"))


_COPIES = "cp AS (SELECT doc_id, printf('%012d', doc_id) AS source_path, 'sha256:' || sha256(concat_ws(chr(0), 'a', lang, '', 's', 'None', substr(text, 1, 8000))) AS dedup_key, doc_id % 97 = 0 OR length(trim(text)) < 20 AS bulk FROM documents), fc AS (SELECT dedup_key, min(source_path) AS source_path, arg_min(bulk, source_path) AS bulk FROM cp GROUP BY dedup_key)"


@query("WITH " + _KEYED + " SELECT message_id, dedup_key FROM ck")
def content_identity(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(spark, sf).select("message_id", "dedup_key")


@query("WITH " + _COPIES + " SELECT dedup_key, source_path FROM fc")
def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.first_copies(_copies(spark, sf)).select("dedup_key", "source_path")


@query("WITH " + _COPIES + " SELECT dedup_key, source_path FROM fc WHERE NOT bulk")
def dedup_and_filter(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.dedup_and_filter(_copies(spark, sf)).select("dedup_key", "source_path")


@query("WITH " + _COPIES + " SELECT (SELECT count(*) FROM cp) AS n_parsed, (SELECT count(*) FROM cp) - count(*) AS n_dupe, count(*) FILTER (bulk) AS n_bulk, count(*) FILTER (NOT bulk) AS n_kept FROM fc")
def funnel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.funnel(_copies(spark, sf))


_EV = "WITH " + EVENT_MESSAGES
_BLAST = 8


@query(_EV + f" SELECT sender, subject_norm, count(*) AS n FROM msgs WHERE subject_norm <> '' GROUP BY ALL HAVING count(*) >= {_BLAST}")
def recurring_blasts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.recurring_blasts(event_messages(spark, sf), _BLAST)


@query(_EV + f" SELECT dedup_key FROM (SELECT dedup_key, count(*) OVER (PARTITION BY sender, subject_norm) AS n FROM msgs) WHERE n < {_BLAST}")
def drop_blasts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.drop_blasts(event_messages(spark, sf), _BLAST).select("dedup_key")


@query("WITH " + _DOCMSG + r" SELECT message_id, lower(trim(regexp_replace(subject, '(?i)^\s*(?:(?:re|fw|fwd|aw|sv)\s*(?:\[\d+\])?\s*:\s*)+', ''))) AS subject_norm FROM dm")
def normalize_subject(spark: SparkSession, sf: str) -> DataFrame:
    return document_messages(spark, sf).select("message_id", text.normalize_subject("subject").alias("subject_norm"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def late_materialize(spark: SparkSession, sf: str) -> DataFrame:
    light = table(spark, sf, "labels").where("quality = 1")
    return corpus.late_materialise(light, table(spark, sf, "documents"), "doc_id").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query(_EV + " SELECT sender, count(*) AS n FROM (SELECT * FROM msgs WHERE dedup_key < '000000000300' UNION ALL SELECT * FROM msgs WHERE dedup_key >= '000000000200') GROUP BY sender")
def merge_union(spark: SparkSession, sf: str) -> DataFrame:
    m = event_messages(spark, sf)
    old, new = m.where("dedup_key < '000000000300'").withColumn("thread_id", F.lit("t")), m.where("dedup_key >= '000000000200'")
    return corpus.merge_messages(old, new).groupBy("sender").agg(F.count(F.lit(1)).alias("n"))


@query("WITH d AS (SELECT ts::DATE AS day FROM events ORDER BY ts), n AS (SELECT least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) AS i FROM d) SELECT day AS corpus_end FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS r FROM d), n WHERE r = i")
def corpus_end_date(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_end(event_messages(spark, sf))


# -- threads

_HALF_DAY = 43200
_EDGES = _EV + f""", bk AS (SELECT *, count(*) OVER (PARTITION BY subject_norm) AS n FROM msgs WHERE length(subject_norm) >= 4),
lg AS (SELECT dedup_key AS b, lag(dedup_key) OVER w AS a, date_utc, lag(date_utc) OVER w AS before, sender, lag(sender) OVER w AS whom FROM bk WHERE n BETWEEN 2 AND 50 WINDOW w AS (PARTITION BY subject_norm ORDER BY date_utc, dedup_key)),
ed AS (SELECT a, b FROM lg WHERE a IS NOT NULL AND date_utc - before <= INTERVAL {_HALF_DAY} SECOND AND sender = whom)"""
_COMPONENTS = _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + """, un AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
walk(id, root) AS (SELECT dedup_key, dedup_key FROM msgs UNION SELECT un.b, walk.root FROM walk JOIN un ON un.a = walk.id),
comp AS (SELECT id, min(root) AS c FROM walk GROUP BY id),
th AS (SELECT m.dedup_key, first_value(m.dedup_key) OVER (PARTITION BY comp.c ORDER BY m.date_utc, m.dedup_key) AS thread_id FROM msgs m JOIN comp ON comp.id = m.dedup_key)"""


@query(_EDGES + " SELECT a, b FROM ed")
def thread_edges(spark: SparkSession, sf: str) -> DataFrame:
    return threads.subject_edges(event_messages(spark, sf), _HALF_DAY)


@query(_COMPONENTS + " SELECT dedup_key, thread_id FROM th")
def thread_components(spark: SparkSession, sf: str) -> DataFrame:
    return threads.assign_threads(event_messages(spark, sf), window_seconds=_HALF_DAY)


@query(_COMPONENTS + """, sz AS (SELECT thread_id, count(*) AS n FROM th GROUP BY thread_id)
SELECT sum(n)::BIGINT AS messages, count(*) AS threads, count(*) FILTER (n > 1) AS multi_message_threads, count(*) FILTER (n = 1) AS singletons, 0::BIGINT AS linked_by_header,
 (sum(n) - count(*))::BIGINT AS linked_by_heuristic, (SELECT count(*) FROM (SELECT subject_norm FROM msgs GROUP BY 1 HAVING count(*) > 50)) AS oversized_buckets_skipped, max(n) AS largest_thread FROM sz""")
def thread_stats(spark: SparkSession, sf: str) -> DataFrame:
    return threads.thread_stats(event_messages(spark, sf), window_seconds=_HALF_DAY)


_TARGET = 150


@query(f"""WITH th AS (SELECT conv_id AS thread_id, count(*) AS n, CASE WHEN count(*) <= 1 THEN '0:singleton' WHEN count(*) <= 5 THEN '0:small' WHEN count(*) <= 20 THEN '0:medium' ELSE '0:large' END AS stratum, md5('7' || conv_id) AS lot FROM conversations GROUP BY conv_id),
tot AS (SELECT sum(n) AS total FROM th),
pl AS (SELECT th.*, total, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY lot, thread_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {_TARGET} * sum(n) OVER (PARTITION BY stratum) / total AS taken FROM th, tot),
f AS (SELECT * FROM pl WHERE taken OR total <= {_TARGET}),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY lot, thread_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pl WHERE NOT taken AND total > {_TARGET})
SELECT thread_id, n, stratum FROM f UNION ALL SELECT thread_id, n, stratum FROM r WHERE before + (SELECT coalesce(sum(n), 0) FROM f) < {_TARGET}""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.lit(None).cast("timestamp").alias("date_utc"))
    return sampling.sample_threads(turns, _TARGET, "7")


# -- dates: every case with the answer worked out by hand from a calendar


@query("""SELECT o_orderkey, n, (SELECT list(d ORDER BY d) FROM (SELECT unnest(generate_series(o_orderdate::DATE + 1, o_orderdate::DATE + 40, INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6)[n] AS due
 FROM (SELECT o_orderkey, o_orderdate, (o_orderkey % 9 + 1)::INT AS n FROM orders)""")
def business_days(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("n", (F.col("o_orderkey") % 9 + 1).cast("int"))
    return o.select("o_orderkey", "n", dates.add_business_days(F.to_date("o_orderdate"), F.col("n")).alias("due"))


_COMMIT = "cm AS (SELECT o_orderkey::VARCHAR AS message_id, o_orderdate::DATE AS due_at, o_totalprice / 1e6 AS confidence, o_custkey AS user_id FROM orders)"


def _commitments(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("message_id"), F.to_date("o_orderdate").alias("due_at"), (F.col("o_totalprice") / F.lit(1e6)).alias("confidence"), F.col("o_custkey").alias("user_id"))


@query("WITH " + _COMMIT + " SELECT message_id, due_at, round(confidence, 6) AS confidence FROM cm WHERE due_at BETWEEN DATE '1997-03-03' AND DATE '1997-03-09' ORDER BY due_at, confidence DESC, message_id LIMIT 50")
def window_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """What is due next week, asked on a Tuesday: the window comes from the question."""
    q = rows(spark, "(VALUES ('what is due next week', DATE '1997-02-25')) AS t(question, as_of)").withColumn("w", dates.window("question", "as_of"))
    due = _commitments(spark, sf).join(F.broadcast(q.select("w.start", "w.end")), F.col("due_at").between(F.col("start"), F.col("end")))
    return due.orderBy("due_at", F.desc("confidence"), "message_id").limit(50).select("message_id", "due_at", F.round("confidence", 6).alias("confidence"))


@query("WITH " + _COMMIT + " SELECT count(*) AS n, min(due_at) AS earliest, max(due_at) AS latest FROM cm WHERE due_at BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def count_window(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.window_count(_commitments(spark, sf), F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))


@query("SELECT event_id, (ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE)::DATE AS day FROM events WHERE (ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE)::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'")
def messages_by_local_day(spark: SparkSession, sf: str) -> DataFrame:
    day = dates.local_day(F.col("ts").cast("timestamp"), F.lit("Asia/Kolkata"))
    return table(spark, sf, "events").withColumn("day", day).where("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'").select("event_id", "day")


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN ['no message'] ELSE [] END || CASE WHEN vec_id % 11 = 0 THEN ['empty text'] ELSE [] END || CASE WHEN label % 4 = 0 THEN ['unknown kind'] ELSE [] END
 || CASE WHEN vec_id % 13 = 0 THEN ['unknown direction'] ELSE [] END || CASE WHEN vec_id % 5 = 0 THEN ['confidence out of range'] ELSE [] END || CASE WHEN vec_id % 6 = 2 THEN ['due date without a phrase'] ELSE [] END AS problems FROM embeddings""")
def commitment_validation(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("vec_id")
    kinds = F.array(*map(F.lit, ("gift", "review", "meeting", "other")))
    made = table(spark, sf, "embeddings").select(
        "vec_id", F.when(n % 7 == 0, "").otherwise("m").alias("message_id"), F.when(n % 11 == 0, " ").otherwise("send it").alias("text"), F.get(kinds, (F.col("label") % 4).cast("int")).alias("kind"),
        F.when(n % 13 == 0, "third_party").when(n % 2 == 0, "mutual").otherwise("unclear").alias("direction"), F.when(n % 5 == 0, 1.5).otherwise(0.5).alias("confidence"),
        F.when(n % 3 == 2, F.lit("2001-11-02").cast("date")).alias("due_at"), F.when(n % 2 == 1, "by friday").otherwise("").alias("due_phrase"),
    )
    return made.select("vec_id", commitment_problems().alias("problems"))


# -- incremental upkeep

_KEYS = _EV + ", k AS (SELECT *, (dedup_key::BIGINT % 700)::VARCHAR AS key FROM msgs)"


def _keyed_events(spark: SparkSession, sf: str) -> DataFrame:
    m = event_messages(spark, sf)
    return m.withColumn("key", (F.col("dedup_key").cast("long") % 700).cast("string")).withColumn("source_path", F.col("dedup_key"))


@query(_KEYS + " SELECT key, min(dedup_key) AS dedup_key FROM k WHERE dedup_key >= '000000000500' AND key NOT IN (SELECT key FROM k WHERE dedup_key < '000000000500') GROUP BY key")
def incremental_dedup(spark: SparkSession, sf: str) -> DataFrame:
    m = _keyed_events(spark, sf)
    new = incremental.insert_ignore(m.where("dedup_key < '000000000500'"), m.where("dedup_key >= '000000000500'"), ["key"], F.col("dedup_key"))
    return new.select("key", "dedup_key")


@query(_KEYS + """, old AS (SELECT key, max(dedup_key) AS dedup_key FROM k WHERE dedup_key < '000000000500' GROUP BY key), new AS (SELECT key, max(dedup_key) AS dedup_key FROM k WHERE dedup_key >= '000000000500' GROUP BY key)
SELECT key, coalesce(new.dedup_key, old.dedup_key) AS dedup_key FROM old FULL JOIN new USING (key)""")
def upsert_commitments(spark: SparkSession, sf: str) -> DataFrame:
    m = _keyed_events(spark, sf).select("key", "dedup_key")
    old = m.where("dedup_key < '000000000500'").groupBy("key").agg(F.max("dedup_key").alias("dedup_key"))
    return incremental.upsert(old, m.where("dedup_key >= '000000000500'"), ["key"], F.col("dedup_key"))


@query(_KEYS + " SELECT dedup_key FROM k WHERE sender::BIGINT % 3 <> 0")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    m = event_messages(spark, sf)
    gone = m.select("sender").distinct().where("cast(sender AS long) % 3 = 0")
    return incremental.cascade_delete(m, gone, "sender").select("dedup_key")


_SYNC = _EV + ", st AS (SELECT sender AS user_id, max(date_utc) AS last_sync_utc FROM msgs GROUP BY sender)"


@query(_SYNC + f", jb AS (SELECT DISTINCT sender AS user_id FROM msgs WHERE sender::BIGINT % 4 = 0) SELECT user_id FROM st WHERE TIMESTAMP '2024-01-30 12:00:00' - last_sync_utc >= INTERVAL 15 MINUTE AND user_id NOT IN (SELECT user_id FROM jb)")
def schedule_due_syncs(spark: SparkSession, sf: str) -> DataFrame:
    m = event_messages(spark, sf)
    state = m.groupBy(F.col("sender").alias("user_id")).agg(F.max("date_utc").alias("last_sync_utc")).withColumn("status", F.lit("ready"))
    jobs = m.where("cast(sender AS long) % 4 = 0").select(F.col("sender").alias("user_id"), F.lit("sync").alias("type"), F.lit("queued").alias("status"))
    return incremental.due_syncs(state, jobs, F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query(_SYNC + " SELECT user_id FROM st WHERE user_id::BIGINT % 2 = 0 AND user_id::BIGINT % 24 = 12 AND last_sync_utc::DATE < DATE '2024-01-30'")
def due_digests(spark: SparkSession, sf: str) -> DataFrame:
    m = event_messages(spark, sf)
    s = m.groupBy(F.col("sender").alias("user_id")).agg(F.max("date_utc").alias("last_sent_utc"))
    user = F.col("user_id").cast("long")
    return incremental.due_digests(s.withColumns({"enabled": user % 2 == 0, "send_hour_utc": user % 24}), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query("WITH " + _COMMIT + f""", so AS (SELECT user_id, count(*) AS due_soon FROM cm WHERE due_at BETWEEN DATE '1997-03-01' AND DATE '1997-03-08' GROUP BY user_id),
pe AS (SELECT o_custkey AS user_id, count(*) AS pending FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
la AS (SELECT c_custkey AS user_id, TIMESTAMP '1997-02-25' AS since FROM customer WHERE c_custkey % 2 = 0),
fr AS (SELECT o_custkey AS user_id, count(*) AS new_messages FROM orders o LEFT JOIN la ON la.user_id = o.o_custkey WHERE o_orderdate > coalesce(since, TIMESTAMP '1997-03-01 06:00:00' - INTERVAL 1 DAY) GROUP BY 1)
SELECT user_id, coalesce(due_soon, 0) AS due_soon, coalesce(pending, 0) AS pending, coalesce(new_messages, 0) AS new_messages FROM so FULL JOIN pe USING (user_id) FULL JOIN fr USING (user_id)""")
def digest_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pending = o.select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    messages = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("date_utc"))
    last = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("1997-02-25").cast("timestamp").alias("created_at"))
    return incremental.digest(_commitments(spark, sf), pending, messages, last, F.lit("1997-03-01 06:00:00").cast("timestamp"))


# -- event-time windows, beyond the archive's own needs


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.tumbling(e, "ts", "1 hour", "event_type", "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) - i * INTERVAL 1 HOUR AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(i) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.sliding(e, "ts", "2 hours", "1 hour", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("ts IS NOT NULL AND user_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.sessions(e, "ts", "6 hours", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")
