"""Queries: date arms over batches of questions, merged results, threads as text."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates
from ..operators import answering, asking, lexical, scoping
from ..session import table
from .base import query, rows
from .cases import _pattern, dealt, dealt_sql
from .retrieval import _bm25

_ASKED = "(VALUES (1, 'what is due next week', DATE '1997-02-25'), (2, 'what came in this month', DATE '1996-05-20'), (3, 'why', DATE '1996-05-20'), (4, 'anything overdue', DATE '1995-02-01'), (5, 'today', DATE '1998-08-02')) AS t(qid, query, as_of)"
_WIN = "w AS (SELECT * FROM (VALUES (1, DATE '1997-03-03', DATE '1997-03-09'), (2, DATE '1996-05-01', DATE '1996-05-31'), (4, DATE '1900-01-01', DATE '1995-02-01'), (5, DATE '1998-08-02', DATE '1998-08-02')) AS t(qid, s, e))"
_COMM = "cm AS (SELECT o_orderkey::VARCHAR AS message_id, o_orderpriority AS text, o_orderdate::DATE AS due_at, o_totalprice / 1e6 AS confidence FROM orders)"


def _commitments(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("message_id"), F.col("o_orderpriority").alias("text"), F.to_date("o_orderdate").alias("due_at"), (F.col("o_totalprice") / F.lit(1e6)).alias("confidence"))


@query(f"WITH {_WIN}, {_COMM} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY due_at, confidence DESC, message_id, text)::INT AS rank, message_id, due_at FROM w JOIN cm ON due_at BETWEEN s AND e QUALIFY rank <= 50")
def sql_arm(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = answering.commitment_arm(rows(spark, _ASKED), _commitments(spark, sf))
    return hits.select("qid", "rank", "message_id", "due_at")


@query(f"""WITH {_WIN}, {_COMM}, c AS (SELECT qid, count(*) AS n FROM w JOIN cm ON due_at BETWEEN s AND e GROUP BY qid)
SELECT a.qid, coalesce(n, 0) AS n, CASE WHEN w.qid IS NULL THEN 'the question names no time window' ELSE coalesce(n, 0) || ' due ' || s || ' to ' || e END AS note
FROM (VALUES (1), (2), (3), (4), (5)) a(qid) LEFT JOIN w USING (qid) LEFT JOIN c USING (qid)""")
def sql_arm_notes(spark: SparkSession, sf: str) -> DataFrame:
    return answering.commitment_arm(rows(spark, _ASKED), _commitments(spark, sf))[1]


_ORDERS = "ms AS (SELECT o_orderkey::VARCHAR AS dedup_key, o_orderdate::DATE AS day, o_orderkey % 3 = 0 AS imp, o_orderkey % 5 = 0 AS bulk FROM orders)"


def _arrivals(spark: SparkSession, sf: str):
    o = table(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("dedup_key"), F.col("o_orderdate").cast("timestamp").alias("date_utc"))
    important = o.where("o_orderkey % 3 = 0").select(F.col("dedup_key").alias("message_id"))
    return answering.arrival_arm(rows(spark, _ASKED), o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), important)


@query(f"""WITH {_WIN}, {_ORDERS} SELECT w.qid, count(*) FILTER (NOT bulk) AS received, count(*) FILTER (NOT bulk AND imp) AS important, count(*) FILTER (NOT bulk AND NOT imp) AS general, count(*) FILTER (bulk) AS bulk
FROM w LEFT JOIN ms ON day BETWEEN s AND e GROUP BY w.qid""")
def date_arm_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _arrivals(spark, sf)[1]


@query(f"""WITH {_WIN}, {_ORDERS}, a AS (SELECT qid, dedup_key, row_number() OVER (PARTITION BY qid ORDER BY day DESC, dedup_key)::INT AS rank FROM w JOIN ms ON day BETWEEN s AND e WHERE NOT bulk QUALIFY rank <= 50) SELECT qid, rank, dedup_key FROM a""")
def date_arm_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _arrivals(spark, sf)[0].select("qid", "rank", "dedup_key")


@query(f"""WITH {_WIN}, {_COMM}, s1 AS (SELECT qid, message_id, row_number() OVER (PARTITION BY qid ORDER BY due_at, confidence DESC, message_id, text) AS rank FROM w JOIN cm ON due_at BETWEEN s AND e QUALIFY rank <= 50),
m AS (SELECT qid, message_id, 0 AS arm, rank FROM s1 WHERE rank <= 5 UNION ALL SELECT qid, message_id, 1, rank FROM s1 WHERE rank BETWEEN 3 AND 8 UNION ALL SELECT qid, message_id, 2, 51 - rank FROM s1),
f AS (SELECT qid, message_id, min((arm, rank)) AS p FROM m GROUP BY ALL)
SELECT qid, message_id, p[1]::INT AS arm, row_number() OVER (PARTITION BY qid ORDER BY p, message_id)::INT AS position FROM f QUALIFY position <= 12""")
def merge_arms(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = answering.commitment_arm(rows(spark, _ASKED), _commitments(spark, sf))
    return answering.merge_arms(hits.where("rank <= 5"), hits.where("rank BETWEEN 3 AND 8"), hits.withColumn("rank", 51 - F.col("rank")), 12)


@query(r"""WITH m AS (SELECT conv_id, '[unknown] ' || role || ' -> ' || chr(10) || 'Subject: s' || chr(10) || substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 500) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY printf('%06d', turn)) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id AS thread_id, md5(substr(string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p), 1, 2200)) AS thread FROM m WHERE n <= 6 OR p <= 2 OR p > n - 4 GROUP BY conv_id""")
def rendered_threads(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.lit(None).cast("timestamp").alias("date_utc"), F.format_string("%06d", "turn").alias("dedup_key"), F.col("role").alias("sender"),
        F.lit("").alias("recipients"), F.lit("s").alias("subject"), F.col("text").alias("body_new"),
    )
    return answering.rendered_threads(t).select("thread_id", F.md5("thread").alias("thread"))


@query("SELECT conv_id AS thread_id, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars, DATE '2001-06-01' AS as_of FROM conversations GROUP BY conv_id HAVING count(*) >= 2 AND sum(length(coalesce(text, ''))) > 600 AND bool_or(regexp_matches(coalesce(text, ''), 'th'))")
def substantial_threads(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.lit(None).cast("timestamp").alias("date_utc"), F.col("text").alias("body_new"))
    return answering.substantial_threads(t, "th")


# -- questions answered by route: one for each item of benchmark

_OPENINGS = ["what is due next week about ", "how many messages came in this month: ", "explain ", "", "list all that is due this quarter ", "what is due today: "]
_BY_ROUTE = f"""WITH qq AS (SELECT item_id AS qid, item_id % 6 AS o, {dealt_sql(_OPENINGS, "item_id")} || text AS query, DATE '1996-01-01' + (item_id * 3)::INT AS d FROM benchmark),
ro AS (SELECT *, coalesce(CASE WHEN trim(query) = '' THEN NULL WHEN regexp_matches(query, {_pattern(predicates.AGGREGATE)}) THEN 'sql' WHEN regexp_matches(query, {_pattern(predicates.TEMPORAL)}) THEN
  CASE WHEN regexp_matches(query, {_pattern(predicates.SEMANTIC)}) OR regexp_matches(query, {_pattern(predicates.ENTITY)}) THEN 'both' ELSE 'sql' END
  WHEN regexp_matches(query, {_pattern(predicates.SEMANTIC)}) OR regexp_matches(query, {_pattern(predicates.ENTITY)}) THEN 'hybrid' END, 'both') AS route FROM qq),
w AS (SELECT qid, (CASE o WHEN 0 THEN date_trunc('week', d) + INTERVAL 7 DAY WHEN 1 THEN date_trunc('month', d) WHEN 4 THEN date_trunc('quarter', d) ELSE d END)::DATE AS s,
  (CASE o WHEN 0 THEN date_trunc('week', d) + INTERVAL 13 DAY WHEN 1 THEN last_day(d) WHEN 4 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY ELSE d END)::DATE AS e FROM ro WHERE o IN (0, 1, 4, 5) AND route IN ('sql', 'both')),
{_COMM}, {_ORDERS},
due AS (SELECT qid, message_id, row_number() OVER (PARTITION BY qid ORDER BY due_at, confidence DESC, message_id, text) AS rank FROM w JOIN cm ON due_at BETWEEN s AND e QUALIFY rank <= 50),
came AS (SELECT qid, dedup_key AS message_id, row_number() OVER (PARTITION BY qid ORDER BY day DESC, dedup_key) AS rank FROM w JOIN ms ON day BETWEEN s AND e WHERE NOT bulk QUALIFY rank <= 50),
texts AS (SELECT 'd' || doc_id AS id, text FROM documents),"""
_ANSWERED = """, f AS (SELECT qid, id AS message_id, rank FROM bm WHERE rank <= 10 AND qid IN (SELECT qid FROM ro WHERE route IN ('hybrid', 'both') OR qid NOT IN (SELECT qid FROM w))),
m AS (SELECT qid, message_id, 0 AS arm, rank FROM due UNION ALL SELECT qid, message_id, 1, rank FROM came UNION ALL SELECT qid, message_id, 2, rank FROM f),
p AS (SELECT qid, message_id, min((arm, rank)) AS p FROM m GROUP BY ALL)
SELECT qid, route, message_id, p[1]::INT AS arm, row_number() OVER (PARTITION BY qid ORDER BY p, message_id)::INT AS position FROM p JOIN ro USING (qid) QUALIFY position <= 60"""


@query(_BY_ROUTE + _bm25("texts").replace("FROM benchmark", "FROM (SELECT qid AS item_id, query AS text FROM ro)") + _ANSWERED)
def answered_by_route(spark: SparkSession, sf: str) -> DataFrame:
    """Rules choose the arms of every question; the arms' results follow each other in one list."""
    b = table(spark, sf, "benchmark")
    asked = b.select(F.col("item_id").alias("qid"), F.concat(dealt(_OPENINGS, F.col("item_id")), "text").alias("query"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("item_id") * 3).cast("int")).alias("as_of"))
    texts = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("dedup_key"), F.col("o_orderdate").cast("timestamp").alias("date_utc"))
    find = lambda q: lexical.bm25(texts, q, 10, keep_zero=False).select("qid", F.col("id").alias("message_id"), "rank")
    return asking.results_by_route(asked, _commitments(spark, sf), o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), find, 60)


@query("SELECT o_custkey AS user_id, count(*) AS n, min(o_orderdate)::DATE AS first_day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND o_orderpriority IN ('1-URGENT', chr(39) || 'x' || chr(39) || ' OR true') GROUP BY o_custkey")
def bound_statement(spark: SparkSession, sf: str) -> DataFrame:
    """What a user typed is a value, whatever it looks like."""
    statement = "SELECT o_custkey AS user_id, count(*) AS n, to_date(min(o_orderdate)) AS first_day FROM {orders} WHERE to_date(o_orderdate) BETWEEN :first AND :last AND (o_orderpriority = :kind OR o_orderpriority = :typed) GROUP BY o_custkey"
    values = {"first": datetime.date(1996, 1, 1), "last": datetime.date(1996, 12, 31), "kind": "1-URGENT", "typed": "'x' OR true"}
    return scoping.bound(statement, values, orders=table(spark, sf, "orders"))
