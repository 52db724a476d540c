"""Queries: scopes, routes, answers' shapes, upkeep and report tables over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, predicates, text
from ..operators import ablation, corpus, incremental, reporting, rerank, routing, scoping, threads
from ..session import table
from ..streaming import ingest
from .base import EVENT_MESSAGES, event_messages, query
from .retrieval import _METRICS, _REL, _SUMMARY, _TEXTS, _bm25, _chunks, _contained, _questions

_EV = "WITH " + EVENT_MESSAGES


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# -- routes

_QUESTIONS = """qu AS (SELECT conv_id || '-' || turn AS qid, coalesce(text, '') || (['', ' due this week', ' emails from bob about it', ' how many emails this month', ' what did they say about this week'])[(turn + conv_id) % 5 + 1] AS q FROM conversations)"""
_ROUTED = _QUESTIONS + f""", fl AS (SELECT qid, q, regexp_matches(q, {_re(predicates.TEMPORAL)}) AS t, regexp_matches(q, {_re(predicates.SEMANTIC)}) OR regexp_matches(q, {_re(predicates.ENTITY)}) AS c, regexp_matches(q, {_re(predicates.AGGREGATE)}) AS a FROM qu),
ro AS (SELECT qid, CASE WHEN trim(q) = '' THEN NULL WHEN a THEN 'sql' WHEN t AND c THEN 'both' WHEN t THEN 'sql' WHEN c THEN 'hybrid' END AS rule FROM fl)"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(*map(F.lit, ("", " due this week", " emails from bob about it", " how many emails this month", " what did they say about this week")))
    t = table(spark, sf, "conversations")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.concat(F.coalesce("text", F.lit("")), F.get(ends, ((F.col("turn") + F.col("conv_id")) % 5).cast("int"))).alias("query"))


@query("WITH " + _ROUTED + " SELECT qid, coalesce(rule, 'both') AS route, CASE WHEN rule IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN rule IS NULL THEN 'default' ELSE 'rules' END AS decided_by, coalesce(rule, 'both') <> 'hybrid' AS uses_sql, coalesce(rule, 'both') <> 'sql' AS uses_retrieval FROM ro")
def routed_questions(spark: SparkSession, sf: str) -> DataFrame:
    return routing.routed(_asked(spark, sf)).drop("query", "llm_calls")


@query("WITH " + _ROUTED + " SELECT CASE WHEN rule IS NULL THEN 'default' ELSE 'rules' END AS decided_by, count(*) AS n, round(count(*) / (SELECT count(*) FROM ro), 6) AS share FROM ro GROUP BY 1")
def decided_by_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reporting.decided_by(routing.routed(_asked(spark, sf)))


@query("WITH " + _QUESTIONS + f" SELECT qid, regexp_matches(q, {_re(predicates.DATE_LANGUAGE)}) AS dated FROM qu")
def date_language(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("qid", F.col("query").rlike(predicates.DATE_LANGUAGE).alias("dated"))


# -- scopes

_MSG = "cm AS (SELECT conv_id || '-' || turn AS dedup_key, conv_id AS thread_id, turn, text FROM conversations)"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("dedup_key"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("ordinal"), "text")


@query("WITH " + _MSG + " SELECT dedup_key, thread_id FROM cm WHERE thread_id IN (SELECT thread_id FROM cm WHERE turn = 1 AND thread_id % 4 IN (1, 2))")
def eval_scoped_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = _turns(spark, sf)
    names = F.array(*map(F.lit, ("semantic", "temporal", "entity", "unanswerable")))
    q = m.where("ordinal = 1").select(F.get(names, (F.col("thread_id") % 4).cast("int")).alias("query_class"), F.array("dedup_key").alias("relevant_message_ids"))
    return scoping.eval_scoped(m, q).select("dedup_key", "thread_id")


@query("SELECT conv_id || '' AS dedup_key, md5(string_agg(coalesce(text, ''), ' ' ORDER BY turn, coalesce(text, ''))) AS text_md5 FROM conversations GROUP BY conv_id")
def message_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("dedup_key", F.col("thread_id").cast("string"))
    return scoping.message_texts(rows).select("dedup_key", F.md5("text").alias("text_md5"))


@query(_EV + " SELECT dedup_key FROM msgs WHERE date_utc >= TIMESTAMP '2024-01-10' ORDER BY date_utc, dedup_key LIMIT 500")
def since_limit(spark: SparkSession, sf: str) -> DataFrame:
    return scoping.since(event_messages(spark, sf), F.lit("2024-01-10").cast("timestamp"), 500).select("dedup_key")


@query(_EV + " SELECT dedup_key FROM msgs WHERE date_utc >= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY")
def recent_messages(spark: SparkSession, sf: str) -> DataFrame:
    return scoping.recent(event_messages(spark, sf), F.lit("2024-01-20").cast("timestamp")).select("dedup_key")


@query(_EV + " SELECT date_utc >= TIMESTAMP '2024-01-15' AS recent, count(*) AS n FROM msgs GROUP BY 1")
def staged_sync(spark: SparkSession, sf: str) -> DataFrame:
    first, rest = ingest.staged(event_messages(spark, sf), F.lit("2024-01-15").cast("timestamp"))
    count = lambda df, which: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(which).alias("recent"), "n").where("n > 0")
    return count(first, True).unionByName(count(rest, False))


_SEGMENT = "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'zone-' || c_nationkey END"


@query(f"SELECT o_orderkey, coalesce(nullif({_SEGMENT}, ''), 'UTC') AS zone FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey")
def lookup_with_default(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_custkey % 5 <> 0")
    zones = c.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("zone-"), "c_nationkey")).alias("zone"))
    return scoping.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), zones, "o_custkey", "zone", "UTC").select("o_orderkey", "zone")


# -- texts and answers

_SAID = "an AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' **insufficient_context** ' ELSE coalesce(text, '') || ' [' || (turn + 1) || ']' END AS a, (conv_id + turn) % 3 AS n FROM conversations)"


def _said(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    a = F.when(F.col("turn") % 5 == 4, " **insufficient_context** ").otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("]")))
    return t.select("conv_id", "turn", a.alias("a"), ((F.col("conv_id") + F.col("turn")) % 3).cast("int").alias("n"))


@query("WITH " + _SAID + " SELECT conv_id, turn, starts_with(upper(trim(replace(a, '*', ''))), 'INSUFFICIENT_CONTEXT') AS refused, turn % 5 = 4 OR turn + 1 <= n AS grounded FROM an")
def grounded_shapes(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = text.citation_numbers("a", F.col("n"))
    refused = text.is_refusal("a")
    return _said(spark, sf).select("conv_id", "turn", refused.alias("refused"), reporting.grounded_shape(refused, good, bad).alias("grounded"))


@query("WITH " + _SAID + r" SELECT conv_id, turn, len(list_filter(list_transform(string_split(regexp_replace(trim(a), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 3)) AS claims FROM an")
def claim_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _said(spark, sf).select("conv_id", "turn", F.size(text.split_claims("a")).cast("long").alias("claims"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d (%A)') AS sent, 'From: ' || o_custkey || chr(10) || 'To: a, b' || chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'Subject: ' || o_orderpriority || chr(10) || chr(10) AS header FROM orders")
def message_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    header = text.chunk_header(F.col("o_custkey").cast("string"), F.lit("a;b"), F.col("o_orderdate"), F.col("o_orderpriority"))
    return o.select("o_orderkey", text.sent_label(F.to_date("o_orderdate")).alias("sent"), header.alias("header"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ['x' || o_orderkey, 'y'] WHEN 2 THEN ['z' || o_custkey] END AS parts, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE least(1.0, o_totalprice / 400000) END AS sure,
 sha256('{"model":"m","prompt":"' || o_orderpriority || '","version":1}') AS request FROM orders""")
def model_values(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    said = F.when(k % 4 == 0, "no json").when(k % 4 == 1, F.concat(F.lit('```json\n["x'), k, F.lit('", "y"]\n```'))).when(k % 4 == 2, F.concat(F.lit('{"queries": ["z'), "o_custkey", F.lit('"]}'))).otherwise('{"other": 1}')
    sure = F.when(k % 3 == 0, "high").otherwise((F.col("o_totalprice") / 400000).cast("string"))
    return o.select(
        "o_orderkey", text.string_list(said, "queries").alias("parts"), text.clamp_unit(sure).alias("sure"),
        text.request_key(prompt=F.col("o_orderpriority"), model=F.lit("m"), version=F.lit(1)).alias("request"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS at,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 5) * 60.0 / (o_orderkey % 5) * (10 - o_orderkey % 5) END::DOUBLE AS eta FROM orders""")
def days_and_etas(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day = dates.iso_day(F.when(k % 3 == 0, "soon").when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    start, n = F.lit("2024-01-01 00:00:00").cast("timestamp"), k % 5
    eta = incremental.eta_seconds(start, F.timestamp_seconds(F.unix_timestamp(start) + n * 60), n, F.lit(10))
    return o.select("o_orderkey", day.alias("day"), dates.midnight_utc(day).cast("string").alias("at"), eta.cast("double").alias("eta"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE || ' to ' || o_orderdate::DATE || ' (1 days)' WHEN 1 THEN date_trunc('week', o_orderdate)::DATE || ' to ' || (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE || ' (7 days)'
 ELSE '1900-01-01 to ' || o_orderdate::DATE || ' (' || (o_orderdate::DATE - DATE '1900-01-01' + 1) || ' days) plus anything already overdue' END AS label FROM orders""")
def window_labels(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.get(F.array(*map(F.lit, ("mail of today", "this week", "anything overdue"))), (F.col("o_orderkey") % 3).cast("int"))
    found = table(spark, sf, "orders").select("o_orderkey", dates.window(asked, "o_orderdate").alias("w"))
    return found.select("o_orderkey", dates.window_label(F.col("w")).alias("label"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN embedding[1]::DOUBLE ELSE embedding[2]::DOUBLE - embedding[1]::DOUBLE END AS relevance FROM embeddings")
def logit_relevance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    logits = F.when(F.col("vec_id") % 2 == 0, F.slice("e", 1, 1)).otherwise(F.slice("e", 1, 2))
    return e.select("vec_id", rerank.relevance(logits).alias("relevance"))


# -- threads and upkeep

_REPLIES = "hm AS (SELECT event_id, printf('%012d', event_id) AS k, '<e' || event_id // 2 * 2 || '@x>' AS mid, CASE WHEN event_id % 3 = 0 AND event_id > 9 THEN event_id - 9 END AS parent FROM events)"


@query("WITH " + _REPLIES + ", tg AS (SELECT mid, max(k) AS b FROM hm GROUP BY mid) SELECT DISTINCT k AS a, b FROM hm JOIN tg ON tg.mid = '<e' || parent || '@x>' OR tg.mid = '<e' || parent // 4 || '@x>' WHERE parent IS NOT NULL AND k <> b")
def reply_edges(spark: SparkSession, sf: str) -> DataFrame:
    e, n = table(spark, sf, "events"), F.col("event_id")
    name = lambda x: F.concat(F.lit("<e"), x.cast("long"), F.lit("@x>"))
    parent = F.when((n % 3 == 0) & (n > 9), n - 9)
    m = e.select(F.format_string("%012d", "event_id").alias("dedup_key"), name(F.floor(n / 2) * 2).alias("message_id"), name(parent).alias("in_reply_to"), F.concat(F.lit("see "), name(F.floor(parent / 4)), F.lit(" <broken>")).alias("references"))
    return threads.header_edges(m)


@query("SELECT 'd' || doc_id % 400 AS dedup_key, min(source) AS sender FROM documents WHERE doc_id % 400 % 3 <> 0 AND doc_id % 2 = 0 GROUP BY 1")
def bulk_rows(spark: SparkSession, sf: str) -> DataFrame:
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    raw = d.select(
        F.concat(F.lit("d"), n % 400).alias("dedup_key"), F.col("source").alias("sender"), F.lit("s").alias("subject"), F.lit("a body that is long enough to be kept").alias("body_new"),
        (n % 2 == 0).alias("has_list_unsubscribe"), F.lit(None).cast("timestamp").alias("date_utc"),
    )
    seen = d.where(n % 400 % 3 == 0).select(F.concat(F.lit("d"), n % 400).alias("dedup_key"))
    return corpus.new_bulk_rows(raw, seen).select("dedup_key", "sender")


@query("SELECT o_orderkey AS commitment_id, o_custkey AS user_id, 'pending' AS status FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1")
def new_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    made = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")).alias("due_at"))
    have = o.where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("commitment_id"), F.col("o_custkey").alias("user_id"), F.lit("kept").alias("status"))
    return incremental.suggestions(made, have)


@query("SELECT conv_id AS conversation_id, turn, role FROM conversations WHERE conv_id % 3 = 1")
def owned_turns(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role")
    owners = t.select(F.col("conversation_id").alias("id"), F.concat(F.lit("u"), F.col("conversation_id") % 3).alias("user_id")).distinct()
    return scoping.conversation_turns(t, owners, "u1").select("conversation_id", "turn", "role")


# -- reports

@query("SELECT o_orderkey AS message_id, l_linenumber AS line, min(g) AS g_order FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, min(l_partkey) % 5 AS p FROM lineitem GROUP BY ALL), (SELECT unnest([1, 2, 3]) AS g) WHERE (p + g) % 3 = 0 AND o_orderkey % 2 = 0 GROUP BY ALL")
def paired_gold(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("line")).agg((F.min("l_partkey") % 5).alias("f_p"))
    gold = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("message_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("g_order"))
    return reporting.paired_with_gold(found, gold, (F.col("f_p") + F.col("g_order")) % 3 == 0).select("message_id", "line", "g_order")


@query("SELECT count(*) AS messages_seen, count(*) FILTER (o_orderkey % 3 = 0) AS messages_prefiltered_out, count(*) FILTER (o_orderkey % 3 <> 0) AS messages_called, round(avg((o_orderkey % 3 <> 0)::INT), 6) AS prefilter_pass_rate, (SELECT count(*) FROM lineitem) AS commitments, (SELECT count(*) FROM lineitem WHERE l_linenumber > 1) AS with_due_date FROM orders")
def extraction_counts(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "orders").select((F.col("o_orderkey") % 3 != 0).alias("passed"))
    made = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")).alias("due_at"))
    return reporting.extraction_stats(seen, made)


_RUNS = "rn AS (SELECT o_orderkey AS run, (o_orderkey % 7)::INT AS top_k, (o_custkey % 9)::INT AS passage_tokens, o_totalprice / 1000 AS ms FROM orders)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 7).cast("int").alias("top_k"), (F.col("o_custkey") % 9).cast("int").alias("passage_tokens"), (F.col("o_totalprice") / 1000).alias("ms"))


@query("WITH " + _RUNS + " SELECT run, top_k, passage_tokens FROM rn ORDER BY run DESC LIMIT 1")
def newest_run(spark: SparkSession, sf: str) -> DataFrame:
    return reporting.newest(_runs(spark, sf), "run").select("run", "top_k", "passage_tokens")


@query("WITH " + _RUNS + " SELECT top_k, passage_tokens FROM rn WHERE ms <= 200 ORDER BY top_k DESC, passage_tokens DESC LIMIT 1")
def best_affordable_arm(spark: SparkSession, sf: str) -> DataFrame:
    return reporting.best_affordable(_runs(spark, sf)).select("top_k", "passage_tokens")


_ARM = "WITH " + _TEXTS + _bm25("texts") + ", co AS (SELECT qid, regexp_replace(id, ':[^:]*$', '') AS id, min(rank) AS first_rank FROM bm GROUP BY ALL), hy AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY first_rank, id)::INT AS rank FROM co), " + _REL
_CLASSES = ", qs AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS query_class FROM benchmark),"


@query(_ARM + _CLASSES + _METRICS.format(run="hy") + " SELECT s.*, 'fixed_512 | hash | bm25' AS arm, 'fixed_512' AS chunking, 'own/hash' AS model, 'bm25' AS retriever, NULL::DOUBLE AS dense_weight, 'none' AS rerank, 'none' AS transform FROM (" + _SUMMARY + ") s")
def ablation_row(spark: SparkSession, sf: str) -> DataFrame:
    asked = _questions(spark, sf).withColumn("query_class", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd"))
    relevant = _contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return ablation.compare([ablation.Arm("fixed_512", "own/hash", "bm25")], {"fixed_512": _chunks(spark, sf)}, asked, relevant, 50)
