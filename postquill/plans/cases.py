"""Queries: expressions over whole tables. Phrases and markers are dealt to the rows by their
ids; what SQL expects is worked out from the rows by other means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, predicates, text
from ..operators import answering, evaluation, incremental, metrics
from ..session import table
from .base import query


def dealt(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def dealt_sql(values: list[str], number: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({number}) % {len(values)} + 1]"


def _pattern(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


# -- mail

_SENDERS = ["a@example.com", "no-reply@example.com", "john.reply@example.com", "Do_Not_Reply@x.org", "mailer-daemon@x.org"]
_SUBJECTS = ["contract", "Out of Office AutoReply", "Re: Undeliverable: meeting", "", "re: fw: contract", "Newsletter May", "the newsletter"]


@query(f"""SELECT doc_id, doc_id % 97 = 0 OR regexp_matches({dealt_sql(_SENDERS, "doc_id")}, {_pattern(predicates.NO_REPLY)}) OR regexp_matches({dealt_sql(_SUBJECTS, "doc_id")}, {_pattern(predicates.BULK_SUBJECT)})
 OR length(trim(coalesce(text, ''))) < {predicates.MIN_BODY} AS bulk FROM documents""")
def bulk_filter(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", dealt(_SENDERS, n).alias("sender"), dealt(_SUBJECTS, n).alias("subject"), F.col("text").alias("body_new"), (n % 97 == 0).alias("has_list_unsubscribe"))
    return d.select("doc_id", predicates.is_bulk().alias("bulk"))


_QUOTED = ["", "\n> said before\n  > and before that", "\n\n-----Original Message-----\nFrom: x\nmore", "\n  ---- Forwarded by Bob on 1/1\nrest", "\n__________\nfooter", "\nOn Monday Ann wrote:\n> q"]


@query(r"SELECT doc_id, regexp_replace(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: NOT starts_with(ltrim(x), '>')), chr(10)), '^\s+|\s+$', '', 'g') AS body_new FROM documents")
def strip_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with different kinds of quotes behind them: what was typed is the text."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), dealt(_QUOTED, F.col("doc_id"))).alias("body"))
    return d.select("doc_id", text.strip_quoted("body").alias("body_new"))


_HINTS = [" please review the draft", " deliver by friday", "", " lunch was nice", " see 11/8", " the dueling pianos"]


@query(f"SELECT doc_id, regexp_matches(coalesce(text, '') || {dealt_sql(_HINTS, 'doc_id')}, {_pattern(predicates.COMMITMENT_HINT)}) AS commitment FROM documents")
def commitment_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.coalesce("text", F.lit("")), dealt(_HINTS, F.col("doc_id")))
    return table(spark, sf, "documents").select("doc_id", predicates.looks_like_commitment(body).alias("commitment"))


_FENCES = ["```json\n{x}\n```", "```\n{x}```", "{x}", "  ```JSON {x}\n```  "]


@query("""SELECT doc_id, '{"n": ' || doc_id || ', "source": "' || source || '"}' AS answer FROM documents WHERE source IS NOT NULL""")
def unfenced_answers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source IS NOT NULL").withColumn("x", F.concat(F.lit('{"n": '), "doc_id", F.lit(', "source": "'), "source", F.lit('"}')))
    return d.select("doc_id", text.unfenced(F.replace(dealt(_FENCES, F.col("doc_id")), F.lit("{x}"), F.col("x"))).alias("answer"))


# -- dates

_DAY = "o_orderdate::DATE"
_MONDAY = "date_trunc('week', d)::DATE"
_WORKDAYS = "(SELECT list(x ORDER BY x) FROM (SELECT unnest(generate_series(d + 1, d + 20, INTERVAL 1 DAY))::DATE AS x) WHERE isodow(x) < 6)"
#: phrase, the day that it names, the precision; by a calendar's own functions.
_PHRASES = [
    ("today", "d", "day"), ("by tomorrow", "d + 1", "day"), ("day after tomorrow", "d + 2", "day"), ("yesterday", "d - 1", "day"), ("in 3 days", "d + 3", "day"), ("in two weeks", "d + 14", "day"),
    ("three days from now", "d + 3", "day"), ("in 5 business days", f"{_WORKDAYS}[5]", "day"), ("in 1 month", "(d + INTERVAL 1 MONTH)::DATE", "month"), ("end of week", "d + ((12 - isodow(d)) % 7)::INT", "day"),
    ("end of next week", f"{_MONDAY} + 11", "day"), ("end of the month", "last_day(d)", "day"), ("end of next month", "last_day((date_trunc('month', d) + INTERVAL 1 MONTH)::DATE)", "day"),
    ("end of quarter", "(date_trunc('quarter', d) + INTERVAL 3 MONTH)::DATE - 1", "day"), ("next week", f"{_MONDAY} + 11", "week"), ("this week", "d + ((12 - isodow(d)) % 7)::INT", "week"),
    ("next month", "last_day((date_trunc('month', d) + INTERVAL 1 MONTH)::DATE)", "month"), ("next quarter", "(date_trunc('quarter', d) + INTERVAL 6 MONTH)::DATE - 1", "quarter"), ("next Thursday", f"{_MONDAY} + 10", "day"),
    ("Tuesday", "d + ((8 - isodow(d)) % 7 + 1)::INT", "day"), ("by March 9", "CASE WHEN d - make_date(year(d), 3, 9) > 45 THEN make_date(year(d) + 1, 3, 9) ELSE make_date(year(d), 3, 9) END", "day"),
    ("the 9th of March", "CASE WHEN d - make_date(year(d), 3, 9) > 45 THEN make_date(year(d) + 1, 3, 9) ELSE make_date(year(d), 3, 9) END", "day"), ("11/8/97", "DATE '1997-11-08'", "day"), ("2001-11-08", "DATE '2001-11-08'", "day"),
    ("by February 30", "NULL", None), ("before the board meeting", "NULL", None),
]


def _case(rows: list[tuple], at: int) -> str:
    return "CASE phrase " + " ".join(f"WHEN '{r[0]}' THEN " + (r[at] if at == 1 else "NULL" if r[at] is None else f"'{r[at]}'") for r in rows) + " END"


_SAID = f"said AS (SELECT o_orderkey, {_DAY} AS d, {dealt_sql([p[0] for p in _PHRASES], 'o_orderkey')} AS phrase FROM orders)"


def _orders(spark: SparkSession, sf: str, phrases: list[str]) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), dealt(phrases, F.col("o_orderkey")).alias("phrase"))


@query(f"WITH {_SAID} SELECT o_orderkey, phrase, ({_case(_PHRASES, 1)})::DATE AS due, {_case(_PHRASES, 2)} AS due_precision FROM said")
def resolve_dates(spark: SparkSession, sf: str) -> DataFrame:
    found = _orders(spark, sf, [p[0] for p in _PHRASES]).withColumn("r", dates.resolve("phrase", "d"))
    return found.select("o_orderkey", "phrase", F.col("r.value").alias("due"), F.col("r.precision").alias("due_precision"))


_UNSURE = ["next Thursday", "next Tuesday", "January 3", "Friday"]


@query(f"""WITH said AS (SELECT o_orderkey, {_DAY} AS d, {dealt_sql(_UNSURE, 'o_orderkey')} AS phrase FROM orders), t AS (SELECT *, CASE phrase WHEN 'next Thursday' THEN 4 WHEN 'next Tuesday' THEN 2 END AS w FROM said),
f AS (SELECT *, {_MONDAY} + 6 + w AS far, d + ((w - isodow(d) + 6) % 7 + 1)::INT AS near, phrase = 'January 3' AND d - make_date(year(d), 1, 3) > 45 AS rolls FROM t)
SELECT o_orderkey, phrase, CASE phrase WHEN 'January 3' THEN make_date(year(d) + rolls::INT, 1, 3) WHEN 'Friday' THEN d + ((5 - isodow(d) + 6) % 7 + 1)::INT ELSE far END AS due, coalesce(near <> far, false) AS ambiguous, near AS alternative, rolls AS rolled_year FROM f""")
def ambiguous_dates(spark: SparkSession, sf: str) -> DataFrame:
    found = _orders(spark, sf, _UNSURE).withColumn("r", dates.resolve("phrase", "d"))
    return found.select("o_orderkey", "phrase", F.col("r.value").alias("due"), "r.ambiguous", "r.alternative", "r.rolled_year")


_WINDOWS = [
    ("this week", f"{_MONDAY}", f"{_MONDAY} + 6"), ("what is due next week", f"{_MONDAY} + 7", f"{_MONDAY} + 13"), ("last week", f"{_MONDAY} - 7", f"{_MONDAY} - 1"), ("came in yesterday", "d - 1", "d - 1"),
    ("this month", "date_trunc('month', d)", "last_day(d)"), ("next month", "date_trunc('month', d) + INTERVAL 1 MONTH", "last_day((date_trunc('month', d) + INTERVAL 1 MONTH)::DATE)"), ("last month", "date_trunc('month', d) - INTERVAL 1 MONTH", "date_trunc('month', d)::DATE - 1"),
    ("this quarter", "date_trunc('quarter', d)", "(date_trunc('quarter', d) + INTERVAL 3 MONTH)::DATE - 1"), ("in the next 10 days", "d", "d + 10"), ("in the past 3 days", "d - 3", "d"), ("what is overdue", "DATE '1900-01-01'", "d"), ("today", "d", "d"),
    ("what is due by 2001-11-08", "d", "DATE '2001-11-08'"), ("what was decided about pricing", "NULL", "NULL"),
]


@query(f"""WITH said AS (SELECT o_orderkey, {_DAY} AS d, {dealt_sql([w[0] for w in _WINDOWS], 'o_orderkey')} AS phrase FROM orders)
SELECT o_orderkey, phrase AS question, ({_case(_WINDOWS, 1)})::DATE AS window_start, ({_case([(w[0], w[2]) for w in _WINDOWS], 1)})::DATE AS window_end FROM said""")
def parse_window(spark: SparkSession, sf: str) -> DataFrame:
    found = _orders(spark, sf, [w[0] for w in _WINDOWS]).withColumn("w", dates.window("phrase", "d"))
    return found.select("o_orderkey", F.col("phrase").alias("question"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


# -- questions and their routes

_ASKS = ["due this week ", "anything overdue in ", "how many emails about ", "explain the ", "what did we agree is due next week: ", "mail from sara ", "", "why was it late yesterday, "]
_ROUTED = f"""q AS (SELECT conv_id, turn, {dealt_sql(_ASKS, "conv_id + turn")} || substr(coalesce(text, ''), 1, 40) AS question FROM conversations),
ro AS (SELECT *, CASE WHEN trim(question) = '' THEN NULL WHEN regexp_matches(question, {_pattern(predicates.AGGREGATE)}) THEN 'sql' WHEN regexp_matches(question, {_pattern(predicates.TEMPORAL)}) THEN
  CASE WHEN regexp_matches(question, {_pattern(predicates.SEMANTIC)}) OR regexp_matches(question, {_pattern(predicates.ENTITY)}) THEN 'both' ELSE 'sql' END
  WHEN regexp_matches(question, {_pattern(predicates.SEMANTIC)}) OR regexp_matches(question, {_pattern(predicates.ENTITY)}) THEN 'hybrid' END AS route FROM q)"""


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    asked = F.concat(dealt(_ASKS, F.col("conv_id") + F.col("turn")), F.substring(F.coalesce("text", F.lit("")), 1, 40))
    return c.select("conv_id", "turn", asked.alias("question")).withColumn("route", predicates.route("question"))


@query(f"WITH {_ROUTED} SELECT conv_id, turn, route FROM ro")
def route_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select("conv_id", "turn", "route")


@query(f"""WITH {_ROUTED}, r AS (SELECT {dealt_sql(["temporal", "semantic", "entity", "unanswerable"], "conv_id")} AS query_class, coalesce(route, 'both') AS route FROM ro), s AS (SELECT *, route = CASE WHEN query_class = 'temporal' THEN 'sql' ELSE 'hybrid' END OR route = 'both' AS ok FROM r WHERE query_class <> 'unanswerable')
SELECT CASE WHEN grouping(query_class) = 1 THEN 'all' ELSE query_class END AS query_class, count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (route = 'both') AS over_routed, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM s GROUP BY ROLLUP (query_class)""")
def router_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Rules first; what they leave open falls back to both arms."""
    classes = dealt(["temporal", "semantic", "entity", "unanswerable"], F.col("conv_id"))
    return metrics.route_scores(_routed(spark, sf).select(classes.alias("query_class"), F.coalesce("route", F.lit("both")).alias("route")))


_TARGETS = {"semantic": 3, "temporal": 2, "entity": 2, "unanswerable": 2, "person": 1}


@query("SELECT c AS query_class, (SELECT count(*) FROM embeddings WHERE label % 4 = i) AS n FROM (VALUES (0, 'semantic'), (1, 'temporal'), (2, 'entity'), (3, 'other'), (-1, 'unanswerable'), (-1, 'person')) t(i, c)")
def stratification(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "embeddings").select(dealt(["semantic", "temporal", "entity", "other"], F.col("label")).alias("query_class"))
    return evaluation.stratification(q, _TARGETS)


_MADE = """(SELECT o_orderkey::VARCHAR AS message_id, o_orderkey % 3 AS m, o_orderdate::DATE AS d, * FROM orders)"""


@query(f"""SELECT message_id, trim(o_orderpriority) AS text, CASE m WHEN 0 THEN 'payment' ELSE 'other' END AS kind, CASE m WHEN 1 THEN 'i_owe' ELSE 'unclear' END AS direction, CASE m WHEN 0 THEN d + 1 WHEN 1 THEN d + 14 END AS due_at,
  CASE m WHEN 2 THEN '' ELSE 'day' END AS due_precision, CASE m WHEN 0 THEN 1.0 WHEN 1 THEN (o_orderkey % 100) / 100.0 ELSE 0.5 END::DOUBLE AS confidence FROM {_MADE}
UNION ALL SELECT message_id, 'and more', 'other', 'unclear', NULL, '', 0.5 FROM {_MADE} WHERE m = 1""")
def extracted_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of three kinds: fenced with a number out of range, with an empty entry and one of defaults, and with unknown words."""
    n = F.col("o_orderkey")
    fenced = F.concat(F.lit('```json\n{"commitments": [{"text": " '), "o_orderpriority", F.lit(' ", "kind": "Payment", "due_phrase": "by tomorrow", "confidence": 7}]}\n```'))
    several = F.concat(F.lit('[{"text": "'), "o_orderpriority", F.lit('", "direction": " I_OWE", "due_phrase": "in two weeks", "confidence": "'), (n % 100 / 100).cast("string"), F.lit('"}, {"text": " "}, {"text": "and more"}]'))
    unknown = F.concat(F.lit('{"commitments": [{"text": "'), "o_orderpriority", F.lit('", "kind": "gift", "direction": "up", "due_phrase": "some day", "confidence": "high"}]}'))
    o = table(spark, sf, "orders").select(n.cast("string").alias("message_id"), F.to_date("o_orderdate").alias("sent"), F.when(n % 3 == 0, fenced).when(n % 3 == 1, several).otherwise(unknown).alias("answer"))
    return answering.extracted_commitments(o).select("message_id", "text", "kind", "direction", "due_at", "due_precision", "confidence")


# -- answers

_CITED = "ci AS (SELECT conv_id, turn, [(conv_id % 6)::INT, (turn % 4 + 1)::INT, (conv_id % 3)::INT] AS said FROM conversations), un AS (SELECT *, list_filter(said, lambda x, i: list_position(said, x) = i) AS once FROM ci)"


@query(f"WITH {_CITED} SELECT conv_id, turn, list_filter(once, lambda x: x BETWEEN 1 AND 3) AS valid, list_filter(once, lambda x: x NOT BETWEEN 1 AND 3) AS invalid FROM un")
def parse_citations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    mark = lambda x: F.concat(F.lit(" ["), x.cast("string"), F.lit("]"))
    a = c.select("conv_id", "turn", F.concat(F.lit("Agreed"), mark(F.col("conv_id") % 6), F.lit(" and signed"), mark(F.col("turn") % 4 + 1), mark(F.col("conv_id") % 3)).alias("answer"))
    good, bad = text.citation_numbers("answer", 3)
    return a.select("conv_id", "turn", good.alias("valid"), bad.alias("invalid"))


_MORE = [" It was agreed in writing by both sides [1].", " The excerpts do not mention any price at all for this.", " Is that a question that is long enough?", " Here is the list of everything that follows:", " All of it was deleted on Friday by the team."]


@query(rf"""WITH a AS (SELECT doc_id, coalesce(text, '') || {dealt_sql(_MORE, "doc_id")} AS t FROM documents)
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(t), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)),
  lambda s: length(s) >= {text.MIN_CLAIM} AND NOT ends_with(s, '?') AND NOT ends_with(s, ':') AND NOT regexp_matches(s, {_pattern(text.CITATION)}) AND NOT regexp_matches(s, {_pattern(text.META_STATEMENT)})) AS uncited FROM a""")
def uncited_claims(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), dealt(_MORE, F.col("doc_id"))).alias("answer"))
    return d.select("doc_id", text.uncited_claims("answer").alias("uncited"))


# -- two extractions side by side

_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', ' ', 'g'), '\s+'), lambda w: length(w) > 2))"
_SIDES = f"""si AS (SELECT doc_id, substr(text, 1, 60) AS local, CASE doc_id % 3 WHEN 0 THEN upper(substr(text, 1, 40)) WHEN 1 THEN substr(text, 41, 60) END AS ceiling FROM documents),
tk AS (SELECT *, {_TOKENS.format(x="local")} AS a, {_TOKENS.format(x="ceiling")} AS b FROM si),
sa AS (SELECT *, coalesce(least(len(a), len(b)) > 0 AND len(list_intersect(a, b)) >= 0.5 * least(len(a), len(b)), false) AS same FROM tk)"""


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    other = F.when(n % 3 == 0, text.plain_upper(F.substring("text", 1, 40))).when(n % 3 == 1, F.substring("text", 41, 60))
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 60).alias("local"), other.alias("ceiling"))


@query(f"WITH {_SIDES}, c AS (SELECT count(*) FILTER (same) AS both_, count(*) FILTER (NOT same) AS local_only, count(*) FILTER (ceiling IS NOT NULL AND NOT same) AS ceiling_only FROM sa) SELECT both_ AS both, local_only, ceiling_only, round(both_ / (both_ + local_only + ceiling_only), 6) AS agreement FROM c")
def compare_arms(spark: SparkSession, sf: str) -> DataFrame:
    s = _sides(spark, sf)
    arm = lambda c: s.where(F.col(c).isNotNull()).select(F.col("doc_id").alias("message_id"), F.col(c).alias("text"))
    return evaluation.arm_agreement(evaluation.compare_arms(arm("local"), arm("ceiling")))


@query(f"WITH {_SIDES} SELECT doc_id, same AND doc_id % 5 <> 0 AS same FROM sa WHERE ceiling IS NOT NULL")
def same_commitment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = _sides(spark, sf).where("ceiling IS NOT NULL")
    other = F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("doc_id"))
    return s.select("doc_id", predicates.same_commitment("doc_id", "local", other, "ceiling").alias("same"))


_TYPES = "ty AS (SELECT event_type AS arm, round(avg(value), 6) AS recall, round(count(*) / (SELECT count(*) FROM events), 6) AS ndcg FROM events WHERE event_type IS NOT NULL GROUP BY 1)"


def _types(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    by = e.where("event_type IS NOT NULL").groupBy(F.col("event_type").alias("arm")).agg(F.round(F.avg("value"), 6).alias("recall"), F.count(F.lit(1)).alias("n"))
    return by.join(total, F.lit(True)).select("arm", "recall", F.round(F.col("n") / F.col("total"), 6).alias("ndcg"))


@query(f"WITH {_TYPES} SELECT arm, recall, ndcg, round(recall - (SELECT recall FROM ty WHERE arm = 'click'), 6) AS recall_gain, round(ndcg - (SELECT ndcg FROM ty WHERE arm = 'click'), 6) AS ndcg_gain FROM ty")
def gain_over_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gain_over(_types(spark, sf), F.col("arm"), "click", ["recall", "ndcg"])


@query(f"WITH {_TYPES} SELECT * FROM ty ORDER BY ndcg DESC, arm DESC LIMIT 1")
def best_arm(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_row(_types(spark, sf), "ndcg", "arm")


# -- a queue of jobs

_NOW, _CLAIM = "2024-01-15 12:00:00", 40
_JOBS = f"jb AS (SELECT event_id AS id, {dealt_sql(['queued', 'running', 'queued', 'done'], 'event_id')} AS status, (event_id % 5)::INT AS attempts, ts::TIMESTAMP AS run_after FROM events WHERE ts IS NOT NULL)"


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("ts IS NOT NULL")
    return e.select(F.col("event_id").alias("id"), dealt(["queued", "running", "queued", "done"], F.col("event_id")).alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("run_after"))


@query(f"WITH {_JOBS}, ta AS (SELECT id FROM jb WHERE status = 'queued' AND run_after <= TIMESTAMP '{_NOW}' ORDER BY run_after, id LIMIT {_CLAIM}) SELECT id, CASE WHEN id IN (SELECT id FROM ta) THEN 'running' ELSE status END AS status, attempts + (id IN (SELECT id FROM ta))::INT AS attempts FROM jb")
def queue_claim(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.claimed(_jobs(spark, sf), F.lit(_NOW).cast("timestamp"), _CLAIM).select("id", "status", "attempts")


@query(f"WITH {_JOBS} SELECT id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts < 3 THEN TIMESTAMP '{_NOW}' + attempts * INTERVAL 1 MINUTE ELSE run_after END AS run_after FROM jb")
def queue_retry(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.failed(_jobs(spark, sf), F.lit(_NOW).cast("timestamp")).select("id", "status", F.col("run_after").cast("timestamp_ntz").alias("run_after"))
