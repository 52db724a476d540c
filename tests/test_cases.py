"""Expressions over literal rows, with the answers worked out by hand, and the SQL that lists them."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postquill.functions import dates, text
from postquill.functions.predicates import is_bulk, looks_like_commitment, route, same_commitment
from postquill.operators import answering, evaluation, incremental, metrics
from postquill.plans.base import rows
from postquill.plans.quality import _queryset

CASES: dict = {}


def query(sql: str):
    def keep(f):
        CASES[f.__name__] = (f, sql)
        return f

    return keep


_NOREPLY = r"(?i)(?:^|[._-])(?:no[._-]?reply|do[._-]?not[._-]?reply|notification|notifications|mailer[._-]?daemon|postmaster|bounce|listserv|majordomo|automail|autoreply)"


_BULK_CASES = """(VALUES
 (0, 'a@enron.com', 'contract', repeat('x', 100), false), (1, 'a@enron.com', 'contract', repeat('x', 100), true), (2, 'no-reply@example.com', 'contract', repeat('x', 100), false),
 (3, 'enron.announcements@enron.com', 'contract', repeat('x', 100), false), (4, 'a@enron.com', 'Out of Office AutoReply', repeat('x', 100), false),
 (5, 'a@enron.com', 'Re: Undeliverable: meeting', repeat('x', 100), false), (6, 'a@enron.com', 'contract', 'ok', false), (7, 'john.reply@enron.com', 'contract', repeat('x', 100), false),
 (8, CAST(NULL AS STRING), CAST(NULL AS STRING), repeat('x', 100), CAST(NULL AS BOOLEAN)), (9, 'Do_Not_Reply@x.org', '', repeat('y', 30), false)
) AS t(i, sender, subject, body_new, has_list_unsubscribe)"""


@query(f"""SELECT i, coalesce(has_list_unsubscribe, false) OR lower(coalesce(sender, '')) IN ('enron.announcements@enron.com', 'enron_announcements@enron.com', 'announcements.enron@enron.com', 'outlook.team@enron.com', 'ubsw.energy.announcements@enron.com', 'perfmgmt@enron.com', 'ezonline@enron.com')
 OR regexp_matches(coalesce(sender, ''), '{_NOREPLY}')
 OR regexp_matches(coalesce(subject, ''), '(?i)^(?:\\s*(?:re|fw|fwd)\\s*:\\s*)*\\s*(?:out of (?:the )?office|automatic reply|undeliverable|delivery status notification|returned mail|read:|tw:|newsletter|unsubscribe)')
 OR length(trim(coalesce(body_new, ''))) < 20 AS bulk FROM {_BULK_CASES}""")
def bulk_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, _BULK_CASES).select("i", is_bulk().alias("bulk"))


_QUOTES = r"""(VALUES (0, 'Fine.', 'Fine.'), (1, 'Yes\n> no\nsure', 'Yes\nsure'), (2, 'Top\n\n-----Original Message-----\nFrom: x', 'Top'), (3, 'A\n  ---- Forwarded by Bob on 1/1\nrest', 'A'),
 (4, 'B\n__________\nfooter', 'B'), (5, 'C\nFrom: me\nSent: now\nx', 'C'), (6, 'On Monday Ann wrote:\n> q', ''), (7, 'On and on it wrote, fine', 'On and on it wrote, fine')) AS t(i, body, want)"""


@query(_QUOTES.replace(r"\n", "' || chr(10) || '").join(("SELECT i, want AS body_new FROM ", "")))
def strip_quoted(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, _QUOTES).select("i", text.strip_quoted("body").alias("body_new"))


_PHRASES = """(VALUES
 ('today', '2001-10-30', '2001-10-30', 'day'), ('by EOD', '2001-10-30', '2001-10-30', 'day'), ('by COB', '2001-10-30', '2001-10-30', 'day'), ('tomorrow', '2001-10-30', '2001-10-31', 'day'),
 ('day after tomorrow', '2001-10-30', '2001-11-01', 'day'), ('yesterday', '2001-10-30', '2001-10-29', 'day'), ('in 3 days', '2001-10-30', '2001-11-02', 'day'), ('in two weeks', '2001-10-30', '2001-11-13', 'day'),
 ('in a week', '2001-10-30', '2001-11-06', 'day'), ('three days from now', '2001-10-30', '2001-11-02', 'day'), ('in 5 business days', '2001-10-30', '2001-11-06', 'day'), ('within 3 working days', '2001-10-30', '2001-11-02', 'day'),
 ('in 1 month', '2001-01-31', '2001-02-28', 'month'), ('in 1 month', '2000-01-31', '2000-02-29', 'month'), ('end of week', '2001-10-30', '2001-11-02', 'day'), ('EOW', '2001-10-30', '2001-11-02', 'day'),
 ('end of next week', '2001-10-30', '2001-11-09', 'day'), ('end of the month', '2001-10-30', '2001-10-31', 'day'), ('end of next month', '2001-10-30', '2001-11-30', 'day'), ('end of quarter', '2001-10-30', '2001-12-31', 'day'),
 ('end of month', '2000-02-03', '2000-02-29', 'day'), ('by November 8', '2001-10-30', '2001-11-08', 'day'), ('Nov. 8', '2001-10-30', '2001-11-08', 'day'), ('8 November', '2001-10-30', '2001-11-08', 'day'),
 ('the 8th of November', '2001-10-30', '2001-11-08', 'day'), ('11/8', '2001-10-30', '2001-11-08', 'day'), ('11/8/01', '2001-10-30', '2001-11-08', 'day'), ('2001-11-08', '2001-10-30', '2001-11-08', 'day'),
 ('by November 8, 2002', '2001-10-30', '2002-11-08', 'day'), ('by January 3', '2000-12-30', '2001-01-03', 'day'), ('the October 15 filing', '2001-10-30', '2001-10-15', 'day'), ('by 13/11', '2001-10-30', NULL, NULL),
 ('by February 30', '2001-10-30', NULL, NULL), ('', '2001-10-30', NULL, NULL), ('before the board meeting', '2001-10-30', NULL, NULL), ('by 1/5/99', '2001-10-30', '1999-01-05', 'day'), ('by 1/5/02', '2001-10-30', '2002-01-05', 'day'),
 ('2001-13-45', '2001-10-30', NULL, NULL), ('next week', '2001-10-30', '2001-11-09', 'week'), ('this week', '2001-10-30', '2001-11-02', 'week'), ('next month', '2001-10-30', '2001-11-30', 'month'), ('next quarter', '2001-10-30', '2002-03-31', 'quarter'),
 ('next Thursday', '2001-10-30', '2001-11-08', 'day'), ('this Thursday', '2001-10-30', '2001-11-01', 'day'), ('Thursday', '2001-10-30', '2001-11-01', 'day'), ('Tuesday', '2001-10-30', '2001-11-06', 'day'), ('by fri', '2001-10-30', '2001-11-02', 'day'), ('next Tues', '2001-10-30', '2001-11-06', 'day')
) AS t(phrase, sent, want, precision_)"""


@query(f"SELECT phrase, sent, want::DATE AS due, precision_ AS due_precision FROM {_PHRASES}")
def resolve_dates(spark: SparkSession, sf: str) -> DataFrame:
    found = rows(spark, _PHRASES).withColumn("r", dates.resolve("phrase", F.to_date("sent")))
    return found.select("phrase", "sent", F.col("r.value").alias("due"), F.col("r.precision").alias("due_precision"))


@query("""SELECT * FROM (VALUES ('next Thursday', DATE '2001-11-08', true, DATE '2001-11-01', false), ('next Tuesday', DATE '2001-11-06', false, DATE '2001-11-06', false),
 ('January 3', DATE '2002-01-03', false, NULL, true), ('Friday', DATE '2001-11-02', false, NULL, false)) AS t(phrase, due, ambiguous, alternative, rolled_year)""")
def ambiguous_dates(spark: SparkSession, sf: str) -> DataFrame:
    asked = rows(spark, "(VALUES ('next Thursday'), ('next Tuesday'), ('January 3'), ('Friday')) AS t(phrase)")
    found = asked.withColumn("r", dates.resolve("phrase", F.lit("2001-10-30").cast("date")))
    return found.select("phrase", F.col("r.value").alias("due"), "r.ambiguous", "r.alternative", "r.rolled_year")


_WINDOW_CASES = """(VALUES ('this week', '2001-10-29', '2001-11-04'), ('what is due next week', '2001-11-05', '2001-11-11'), ('last week', '2001-10-22', '2001-10-28'), ('came in yesterday', '2001-10-29', '2001-10-29'),
 ('this month', '2001-10-01', '2001-10-31'), ('next month', '2001-11-01', '2001-11-30'), ('last month', '2001-09-01', '2001-09-30'), ('this quarter', '2001-10-01', '2001-12-31'), ('in the next 10 days', '2001-10-30', '2001-11-09'),
 ('in the past 3 days', '2001-10-27', '2001-10-30'), ('what is due by November 8', '2001-10-30', '2001-11-08'), ('what is overdue', '1900-01-01', '2001-10-30'), ('today', '2001-10-30', '2001-10-30'),
 ('what was decided about pricing', NULL, NULL)) AS t(question, start_, end_)"""


@query(f"SELECT question, start_::DATE AS window_start, end_::DATE AS window_end FROM {_WINDOW_CASES}")
def parse_window(spark: SparkSession, sf: str) -> DataFrame:
    found = rows(spark, _WINDOW_CASES).withColumn("w", dates.window("question", F.lit("2001-10-30")))
    return found.select("question", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


_HINTS = """(VALUES ('please review the draft', true), ('deliver by friday', true), ('can you send the file', true), ('lunch was nice', false), ('see 11/8', true), ('the dueling pianos', false), (CAST(NULL AS STRING), false), ('I''ll call back', true), ('May 5 is fine', true), ('nov 5 is fine', true)) AS t(body, want)"""


@query(f"SELECT body, want AS commitment FROM {_HINTS}")
def commitment_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, _HINTS.replace("''", "\\'")).select("body", looks_like_commitment("body").alias("commitment"))


_NOW = "2024-01-15 12:00:00"


_JOBS = "(VALUES (1, 'sync', 'u1', 'queued', 0, TIMESTAMP '2024-01-15 11:00:00'), (2, 'sync', 'u2', 'queued', 1, TIMESTAMP '2024-01-15 10:00:00'), (3, 'digest', 'u1', 'running', 3, TIMESTAMP '2024-01-15 09:00:00'), (4, 'sync', 'u3', 'queued', 0, TIMESTAMP '2024-01-16 09:00:00'), (5, 'sync', 'u4', 'done', 1, TIMESTAMP '2024-01-15 09:00:00')) AS t(id, type, user_id, status, attempts, run_after)"


def _now():
    return F.lit(_NOW).cast("timestamp")


@query(f"SELECT id, CASE WHEN id = 2 THEN 'running' ELSE status END AS status, attempts + (id = 2)::INT AS attempts FROM {_JOBS}")
def queue_claim(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.claimed(rows(spark, _JOBS), _now()).select("id", "status", "attempts")


@query(f"SELECT id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts < 3 THEN TIMESTAMP '{_NOW}' + attempts * INTERVAL 1 MINUTE ELSE run_after END AS run_after FROM {_JOBS}")
def queue_retry(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.failed(rows(spark, _JOBS), _now()).select("id", "status", F.col("run_after").cast("timestamp_ntz").alias("run_after"))


_ROUTES = """(VALUES ('due this week', 'temporal', 'sql'), ('anything overdue', 'temporal', 'sql'), ('what is due by November 8', 'temporal', 'sql'), ('what came in today', 'temporal', 'sql'), ('how many emails about pricing', 'temporal', 'sql'),
 ('explain the pricing model', 'semantic', 'hybrid'), ('what did we agree is due next week', 'temporal', 'both'), ('mail from sara shackleton', 'entity', 'hybrid'), ('pricing', 'semantic', CAST(NULL AS STRING)), ('', 'unanswerable', CAST(NULL AS STRING)),
 ('why was it late yesterday', 'semantic', 'both'), ('list all contracts', 'unanswerable', 'sql')) AS t(question, query_class, want)"""


@query(f"SELECT question, want AS route FROM {_ROUTES}")
def route_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, _ROUTES).select("question", route("question").alias("route"))


@query(f"""WITH r AS (SELECT query_class, coalesce(want, 'both') AS route FROM {_ROUTES} WHERE query_class <> 'unanswerable'), s AS (SELECT *, route = CASE WHEN query_class = 'temporal' THEN 'sql' ELSE 'hybrid' END OR route = 'both' AS ok FROM r)
SELECT CASE WHEN grouping(query_class) = 1 THEN 'all' ELSE query_class END AS query_class, count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (route = 'both') AS over_routed, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM s GROUP BY ROLLUP (query_class)""")
def router_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Rules first; what they leave open falls back to both arms."""
    return metrics.route_scores(rows(spark, _ROUTES).withColumn("route", F.coalesce(route("question"), F.lit("both"))))


@query("SELECT * FROM (VALUES ('semantic', 2::BIGINT), ('temporal', 2), ('entity', 3), ('unanswerable', 1), ('person', 1)) AS t(query_class, n)")
def stratification(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.stratification(_queryset(spark))


_ANSWERS = """(VALUES (0, 'It was agreed [1] and signed [3][1].', 3), (1, 'See [9] and [0], also [2].', 2), (2, 'No source at all.', 4), (3, CAST(NULL AS STRING), 2), (4, '[2] [2] [99999999999]', 2)) AS t(i, answer, n)"""


@query("SELECT * FROM (VALUES (0, [1, 3], []::INT[]), (1, [2], [9, 0]), (2, [], []), (3, [], []), (4, [2], [NULL])) AS t(i, valid, invalid)")
def parse_citations(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = text.citation_numbers("answer", F.col("n"))
    return rows(spark, _ANSWERS).select("i", good.alias("valid"), bad.alias("invalid"))


_CLAIMS = """(VALUES (0, 'The contract was signed in May by both sides. It was late [1].'), (1, 'The excerpts do not mention any price at all for this. Is that a long enough question here?'), (2, 'Short one. Here is the list of everything that follows:'), (3, 'All emails were deleted on Friday by the team.')) AS t(i, answer)"""


@query("SELECT * FROM (VALUES (0, ['The contract was signed in May by both sides.']), (1, []), (2, []), (3, ['All emails were deleted on Friday by the team.'])) AS t(i, uncited)")
def uncited_claims(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, _CLAIMS).select("i", text.uncited_claims("answer").alias("uncited"))


_ARMS = """(VALUES ('m1', 'local', 'send the agenda to everyone'), ('m1', 'local', 'pay the vendor invoice'), ('m1', 'ceiling', 'send agenda'), ('m2', 'local', 'book a room'), ('m3', 'ceiling', 'sign the contract'), ('m1', 'ceiling', 'call the bank tomorrow')) AS t(message_id, arm, text)"""


@query("SELECT 1::BIGINT AS both, 2::BIGINT AS local_only, 2::BIGINT AS ceiling_only, 0.2::DOUBLE AS agreement")
def compare_arms(spark: SparkSession, sf: str) -> DataFrame:
    a = rows(spark, _ARMS)
    return evaluation.arm_agreement(evaluation.compare_arms(a.where("arm = 'local'"), a.where("arm = 'ceiling'")))


@query("SELECT * FROM (VALUES ('book a room', false), ('pay the vendor invoice', false), ('send the agenda to everyone', true)) AS t(text, same)")
def same_commitment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a = rows(spark, _ARMS).where("arm = 'local'")
    return a.select("text", same_commitment("message_id", "text", F.lit("m1"), F.lit("send agenda")).alias("same"))


_ABLATION = "(VALUES ('bm25', 0.5, 0.40), ('dense', 0.6, 0.45), ('hybrid', 0.7, 0.44)) AS t(arm, recall, ndcg)"


@query(f"SELECT arm, recall::DOUBLE AS recall, ndcg::DOUBLE AS ndcg, round(recall::DOUBLE - 0.5, 6) AS recall_gain, round(ndcg::DOUBLE - 0.4, 6) AS ndcg_gain FROM {_ABLATION}")
def gain_over_baseline(spark: SparkSession, sf: str) -> DataFrame:
    t = rows(spark, _ABLATION).select("arm", F.col("recall").cast("double"), F.col("ndcg").cast("double"))
    return metrics.gain_over(t, F.col("arm"), "bm25", ["recall", "ndcg"])


@query("SELECT 'dense' AS arm, 0.6::DOUBLE AS recall, 0.45::DOUBLE AS ndcg")
def best_arm(spark: SparkSession, sf: str) -> DataFrame:
    t = rows(spark, _ABLATION).select("arm", F.col("recall").cast("double"), F.col("ndcg").cast("double"))
    return metrics.best_row(t, "ndcg", "arm")


@query("""SELECT * FROM (VALUES ('m1', 'send the deck', 'deliverable', 'i_owe', DATE '2001-11-02', 'day', 0.9::DOUBLE), ('m1', 'pay', 'other', 'unclear', NULL, '', 0.5), ('m2', 'meet', 'meeting', 'they_owe', DATE '2001-11-09', 'week', 1.0)) AS t(message_id, text, kind, direction, due_at, due_precision, confidence)""")
def extracted_commitments(spark: SparkSession, sf: str) -> DataFrame:
    first = '{"commitments": [{"text": " send the deck ", "kind": "deliverable", "direction": "i_owe", "due_phrase": "by fri", "confidence": "0.9"}, {"text": "pay", "kind": "gift", "confidence": "high"}, {"text": " "}]}'
    second = '```json\n{"commitments": [{"text": "meet", "kind": "meeting", "direction": "they_owe", "due_phrase": "next week", "confidence": 7}]}\n```'
    a = spark.createDataFrame([("m1", first), ("m2", second), ("m3", "no json")], "message_id string, answer string").withColumn("sent", F.lit("2001-10-30").cast("date"))
    return answering.extracted_commitments(a).select("message_id", "text", "kind", "direction", "due_at", "due_precision", "confidence")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, sf, name):
    from .test_queries import plain

    f, sql = CASES[name]
    got = f(spark, sf)
    cols = sorted(got.columns)
    rel = duckdb.connect().execute(sql)
    names = [d[0] for d in rel.description]
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.toArrow().to_pylist()) == want
