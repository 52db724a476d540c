"""Queries: routing, evaluation sets, agreement and answer quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, metrics
from ..session import table
from .base import query, rows


_QUERYSET = """(VALUES ('q1', 'pricing  Model', 'semantic', array('0', '1'), true, ''), ('q2', 'pricing model', 'semantic', array('2'), true, ''), ('q3', 'due soon', 'temporal', array('3'), false, ''), ('q4', 'due when', 'temporal', array('4', '4'), true, '2001/1/1'),
 ('q5', 'nothing', 'unanswerable', array('5'), true, ''), ('q6', '  ', 'entity', array(), true, ''), ('q7', 'who', 'person', array('999999999'), true, ''), ('q8', 'x', 'entity', array('6'), true, ''), ('q8', 'y', 'entity', array('7'), true, '')) AS t(query_id, query, query_class, relevant_message_ids, verified, as_of)"""


def _queryset(spark: SparkSession) -> DataFrame:
    return rows(spark, _QUERYSET).withColumn("relevant_message_ids", F.col("relevant_message_ids").cast("array<string>"))


@query("""SELECT * FROM (VALUES ('q8', 'error', 'duplicate query_id'), ('q7', 'error', 'unknown query_class'), ('q6', 'error', 'empty query text'), ('q6', 'error', 'answerable without labels'), ('q5', 'error', 'control with labels'), ('q4', 'error', 'duplicate labels'),
 ('q4', 'error', 'as_of is no ISO date'), ('q2', 'warning', 'near-duplicate text'), ('q3', 'warning', 'not verified'), ('q3', 'warning', 'temporal without as_of'), ('semantic', 'warning', 'class misses its target'), ('entity', 'warning', 'class misses its target'),
 ('unanswerable', 'warning', 'class misses its target'), ('q7', 'error', 'labels outside the corpus')) AS t(query_id, severity, problem)""")
def eval_validation(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("dedup_key"))
    return evaluation.problems(_queryset(spark), corpus, {"semantic": 3, "temporal": 2, "entity": 2, "unanswerable": 2})


_STOPS = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_T = rf"list_distinct(list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9'']+'), lambda w: length(w) > 2 AND w NOT IN ({_STOPS})))"


@query(f"""WITH d AS (SELECT doc_id, unnest({_T.format(x="text")}) AS term FROM documents), b AS (SELECT item_id, len(t) AS n, unnest(t) AS term FROM (SELECT item_id, {_T.format(x="text")} AS t FROM benchmark))
SELECT doc_id, item_id, round(count(*) / n, 6) AS overlap FROM d JOIN b USING (term) GROUP BY doc_id, item_id, n""")
def term_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and items that share a term; the overlap of all other pairs is 0."""
    b = table(spark, sf, "benchmark").select("item_id", text.content_terms("text").alias("t"))
    b = b.select("item_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    d = table(spark, sf, "documents").select("doc_id", F.explode(text.content_terms("text")).alias("term"))
    shared = d.join(b, "term").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("k"))
    return shared.select("doc_id", "item_id", F.round(F.col("k") / F.col("n"), 6).alias("overlap"))


@query(f"""WITH d AS (SELECT doc_id, {_T.format(x="text")} AS t FROM documents), b AS (SELECT item_id, {_T.format(x="text")} AS t FROM benchmark)
SELECT doc_id, item_id, round(CASE WHEN len(b.t) = 0 THEN 0 ELSE len(list_intersect(b.t, d.t)) / len(b.t) END, 6) AS overlap FROM d CROSS JOIN b""")
def term_overlap_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against every item; a document first keeps only terms that some item has."""
    b = table(spark, sf, "benchmark").select("item_id", text.content_terms("text").alias("q"))
    asked = b.select(F.explode("q").alias("term")).agg(F.collect_set("term").alias("asked"))  # one row
    d = table(spark, sf, "documents").crossJoin(asked).select("doc_id", F.array_intersect(text.content_terms("text"), "asked").alias("t"))
    share = F.size(F.array_intersect("t", "q")) / F.nullif(F.size("q"), F.lit(0))
    return d.crossJoin(b).select("doc_id", "item_id", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("overlap"))


@query("""WITH p AS (SELECT quality::VARCHAR AS a, (1 - toxic)::VARCHAR AS b FROM labels), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM p),
e AS (SELECT sum(x.c * y.c) / (SELECT n FROM n) / (SELECT n FROM n) AS pe FROM (SELECT a, count(*)::DOUBLE AS c FROM p GROUP BY a) x JOIN (SELECT b, count(*)::DOUBLE AS c FROM p GROUP BY b) y ON x.a = y.b)
SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM n, e""")
def cohens_kappa(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return metrics.cohens_kappa(pairs, "a", "b")


@query("""WITH p AS (SELECT o_totalprice AS a, extract(day FROM o_orderdate)::INT AS b FROM orders),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y FROM p)
SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "orders").select(F.col("o_totalprice").alias("a"), F.dayofmonth("o_orderdate").alias("b"))
    return metrics.spearman(pairs, "a", "b")


_DATED = "dp AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS gold, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + (o_orderkey % 4)::INT END AS predicted, o_orderkey % 5 = 0 AS ambiguous, o_orderdate::DATE + (o_orderkey % 4)::INT - 3 AS alternative FROM orders)"


@query("WITH " + _DATED + """ SELECT count(gold) AS n, count(*) FILTER (gold = predicted) AS exact, count(*) FILTER (abs(gold - predicted) <= 1) AS within_1d, count(*) FILTER (gold = predicted OR gold = alternative) AS either_reading,
 count(*) FILTER (gold IS NOT NULL AND predicted IS NOT NULL AND ambiguous) AS ambiguous, count(*) FILTER (gold IS NOT NULL AND predicted IS NULL) AS missing, count(*) FILTER (gold IS NULL AND predicted IS NOT NULL) AS spurious,
 round(count(*) FILTER (gold = predicted) / count(gold), 6) AS exact_rate FROM dp""")
def date_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    off = F.date_add(day, (k % 4).cast("int"))
    pairs = o.select(F.when(k % 11 != 0, day).alias("gold"), F.when(k % 7 != 0, off).alias("predicted"), (k % 5 == 0).alias("ambiguous"), F.date_sub(off, 3).alias("alternative"))
    return metrics.date_scores(pairs)


_VERDICTS = "vd AS (SELECT doc_id // 10 AS query_id, (['supported', 'partially_supported', 'unsupported', 'not_a_claim'])[(doc_id + quality) % 4 + 1] AS verdict, doc_id % 3 <> 0 AS cited FROM labels)"
_SCORES = _VERDICTS + """, sc AS (SELECT query_id, count(*) FILTER (verdict <> 'not_a_claim') AS n_claims, round(avg(CASE verdict WHEN 'supported' THEN 1.0 WHEN 'partially_supported' THEN 0.5 WHEN 'unsupported' THEN 0.0 END), 6) AS groundedness,
 round(count(*) FILTER (cited AND verdict = 'supported') / nullif(count(*) FILTER (cited AND verdict <> 'not_a_claim'), 0), 6) AS citation_accuracy FROM vd GROUP BY query_id)"""


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("supported", "partially_supported", "unsupported", "not_a_claim")))
    d = F.col("doc_id")
    return table(spark, sf, "labels").select(F.floor(d / 10).alias("query_id"), F.get(names, ((d + F.col("quality")) % 4).cast("int")).alias("verdict"), F.when(d % 3 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("cited"))


@query("WITH " + _SCORES + " SELECT query_id, n_claims, groundedness, citation_accuracy FROM sc")
def groundedness(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.answer_scores(_verdicts(spark, sf))


@query("WITH " + _SCORES + """, an AS (SELECT query_id, query_id % 5 = 0 AS is_control, query_id % 4 = 0 AS refused, CASE WHEN query_id % 3 <> 0 THEN query_id % 3 END AS relevance, query_id % 6 = 1 AS bad FROM sc)
SELECT round(avg(groundedness), 6) AS groundedness, round(avg(citation_accuracy), 6) AS citation_accuracy, round(avg(relevance / 2), 6) AS answer_relevance, round(avg(CASE WHEN is_control THEN refused::INT END), 6) AS refusal_on_controls,
 round(avg(CASE WHEN NOT refused THEN bad::INT END), 6) AS fabricated_citations, count(*) FILTER (NOT is_control AND refused) AS refused_answerable FROM an JOIN sc USING (query_id)""")
def generation_report(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluation.answer_scores(_verdicts(spark, sf))
    q = F.col("query_id")
    answers = s.select("query_id", (q % 5 == 0).alias("is_control"), (q % 4 == 0).alias("refused"), F.when(q % 3 != 0, q % 3).alias("relevance"), (q % 6 == 1).cast("int").alias("n_invalid"))
    return evaluation.generation_report(s, answers)


@query(r"SELECT doc_id, CASE WHEN length(f) <= 120 THEN f ELSE regexp_replace(substr(f, 1, 120), ' [^ ]*$', '') || ' …' END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)")
def clip_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.clip("text", 120).alias("clipped"))


@query("SELECT verdict AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM vd), 6) AS share FROM vd GROUP BY verdict".join(("WITH " + _VERDICTS + " ", "")))
def miss_report(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf).select(F.col("verdict").alias("category"), F.lit("q").alias("query"), F.col("query_id").cast("string").alias("query_id"))
    return evaluation.miss_report(v).drop("example")
