"""Evaluation sets, the failure taxonomy, and scores of generated answers."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_overlap, token_set

# Fixed values.
CLASSES = ("semantic", "temporal", "entity", "unanswerable")
TARGETS = {"semantic": 35, "temporal": 25, "entity": 10, "unanswerable": 10}
CATEGORIES = ("bad_label", "chunk_boundary", "temporal", "multi_hop", "vocabulary", "ranking")
LOW_OVERLAP = 0.10
VERDICT_WORTH = {"supported": 1.0, "partially_supported": 0.5, "unsupported": 0.0}


def problems(queries: DataFrame, corpus: DataFrame | None = None, targets: dict[str, int] | None = None) -> DataFrame:
    """(query_id, severity, problem): one rule a query, united; empty means clean.

    ``queries``: query_id, query, query_class, relevant_message_ids, verified, as_of.
    """
    targets = TARGETS if targets is None else targets
    n = F.size(F.coalesce("relevant_message_ids", F.array().cast("array<string>")))
    as_of = F.coalesce("as_of", F.lit(""))
    row = lambda where, severity, what: queries.where(where).select("query_id", F.lit(severity).alias("severity"), F.lit(what).alias("problem"))
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce("query", F.lit(""))), r"\s+", " "))
    same_id = queries.groupBy("query_id").count().where("count > 1")
    near = queries.withColumn("t", flat).groupBy("t").agg(F.min("query_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = queries.withColumn("t", flat).join(near, "t").where(F.col("query_id") != F.col("first"))
    counts = queries.groupBy(F.col("query_class").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    wanted = queries.sparkSession.createDataFrame([(k, v) for k, v in targets.items()], "c string, target long").join(counts, "c", "left")
    found = [
        same_id.select("query_id", F.lit("error").alias("severity"), F.lit("duplicate query_id").alias("problem")),
        row(~F.coalesce(F.col("query_class").isin(*CLASSES), F.lit(False)), "error", "unknown query_class"),
        row(F.trim(F.coalesce("query", F.lit(""))) == "", "error", "empty query text"),
        row((F.col("query_class") != "unanswerable") & (n == 0), "error", "answerable without labels"),
        row((F.col("query_class") == "unanswerable") & (n > 0), "error", "control with labels"),
        row(F.size(F.array_distinct("relevant_message_ids")) < n, "error", "duplicate labels"),
        row((F.col("query_class") == "temporal") & (as_of != "") & ~as_of.rlike(r"^\d{4}-\d{2}-\d{2}$"), "error", "as_of is no ISO date"),
        later.select("query_id", F.lit("warning").alias("severity"), F.lit("near-duplicate text").alias("problem")),
        row(~F.coalesce("verified", F.lit(False)), "warning", "not verified"),
        row((F.col("query_class") == "temporal") & (as_of == ""), "warning", "temporal without as_of"),
        wanted.where(F.coalesce("n", F.lit(0)) != F.col("target")).select(F.col("c").alias("query_id"), F.lit("warning").alias("severity"), F.lit("class misses its target").alias("problem")),
    ]
    if corpus is not None:
        labels = queries.select("query_id", F.explode("relevant_message_ids").alias("id"))
        lost = labels.join(corpus.select(F.col("dedup_key").cast("string").alias("id")), "id", "left_anti").select("query_id").distinct()
        found.append(lost.select("query_id", F.lit("error").alias("severity"), F.lit("labels outside the corpus").alias("problem")))
    return reduce(lambda a, b: a.unionByName(b), found)


def stratification(queries: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    names = queries.sparkSession.createDataFrame([(k,) for k in (targets or TARGETS)], "query_class string")
    counts = queries.groupBy("query_class").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "query_class", "full_outer").select("query_class", F.coalesce("n", F.lit(0)).alias("n"))


def misses(per_query: DataFrame, k: int = 20) -> DataFrame:
    """Every answerable query whose first relevant message is not in the first ``k``,
    with the one category that says what would fix it, tested in order.

    ``per_query``: query_id, query, query_class, notes, n_relevant, found_at,
    best_chunk_rank, document (text of the labelled messages, null if unknown).
    """
    overlap = F.when(F.coalesce("document", F.lit("")) != "", term_overlap("query", "document"))
    beyond = F.col("found_at").isNull() | (F.col("found_at") > k)
    category = (
        F.when(F.contains(F.lower(F.coalesce("notes", F.lit(""))), F.lit("bad_label")), "bad_label")
        .when(F.coalesce(F.col("best_chunk_rank") <= k, F.lit(False)), "chunk_boundary")
        .when(F.col("query_class") == "temporal", "temporal").when(F.col("n_relevant") > 1, "multi_hop")
        .when(overlap.isNull() | (overlap < LOW_OVERLAP), "vocabulary").otherwise("ranking")
    )
    return per_query.where((F.col("n_relevant") > 0) & beyond).select("query_id", "query", "query_class", category.alias("category"), "found_at", F.round(F.coalesce(overlap, F.lit(0.0)), 3).alias("term_overlap"))


def miss_report(found: DataFrame) -> DataFrame:
    """category, n, share of all misses, first example."""
    by = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min_by("query", "query_id").alias("example"))
    total = found.agg(F.count(F.lit(1)).alias("__t")).withColumn("__k", F.lit(1))
    return by.withColumn("__k", F.lit(1)).join(total, "__k").select("category", "n", F.round(F.col("n") / F.col("__t"), 6).alias("share"), "example")


def answer_scores(verdicts: DataFrame) -> DataFrame:
    """Per query of (query_id, sentence, cited, verdict): groundedness and citation
    accuracy over claims; null where there is none."""
    worth = F.lit(None).cast("double")
    for verdict, value in VERDICT_WORTH.items():
        worth = F.when(F.col("verdict") == verdict, value).otherwise(worth)
    cited = F.size(F.coalesce("cited", F.array().cast("array<int>"))) > 0
    claim = worth.isNotNull()
    n_cited = F.count_if(claim & cited)
    return verdicts.groupBy("query_id").agg(
        F.count_if(claim).alias("n_claims"), F.round(F.avg(worth), 6).alias("groundedness"),
        F.round(F.count_if(cited & (F.col("verdict") == "supported")) / F.nullif(n_cited, F.lit(0)), 6).alias("citation_accuracy"),
    )


def generation_report(scores: DataFrame, answers: DataFrame) -> DataFrame:
    """Macro means over answers (query_id, is_control, refused, relevance, n_invalid)."""
    rows = answers.join(scores, "query_id", "left")
    control, refused = F.col("is_control"), F.col("refused")
    return rows.agg(
        F.round(F.avg("groundedness"), 6).alias("groundedness"), F.round(F.avg("citation_accuracy"), 6).alias("citation_accuracy"),
        F.round(F.avg(F.col("relevance") / 2), 6).alias("answer_relevance"), F.round(F.avg(F.when(control, refused.cast("int"))), 6).alias("refusal_on_controls"),
        F.round(F.avg(F.when(~refused, (F.col("n_invalid") > 0).cast("int"))), 6).alias("fabricated_citations"), F.count_if(~control & refused).alias("refused_answerable"),
    )


def _greedy(threshold: float):
    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        counts = {"both": 0, "local_only": 0, "ceiling_only": 0}
        ceiling = pairs[pairs.arm == "ceiling"].sort_values("text")
        for mine in pairs[pairs.arm == "local"].sort_values("text").tokens:
            a = set(mine)
            hit = next((i for i, t in zip(ceiling.index, ceiling.tokens) if i not in taken and a and len(t) and len(a & set(t)) >= threshold * min(len(a), len(t))), None)
            if hit is None:
                counts["local_only"] += 1
            else:
                taken.add(hit)
                counts["both"] += 1
        counts["ceiling_only"] = len(ceiling) - len(taken)
        return pd.DataFrame([{"message_id": pairs.message_id.iloc[0], **counts}])

    return run


def compare_arms(local: DataFrame, ceiling: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy first-match pairing of two extractions within each message: counts of
    commitments found by both or one. Greedy matching depends on order, so each
    message's few commitments are matched in one pandas call, in text order."""
    side = lambda df, arm: df.select(F.col("message_id").cast("string"), F.lit(arm).alias("arm"), "text", token_set("text").alias("tokens"))
    both = side(local, "local").unionByName(side(ceiling, "ceiling"))
    return both.groupBy("message_id").applyInPandas(_greedy(threshold), "message_id string, both long, local_only long, ceiling_only long")


def arm_agreement(matches: DataFrame) -> DataFrame:
    total = matches.agg(*[F.sum(c).alias(c) for c in ("both", "local_only", "ceiling_only")])
    every = F.col("both") + F.col("local_only") + F.col("ceiling_only")
    return total.withColumn("agreement", F.round(F.col("both") / F.nullif(every, F.lit(0)), 6))


