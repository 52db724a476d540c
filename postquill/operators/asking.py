"""From questions to messages and cited answers: one plan over all questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import route
from ..functions.text import key_of_chunk, term_overlap, utc_label
from ..services import Model, cited_answers
from ..session import materialise
from . import answering, fusion, rerank, retrievers
from .routing import uses_retrieval, uses_sql


def search(
    questions: DataFrame, chunks: DataFrame, retriever: str = "hybrid_rrf", depth: int = 200, rerank_k: int = 20, top_n: int = 10,
    scorer: Callable[[Column, Column], Column] = term_overlap, **how,
) -> DataFrame:
    """The best messages of every question (qid, query) over chunks (id, text): retrieved,
    the first ``rerank_k`` reordered, chunks joined to messages. A question that finds
    nothing has no rows."""
    run = retrievers.retrieve(retriever, chunks, questions, depth, **how)
    return fusion.collapse_display(rerank.rerank(run, questions, chunks, rerank_k, scorer), key_of_chunk("id"), chunks, top_n)


def ask(questions: DataFrame, chunks: DataFrame, messages: DataFrame, model: Model, n_sources: int = 6, **how) -> DataFrame:
    """One cited answer per question from the messages (dedup_key, sender, date_utc,
    subject) that its search finds; without any the answer is a refusal."""
    found = search(questions, chunks, top_n=n_sources, **how)
    about = messages.select(F.col("dedup_key").alias("key"), "sender", utc_label(F.col("date_utc")).alias("date"), "subject")
    known = found.join(about, "key", "left")
    sources = known.select("qid", "rank", *[F.coalesce(c, F.lit("")).alias(c) for c in ("sender", "date", "subject")], "text")
    return cited_answers(questions, sources, model, n_sources)


def results_by_route(
    questions: DataFrame, commitments: DataFrame, messages: DataFrame, bulk: DataFrame, find: Callable[[DataFrame], DataFrame], top_n: int = 10, decide: Column | None = None,
) -> DataFrame:
    """(qid, route, message_id, arm, position) of all questions (qid, query, as_of) in one plan.

    The rules choose the arms (``decide`` names another choice); what they leave open asks
    both. Commitments due in a question's window come first, then messages that arrived in it,
    then what ``find`` (questions to qid, message_id, rank) finds. A question for the date arms
    that names no window is searched instead; one that nothing answers has no rows.
    """
    asked = questions.withColumn("route", F.coalesce(route("query") if decide is None else decide, F.lit("both")))
    dated = materialise(answering.with_windows(asked.where(uses_sql("route")).select("qid", "query", "as_of")), "asked")
    windowed = dated.where(F.col("start").isNotNull()).select("qid")
    due, _ = answering.commitment_arm(dated, commitments)
    came, _ = answering.arrival_arm(dated, messages, bulk, commitments)
    wanted = asked.join(windowed.withColumn("__dated", F.lit(True)), "qid", "left").where(uses_retrieval("route") | F.col("__dated").isNull())
    found = find(wanted.select("qid", "query"))
    merged = answering.merge_arms(due, came.select("qid", F.col("dedup_key").alias("message_id"), "rank"), found, top_n)
    return merged.join(asked.select("qid", "route"), "qid").select("qid", "route", "message_id", "arm", "position")
