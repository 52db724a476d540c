"""Commitments from messages by a model: prefiltered, asked, read, validated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import commitment_problems, looks_like_commitment
from ..functions.text import sent_label, text_or_empty, unfenced
from ..services import Model, complete
from .answering import extracted_commitments
from .evaluation import arm_agreement, compare_arms

MAX_BODY = 4000
MAX_RECIPIENTS = 200
_ASK = 'List the commitments of this message as JSON {"commitments": [{"text", "kind", "direction", "owner", "counterparty", "due_phrase", "confidence", "quote"}]}.\n'


def extract(messages: DataFrame, model: Model, name: str = "extractor", cache: DataFrame | None = None, prefilter: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid commitments, one row per message, new cache rows) of messages (dedup_key,
    sender, recipients, subject, date_utc, body_new).

    The second has passed (the prefilter), failed (no answer, or none that lists
    commitments) for :func:`..reporting.extraction_stats`. Messages that the
    prefilter leaves out are not asked about; a message that fails has no rows.
    """
    body = F.substring(text_or_empty("body_new"), 1, MAX_BODY)
    subject = text_or_empty("subject")
    hint = looks_like_commitment(F.concat(subject, F.lit("\n"), body)) if prefilter else F.lit(True)
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    sent = F.to_date("date_utc")
    prompt = F.concat(
        F.lit(_ASK + "From: "), named("sender"), F.lit("\nTo: "), F.substring(named("recipients"), 1, MAX_RECIPIENTS), F.lit("\nSent: "), F.coalesce(sent_label(sent), F.lit("unknown")),
        F.lit("\nSubject: "), subject, F.lit("\n\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit("(empty body)")),
    )
    rows = messages.select(F.col("dedup_key").alias("message_id"), sent.alias("sent"), hint.alias("passed"), prompt.alias("prompt"))
    asked, new = complete(rows.where("passed").select("message_id", "sent", "prompt"), model, name, cache)
    plain = unfenced("answer")
    listed = F.when(plain.startswith("["), F.from_json(plain, "array<string>").isNotNull()).otherwise(F.from_json(plain, "commitments array<string>")["commitments"].isNotNull())
    seen = rows.select("message_id", "passed").join(asked.select("message_id", F.coalesce(listed, F.lit(False)).alias("listed")), "message_id", "left")
    made = extracted_commitments(asked.select("message_id", "sent", "answer")).withColumn("model", F.lit(name))
    valid = made.where(F.size(commitment_problems()) == 0)
    return valid, seen.select("message_id", "passed", (F.col("passed") & ~F.col("listed")).alias("failed")), new


def compare_models(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Agreement of the model that found fewest commitments with the one that found most;
    of equal numbers the first names. Needs two models; fewer give no row."""
    n = found.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    ends = n.agg(F.min_by("model", F.struct("n", "model")).alias("local"), F.max_by("model", F.struct("n", "model")).alias("ceiling"), F.count(F.lit(1)).alias("models")).where("models > 1")
    both = found.select("message_id", "text", "model").crossJoin(F.broadcast(ends.drop("models")))  # one row of names
    side = lambda c: both.where(F.col("model") == F.col(c)).select("message_id", "text")
    return arm_agreement(compare_arms(side("local"), side("ceiling"), threshold)).crossJoin(F.broadcast(ends.drop("models")))
