"""Answers held against their sources by a model that did not write them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_numbers, format_sources_text, split_claims, text_or_empty, unfenced
from ..services import Model, complete
from .evaluation import VERDICT_WORTH, answer_scores, generation_report
from .reporting import cited_sources

NO_CLAIM = "not_a_claim"
VERDICTS = (*VERDICT_WORTH, NO_CLAIM)
WHY_CHARS = 200
_CLAIM = "Say whether the excerpts support the claim: " + ", ".join(VERDICTS) + '. Answer as JSON {"verdict": "...", "why": "..."}.'
_RELEVANT = 'Say whether the answer addresses the question: 0 no, 1 in part, 2 yes. Answer as JSON {"score": 0, "why": "..."}.'


def claims(answers: DataFrame) -> DataFrame:
    """(query_id, n_claim, sentence, cited, excerpts) of answers (query_id, answer, refused,
    sources) that did not refuse. ``sources``: array of structs with n, sender, date,
    subject and text; only numbers that exist count as cited."""
    each = answers.where(~F.col("refused")).select("query_id", "sources", F.posexplode(split_claims("answer")).alias("n_claim", "sentence"))
    cited, _ = citation_numbers("sentence", F.coalesce(F.size("sources"), F.lit(0)))
    return each.select("query_id", "n_claim", "sentence", F.sort_array(cited).alias("cited"), cited_sources(F.col("sources"), cited).alias("excerpts"))


def claim_verdicts(rows: DataFrame, model: Model, name: str = "judge", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims with verdict and why, new cache rows). Without a citation there is nothing to
    check; a judge that fails or answers otherwise counts against the claim."""
    checked = F.size("cited") > 0
    prompt = F.concat(F.lit(_CLAIM + "\n\nClaim: "), F.col("sentence"), F.lit("\n\n"), format_sources_text("excerpts"))
    asked, new = complete(rows.where(checked).withColumn("prompt", prompt), model, name, cache)
    said = F.from_json(unfenced("answer"), "verdict string, why string")
    verdict = F.lower(F.trim(said["verdict"]))
    fine = F.coalesce(verdict.isin(*VERDICTS), F.lit(False))
    judged = asked.select("query_id", "n_claim", "sentence", "cited", F.when(fine, verdict).otherwise("unsupported").alias("verdict"), F.when(fine, F.substring(text_or_empty(said["why"]), 1, WHY_CHARS)).otherwise("judge failed").alias("why"))
    rest = rows.where(~checked).select("query_id", "n_claim", "sentence", "cited", F.lit(NO_CLAIM).alias("verdict"), F.lit("nothing cited").alias("why"))
    return judged.unionByName(rest), new


def relevance(answers: DataFrame, model: Model, name: str = "judge", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, relevance, why) of answers (query_id, query, answer, refused); 0, 1, 2, or
    null where the judge fails. Refusals are not judged."""
    prompt = F.concat(F.lit(_RELEVANT + "\n\nQuestion: "), F.col("query"), F.lit("\n\nAnswer: "), F.col("answer"))
    asked, new = complete(answers.where(~F.col("refused")).select("query_id", prompt.alias("prompt")), model, name, cache)
    said = F.from_json(unfenced("answer"), "score string, why string")
    score = said["score"].try_cast("int")
    return asked.select("query_id", F.when(score.between(0, 2), score).alias("relevance"), F.substring(text_or_empty(said["why"]), 1, WHY_CHARS).alias("why")), new


def judged_report(answers: DataFrame, model: Model, name: str = "judge", with_relevance: bool = True) -> DataFrame:
    """One row for generated answers (query_id, query, query_class, answer, refused, invalid,
    sources): judged claims and relevance, refusals split by controls and the rest."""
    verdicts, _ = claim_verdicts(claims(answers), model, name)
    rows = answers.withColumns({"is_control": F.col("query_class") == "unanswerable", "n_invalid": F.coalesce(F.size("invalid"), F.lit(0))})
    if with_relevance:
        rows = rows.join(relevance(answers, model, name)[0].select("query_id", "relevance"), "query_id", "left")
    else:
        rows = rows.withColumn("relevance", F.lit(None).cast("int"))
    return generation_report(answer_scores(verdicts), rows.select("query_id", "is_control", "refused", "relevance", "n_invalid"))
