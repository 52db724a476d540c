"""Which arms answer a question, and what a question transform did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import ROUTES, route
from ..functions.text import unfenced
from ..services import Model, complete

# Fixed values.
RULE_CONFIDENCE, MODEL_CONFIDENCE, ABSTAIN_CONFIDENCE = 0.9, 0.7, 0.0
_ASK = "Say which way answers the question: " + ", ".join(ROUTES) + '. Answer as JSON {"route": "...", "reason": "..."}.\n\nQuestion: '


def uses_sql(name: Column | str) -> Column:
    return (F.col(name) if isinstance(name, str) else name).isin("sql", "both")


def uses_retrieval(name: Column | str) -> Column:
    return (F.col(name) if isinstance(name, str) else name).isin("hybrid", "both")


def routed(questions: DataFrame, model: Model | None = None, name: str = "router", cache: DataFrame | None = None) -> DataFrame:
    """Questions (qid, query) with route, confidence, decided_by, llm_calls and the two arms.
    Rules first, then the model, and both arms where neither settles it. Only what the
    rules leave open reaches the model."""
    ruled = questions.withColumn("rule", route("query"))
    llm = F.lit(None).cast("string")
    calls = F.lit(0)
    if model is not None:
        asked = ruled.where(F.col("rule").isNull()).select("qid", F.concat(F.lit(_ASK), F.coalesce("query", F.lit(""))).alias("prompt"))
        said = F.lower(F.trim(F.from_json(unfenced("answer"), "route string")["route"]))
        answered = complete(asked, model, name, cache)[0].select("qid", F.when(said.isin(*ROUTES), said).alias("llm"))
        ruled, llm, calls = ruled.join(answered, "qid", "left"), F.col("llm"), F.col("rule").isNull().cast("int")
    by = F.when(F.col("rule").isNotNull(), "rules").when(llm.isNotNull(), "llm").otherwise("default")
    sure = F.when(by == "rules", RULE_CONFIDENCE).when(by == "llm", MODEL_CONFIDENCE).otherwise(ABSTAIN_CONFIDENCE)
    out = ruled.withColumns({"route": F.coalesce("rule", llm, F.lit("both")), "confidence": sure, "decided_by": by, "llm_calls": calls})
    return out.select("qid", "query", "route", "confidence", "decided_by", "llm_calls", uses_sql("route").alias("uses_sql"), uses_retrieval("route").alias("uses_retrieval"))


def transform_summary(transformed: DataFrame, kind: str) -> DataFrame:
    """One row of counts over questions from ``services.transform``."""
    return transformed.agg(
        F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("queries"), F.count_if(F.col("fired") & ~F.col("degraded")).alias("fired"),
        F.count_if("degraded").alias("degraded"), F.coalesce(F.sum("n_runs"), F.lit(0)).alias("n_runs"),
    )
