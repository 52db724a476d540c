"""Language models, encoders and scorers as plug-ins, with offline stand-ins.

A model is a callable from a list of prompts to a list of answers, run by executors
on Arrow batches. Answers are kept in a table by the hash of the request and looked
up by a join first, so only new requests reach the model; failures are not kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import (
    citation_numbers, clip, format_sources_text, is_refusal, request_key, string_list, text_or_empty, uncited_claims,
)

Model = Callable[[list[str]], list[str | None]]


def echo_model(prompts: list[str]) -> list[str | None]:
    """Deterministic stand-in: answers with the first source, cited."""
    out: list[str | None] = []
    for p in prompts:
        body = p.partition("[1]")[2].strip().split("\n\n")[0]
        out.append(f"{body[:80]} [1]" if body else "INSUFFICIENT_CONTEXT")
    return out


def _call(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(1).to_pylist()
            try:
                answers = model(prompts)
            except Exception:  # a model that fails degrades the answer, not the job
                answers = [None] * len(prompts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], names=["request", "answer"])

    return run


def complete(prompts: DataFrame, model: Model, name: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(prompts with ``answer``, new cache rows). ``prompts`` has a column prompt."""
    keyed = prompts.withColumn("request", request_key(model=F.lit(name), prompt=F.col("prompt"), version=F.lit(1)))
    wanted = keyed.select("request", "prompt").dropDuplicates(["request"])
    fresh = wanted if cache is None else wanted.join(cache, "request", "left_anti")
    new = fresh.select("request", "prompt").mapInArrow(_call(model), "request string, answer string").where(F.col("answer").isNotNull())
    known = new if cache is None else cache.select("request", "answer").unionByName(new)
    return keyed.join(known, "request", "left"), new


def transform(questions: DataFrame, answers: Column, how: str) -> DataFrame:
    """Texts for dense and sparse retrieval per question: identity, hyde, multi_query
    or decompose, from a model's answer. A missing answer degrades to the question."""
    q = F.col("query")
    own = F.array(q)
    parts = string_list(answers, "queries")
    usable = F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0)) > 0
    dense, sparse = own, own
    if how == "hyde":
        dense = F.when(F.trim(text_or_empty(answers)) != "", F.array(answers)).otherwise(own)
    elif how == "multi_query":
        dense = sparse = F.when(usable, F.array_distinct(F.concat(own, F.slice(parts, 1, 3)))).otherwise(own)
    elif how == "decompose":
        dense = sparse = F.when(usable & (F.size(parts) > 1), F.slice(parts, 1, 3)).otherwise(own)
    elif how != "identity":
        raise ValueError(f"no transform {how}")
    out = questions.withColumns({"dense_texts": dense, "sparse_texts": sparse})
    return out.withColumns({"fired": (F.col("dense_texts") != own) | (F.col("sparse_texts") != own), "degraded": answers.isNull() & F.lit(how != "identity"), "n_runs": F.greatest(F.size("dense_texts"), F.size("sparse_texts"))})


def cited_answers(questions: DataFrame, sources: DataFrame, model: Model, n_sources: int = 6) -> DataFrame:
    """One answer per question (qid, query) from its ranked sources (qid, rank, sender,
    date, subject, text). Without sources the model is not called. Citations that do
    not exist and sentences that cite nothing are reported with the answer."""
    top = sources.where(F.col("rank") <= n_sources).withColumn("text", clip("text"))
    blocks = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "sender", "date", "subject", "text"))).alias("s"))
    asked = questions.join(blocks, "qid", "left").withColumn("n", F.coalesce(F.size("s"), F.lit(0)))
    prompts = asked.where("n > 0").withColumn("prompt", F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\n"), format_sources_text("s")))
    answered, _ = complete(prompts.select("qid", "prompt"), model, "answer")
    rows = asked.select("qid", "query", "n").join(answered.select("qid", "answer"), "qid", "left")
    refused = (F.col("n") == 0) | (F.trim(text_or_empty("answer")) == "") | is_refusal("answer")
    valid, invalid = citation_numbers("answer", F.col("n"))
    return rows.select("qid", "query", refused.alias("refused"), F.when(~refused, F.col("answer")).alias("answer"), F.when(~refused, valid).alias("cited"), F.when(~refused, invalid).alias("invalid"), F.when(~refused, uncited_claims("answer")).alias("uncited"))
