"""Retrieval configurations against one labelled question set: a row of metrics each."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_of_chunk, term_overlap
from . import dense, fusion, lexical, metrics, rerank, retrievers


@dataclass(frozen=True)
class Arm:
    """One configuration, by names only, so that a row says what made it."""

    chunking: str
    model: str
    retriever: str
    dense_weight: float = 0.5
    rerank: str = "none"
    transform: str = "none"

    @property
    def label(self) -> str:
        extra = [f"+{self.transform}"] * (self.transform != "none") + [f"+rerank:{self.rerank}"] * (self.rerank != "none")
        return " | ".join([self.chunking, self.model.rpartition("/")[2], self.retriever, *extra])

    def columns(self) -> dict[str, Column]:
        """The configuration as literals; a weight only where the retriever has one."""
        weight = F.lit(self.dense_weight if self.retriever == "hybrid_weighted" else None).cast("double")
        return {"arm": F.lit(self.label), "chunking": F.lit(self.chunking), "model": F.lit(self.model), "retriever": F.lit(self.retriever), "dense_weight": weight, "rerank": F.lit(self.rerank), "transform": F.lit(self.transform)}


def transformed_run(arm: Arm, chunks: DataFrame, questions: DataFrame, depth: int, embed: retrievers.Embed = dense.hashed_embedding) -> DataFrame:
    """The run for questions (qid, dense_texts, sparse_texts): each text is searched on its
    own; texts are fused within a modality, modalities with each other."""
    parts = []
    for modality, used in (("dense", arm.retriever != "bm25"), ("sparse", arm.retriever != "dense")):
        if used:
            each = questions.select("qid", F.posexplode(f"{modality}_texts").alias("text_no", "query")).withColumn("asked", F.struct("qid", "text_no").cast("string"))
            text = each.select(F.col("asked").alias("qid"), "query")
            run = retrievers.dense_run(chunks, text, depth, embed) if modality == "dense" else retrievers.sparse_run(chunks, text, depth)
            parts.append(run.withColumnRenamed("qid", "asked").join(each.select("asked", "qid", "text_no"), "asked").select("qid", F.lit(modality).alias("modality"), "text_no", "id", "rank"))
    return fusion.two_stage(reduce(lambda a, b: a.unionByName(b), parts), top_k=depth)


def per_query(
    arm: Arm, chunks: DataFrame, questions: DataFrame, relevant: DataFrame, depth: int = 200, scorer: Callable[[Column, Column], Column] = term_overlap,
    tokens: Callable[[Column], Column] = lexical.terms, embed: retrievers.Embed = dense.hashed_embedding,
) -> DataFrame:
    """The arm's row per question (qid, query, query_class, and its texts if the arm has a
    transform) over chunks (id, text): retrieved, reranked against the question as it was
    asked, chunks joined to messages, held against ``relevant`` (qid, id)."""
    if arm.rerank not in rerank.ARMS:
        raise ValueError(f"unknown rerank arm {arm.rerank!r}; have {list(rerank.ARMS)}")
    if arm.transform == "none":
        run = retrievers.retrieve(arm.retriever, chunks, questions.select("qid", "query"), depth, arm.dense_weight, tokens, embed)
    else:
        run = transformed_run(arm, chunks, questions, depth, embed)
    spec = rerank.ARMS[arm.rerank]
    if spec:
        run = rerank.rerank(run, questions, chunks, spec[1], scorer)
    return metrics.per_query(fusion.collapse(run, key_of_chunk("id")), questions, relevant).withColumns(arm.columns())


def compare(arms: Sequence[Arm], chunkings: Mapping[str, DataFrame], questions: DataFrame, relevant: DataFrame, depth: int = 200, **how) -> DataFrame:
    """The metrics of every arm, over all questions and by class; one plan over all arms."""

    def row(arm: Arm) -> DataFrame:
        per = per_query(arm, chunkings[arm.chunking], questions, relevant, depth, **how)
        return metrics.summary(per).withColumns(arm.columns())

    return reduce(lambda a, b: a.unionByName(b), [row(a) for a in arms])
