"""Retrievers by name: one plan over all questions each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stemmed_texts
from ..session import materialise
from . import dense, fusion, lexical

Embed = Callable[[DataFrame, str, str], DataFrame]


def sparse_run(chunks: DataFrame, questions: DataFrame, depth: int, tokens: Callable[[Column], Column] = lexical.terms) -> DataFrame:
    return lexical.bm25(chunks, questions, depth, keep_zero=False, tokens=tokens)


def stemmed_run(chunks: DataFrame, questions: DataFrame, depth: int, tokens: Callable[[Column], Column] = lexical.terms) -> DataFrame:
    """BM25 over English stems; stems are single tokens already, so they are split at spaces."""
    stems = lambda text: F.filter(F.split(text, " "), lambda t: t != "")
    asked = stemmed_texts(questions, tokens, "qid", "query")
    return lexical.bm25(stemmed_texts(chunks, tokens), asked, depth, keep_zero=False, tokens=stems)


def dense_run(chunks: DataFrame, questions: DataFrame, depth: int, embed: Embed = dense.hashed_embedding) -> DataFrame:
    """``embed`` maps (rows, key, text column) to (key, embedding); any encoder fits."""
    asked = embed(questions, "qid", "query").select("qid", F.col("embedding").alias("vector"))
    return dense.search_batch(materialise(embed(chunks, "id", "text"), "vectors"), asked, depth)  # counted, then searched


def _hybrid(fuse) -> Callable:
    def run(chunks: DataFrame, questions: DataFrame, depth: int, dense_weight: float, tokens, embed) -> DataFrame:
        return fuse(fusion.union_runs(dense_run(chunks, questions, depth, embed), sparse_run(chunks, questions, depth, tokens)), depth, dense_weight)

    return run


RETRIEVERS: dict[str, Callable] = {
    "bm25": lambda chunks, questions, depth, _, tokens, embed: sparse_run(chunks, questions, depth, tokens),
    "bm25_stemmed": lambda chunks, questions, depth, _, tokens, embed: stemmed_run(chunks, questions, depth, tokens),
    "dense": lambda chunks, questions, depth, _, tokens, embed: dense_run(chunks, questions, depth, embed),
    "hybrid_rrf": _hybrid(lambda runs, depth, _: fusion.reciprocal_rank(runs, top_k=depth)),
    "hybrid_weighted": _hybrid(lambda runs, depth, w: fusion.weighted(runs, {"dense": w, "bm25": 1 - w}, depth)),
}


def retrieve(
    name: str, chunks: DataFrame, questions: DataFrame, depth: int = 200, dense_weight: float = 0.5,
    tokens: Callable[[Column], Column] = lexical.terms, embed: Embed = dense.hashed_embedding,
) -> DataFrame:
    """The run of retriever ``name`` over chunks (id, text) for questions (qid, query).

    Questions and chunks without words have no dense run. An unknown name is an error.
    """
    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name!r}; one of {', '.join(RETRIEVERS)}")
    return RETRIEVERS[name](chunks, questions, depth, dense_weight, tokens, embed)
