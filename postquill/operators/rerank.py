"""Second-stage ranking: the head is scored anew, the tail keeps its order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import term_overlap
from ..session import materialise
from .lexical import DIGITS
from .scoring import BATCH, Loader, score_pairs, times, token_similarity

#: Fixed values. Named arms: model, passages scored, tokens read, whole-number weights. Models are plugged in by name.
ARMS = {
    "none": None,
    "L6@50": ("cross-encoder/ms-marco-MiniLM-L-6-v2", 50, 512, False),
    "L6@20": ("cross-encoder/ms-marco-MiniLM-L-6-v2", 20, 512, False),
    "L6@20/t192": ("cross-encoder/ms-marco-MiniLM-L-6-v2", 20, 192, False),
    "L2@20/t192": ("cross-encoder/ms-marco-MiniLM-L-2-v2", 20, 192, False),
    "L2@10": ("cross-encoder/ms-marco-MiniLM-L-2-v2", 10, 300, False),
    "L6@20-onnx": ("cross-encoder/ms-marco-MiniLM-L-6-v2", 20, 512, True),
    "bge@50": ("BAAI/bge-reranker-base", 50, 512, False),
}
DEFAULT_ARMS = ("none", "L6@20", "L6@20/t192", "L2@20/t192")


def relevance(logits: Column) -> Column:
    """One logit is the relevance itself; of two, the second less the first."""
    return (
        F.when(F.size(logits) == 1, F.get(logits, F.lit(0))).when(F.size(logits) == 2, F.get(logits, F.lit(1)) - F.get(logits, F.lit(0)))
        .otherwise(F.raise_error(F.lit("a scorer gives one or two logits")).cast("double"))
    )


def rerank(runs: DataFrame, queries: DataFrame, texts: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = term_overlap) -> DataFrame:
    """``scorer`` (an expression of query and passage, a pandas UDF included) orders the
    first ``k``. Passages without text go to the front of the tail; tail scores
    fall by one from below the lowest head score, so scores stay monotone."""
    head = _head(runs, queries, texts, k)
    scored = head.select("qid", "id", "rank", F.when(F.col("text").isNotNull(), F.round(scorer(F.col("query"), F.col("text")).cast("double"), DIGITS)).alias("new"))
    return _placed(runs, scored, k)


def rerank_batched(runs: DataFrame, queries: DataFrame, texts: DataFrame, k: int, load: Loader = token_similarity, batch: int = BATCH, max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(run, times): as ``rerank``, by a loaded scorer that takes a batch of pairs at a time.
    ``times`` has the passages and the scorer's milliseconds of every query. Pairs are scored
    once and kept."""
    head = _head(runs, queries, texts, k)
    scored = materialise(score_pairs(head, load, batch, max_tokens), "scored")
    new = runs.where(F.col("rank") <= k).join(scored.select("qid", "id", F.round(relevance(F.col("logits")), DIGITS).alias("new")), ["qid", "id"], "left")
    return _placed(runs, new.select("qid", "id", "rank", "new"), k), times(scored)


def _head(runs: DataFrame, queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    return runs.where(F.col("rank") <= k).join(queries.select("qid", "query"), "qid").join(texts.select("id", "text"), "id", "left")


def _placed(runs: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    rest = runs.where(F.col("rank") > k).select("qid", "id", "rank", F.lit(None).cast("double").alias("new"))
    both = scored.unionByName(rest)
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("new"), "rank", "id")
    whole = Window.partitionBy("qid")
    placed = both.select("qid", "id", "new", F.row_number().over(order).alias("rank"), F.min("new").over(whole).alias("lo"), F.count("new").over(whole).alias("n"))
    tail = F.coalesce("lo", F.lit(0.0)) - (F.col("rank") - F.col("n"))
    return placed.select("qid", F.lit("rerank").alias("run"), "id", F.coalesce("new", tail).alias("score"), "rank")
