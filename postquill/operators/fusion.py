"""Combining ranked lists. A run is (qid, run, id, score, rank); order is the rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import DIGITS

RRF_K = 60


def union_runs(*runs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [r.select("qid", "run", "id", "score", "rank") for r in runs])


def _final(scores: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = scores.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top_k) if top_k else out


def reciprocal_rank(runs: DataFrame, k: int = RRF_K, top_k: int = 0, run: str = "rrf") -> DataFrame:
    """Sum of 1 / (k + rank); scores are not looked at. ``top_k`` 0 keeps all."""
    fused = runs.groupBy("qid", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    return _final(fused, top_k).select("qid", F.lit(run).alias("run"), "id", "score", "rank")


def min_max(runs: DataFrame) -> DataFrame:
    """Scores of each run scaled to [0, 1]; a run of equal scores becomes all ones."""
    own = Window.partitionBy("qid", "run")
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    return runs.withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / F.nullif(hi - lo, F.lit(0.0))))


def weighted(runs: DataFrame, weights: dict[str, float], top_k: int = 0, run: str = "weighted") -> DataFrame:
    """Weighted sum of scaled scores; a list that lacks an id adds nothing. Every run
    must have a weight."""
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col("run") == name, w).otherwise(weight)
    weight = F.coalesce(weight, F.raise_error(F.concat(F.lit("no weight for run "), F.col("run"))).cast("double"))
    fused = min_max(runs).groupBy("qid", "id").agg(F.sum(weight * F.col("score")).alias("score"))
    return _final(fused, top_k).select("qid", F.lit(run).alias("run"), "id", "score", "rank")


def weight_sweep(runs: DataFrame, first: str, second: str, shares: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7), top_k: int = 0) -> DataFrame:
    """Weighted fusion for several weights of ``first`` in one plan: each scaled score
    is exploded over the weights, so runs are scanned and scaled once."""
    scaled = min_max(runs.where(F.col("run").isin(first, second)))
    each = scaled.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    part = F.when(F.col("run") == first, F.col("share")).otherwise(1 - F.col("share")) * F.col("score")
    fused = each.groupBy("share", "qid", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    order = Window.partitionBy("share", "qid").orderBy(F.desc("score"), "id")
    out = fused.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top_k) if top_k else out


def two_stage(runs: DataFrame, k: int = RRF_K, top_k: int = 0) -> DataFrame:
    """Runs (qid, modality, text_no, id, rank) fused within a modality, then across. A
    modality with one text keeps its ranks."""
    inner = runs.groupBy("qid", "modality", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    order = Window.partitionBy("qid", "modality").orderBy(F.round("score", 9).desc(), "id")
    again = inner.withColumn("rank", F.row_number().over(order)).withColumnRenamed("modality", "run")
    return reciprocal_rank(again, k, top_k)


def collapse(runs: DataFrame, key, top_n: int = 0) -> DataFrame:
    """Chunks to messages: the first position of each key, positions closed up."""
    first = runs.withColumn("key", key).groupBy("qid", "key").agg(F.min("rank").alias("first_rank"), F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy("first_rank", "key")
    out = first.withColumn("rank", F.row_number().over(order)).select("qid", F.col("key").alias("id"), "score", "rank", "first_rank")
    return out.where(F.col("rank") <= top_n) if top_n else out


def collapse_display(runs: DataFrame, key, texts: DataFrame, top_n: int = 0) -> DataFrame:
    """As :func:`collapse`, with the message's chunk ids and texts in rank order; a text
    that is part of what was shown already is left out."""
    rows = runs.withColumn("key", key).join(texts.select("id", "text"), "id", "left")
    parts = F.sort_array(F.collect_list(F.struct("rank", "id", F.coalesce("text", F.lit("")).alias("text"))))
    grouped = rows.groupBy("qid", "key").agg(F.min("rank").alias("first_rank"), parts.alias("p"))

    def add(shown, x):
        have = F.array_join(shown, "\n")
        return F.when((x["text"] == "") | (F.instr(have, x["text"]) > 0), shown).otherwise(F.concat(shown, F.array(x["text"])))

    shown = F.aggregate("p", F.array().cast("array<string>"), add)
    order = Window.partitionBy("qid").orderBy("first_rank", "key")
    out = grouped.select("qid", "key", "first_rank", F.row_number().over(order).alias("rank"), F.transform("p", lambda x: x["id"]).alias("chunk_ids"), F.array_join(shown, "\n\n").alias("text"))
    return out.where(F.col("rank") <= top_n) if top_n else out


def pool(runs: DataFrame, k: int, extra: DataFrame | None = None) -> DataFrame:
    """Candidates for labelling: union of runs and extra ids, best rank, provenance."""
    rows = runs.select("qid", "run", "id", "rank")
    if extra is not None:
        rows = rows.unionByName(extra.select("qid", F.lit("source").alias("run"), "id", F.lit(0).alias("rank")))
    best = rows.groupBy("qid", "id").agg(F.min("rank").alias("best"), F.array_join(F.array_sort(F.collect_set("run")), "+").alias("found_by"))
    order = Window.partitionBy("qid").orderBy("best", "id")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
