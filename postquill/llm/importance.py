"""Quality by importance resampling.

Two bag-of-hashed-n-gram models, of the target text (documents labelled of good
quality) and of all raw text, give each document the log ratio of the two
likelihoods per n-gram, times the mean number of n-grams of all documents: the
importance weight of a text of mean length, so that length alone decides nothing.
Sampling without
replacement in proportion to these importance weights is Gumbel top-k: the ``k``
documents with the largest log weight plus Gumbel noise. The noise is a hash of
the id, so reruns agree; the k-th largest key is found by counting, 16 bits at a
time, so nothing is sorted in one task.

Raw counts cover all documents. The target model is fit on at most ``TARGET``
labelled documents drawn by a hash of the id; ``k`` is the corpus size times the
share of good labels among all labels.

Defined results: a null or wordless text has weight 0; repeated rows share a key
and are taken or left together, as are ties beyond the id; without labels
everything is selected; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from .bytekit import U64, buffers, fold_case, mix64, prefix_hash, slices, span_hash, words

BITS = 16
BUCKETS = 1 << BITS
TARGET = 20_000
SMOOTH = 1.0


def gram_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and texts of all one- and two-word n-grams."""
    folded = fold_case(buf)
    start, end, text = words(folded, offsets)
    one = span_hash(prefix_hash(folded), start, end)
    same = text[1:] == text[:-1]
    two = mix64(one[:-1][same] * U64(0xD1342543DE82EF95) + one[1:][same])
    shift = U64(64 - BITS)
    return (np.concatenate([one, two]) >> shift).astype(np.int64), np.concatenate([text, text[1:][same]])


def _parts(batch: pa.RecordBatch):
    buf, offsets = buffers(batch.column(1))
    for a, b in slices(offsets):
        yield a, b, *gram_buckets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        ids = shared.value
        for batch in batches:
            chosen = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), ids)
            for a, b, bucket, text in _parts(batch):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[chosen[a:b][text]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return run


def _weigh(shared, length: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            total, n = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for a, b, bucket, text in _parts(batch):
                total[a:b] = np.bincount(text, ratio[bucket], minlength=b - a)
                n[a:b] = np.bincount(text, minlength=b - a)
            weight = total / np.maximum(n, 1) * length
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(n)], names=["doc_id", "log_weight", "n_grams"])

    return run


def log_ratios(docs: DataFrame, labels: DataFrame, target: int = TARGET) -> tuple[np.ndarray, int]:
    """Log of target over raw share of every bucket, and the number of all n-grams."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"))
    ids = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target).toArrow().column(0).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(ids))
    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count(shared), "bucket int, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toArrow()  # at most BUCKETS rows
    raw, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = sums.column(0).to_numpy()
    raw[at], hit[at] = sums.column(1).to_numpy(), sums.column(2).to_numpy()
    # the target's share is shrunk towards the raw one where it has seen little
    share = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    strength = 50.0
    ratio = np.log((hit + strength * share * BUCKETS / 8) / (hit.sum() + strength * BUCKETS / 8)) - np.log(share) if hit.sum() else np.zeros(BUCKETS)
    return ratio, int(raw.sum())


def top_k(rows: DataFrame, key: str, id_: str, k: int) -> DataFrame:
    """``rows`` (written out) with ``selected``: whether a row is among the ``k``
    largest keys, ties to the smaller id; rows alike in both go together."""
    ordered = rows.withColumn("__k", F.col(key)).withColumn("__i", F.coalesce(F.col(id_), F.lit(-(1 << 63))))

    def threshold(df: DataFrame, column: str, need: int, largest: bool) -> tuple[int, int]:
        """The value of the ``need``-th row, and how many rows lie strictly before it."""
        base, before = None, 0
        for shift in (48, 32, 16, 0):
            high = F.shiftright(F.col(column), shift)
            part = df if base is None else df.where(F.shiftright(F.col(column), shift + 16) == base)
            counts = {r["h"]: r["n"] for r in part.groupBy(high.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 65,536 rows
            for h in sorted(counts, reverse=largest):
                if before + counts[h] >= need:
                    base = h
                    break
                before += counts[h]
        return base, before

    if k <= 0:
        return ordered.withColumn("selected", F.lit(False)).drop("__k", "__i")
    value, before = threshold(ordered, "__k", k, True)
    tied = ordered.where(F.col("__k") == value)
    last, _ = threshold(tied, "__i", k - before, False)
    chosen = (F.col("__k") > value) | ((F.col("__k") == value) & (F.col("__i") <= last))
    return ordered.withColumn("selected", chosen).drop("__k", "__i")


def resample(docs: DataFrame, labels: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected of every document."""
    ratio, n_grams = log_ratios(docs, labels)
    n = docs.count()
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    weighed = rows.mapInArrow(_weigh(shared, n_grams / max(n, 1)), "doc_id long, log_weight double, n_grams long")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    keyed = materialise(keyed.withColumn("order_key", F.round(F.col("gumbel_key") * (1 << 20)).cast("long")), "importance")
    share = labels.where(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    k = n if share is None else round(n * share)
    if not n:
        return keyed.select("doc_id", "log_weight", "n_grams", "gumbel_key", F.lit(True).alias("selected"))
    return top_k(keyed, "order_key", "doc_id", k).select("doc_id", "log_weight", "n_grams", "gumbel_key", "selected")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
