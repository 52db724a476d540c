"""Corpus operators: deduplication, bulk and broadcast filtering, incremental merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_bulk

BLAST_THRESHOLD = 25


def first_copies(messages: DataFrame, key: str = "dedup_key", order: str = "source_path") -> DataFrame:
    """One row per key: the first by ``order``. Copies are compared within partitions
    before the shuffle, so a key with very many copies sends a row per partition."""
    best = messages.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*messages.columns), F.struct(F.col(order), F.xxhash64(*messages.columns))).alias("__row"))
    return best.select("__row.*")


def dedup_and_filter(messages: DataFrame, seen: DataFrame | None = None, keep_bulk: bool = False, order: str = "source_path") -> DataFrame:
    """First copies whose key is not in ``seen``, without bulk mail. A bulk first copy
    still suppresses later copies, so the bulk test comes after deduplication."""
    fresh = messages if seen is None else messages.join(seen.select("dedup_key").distinct(), "dedup_key", "left_anti").select(*messages.columns)
    kept = first_copies(fresh, order=order)
    return kept if keep_bulk else kept.where(~is_bulk())


def funnel(messages: DataFrame, order: str = "source_path") -> DataFrame:
    """n_parsed, n_dupe, n_bulk, n_kept in one pass over the first copies."""
    first = first_copies(messages, order=order)
    counts = first.agg(F.count(F.lit(1)).alias("n_distinct"), F.count_if(is_bulk()).alias("n_bulk"))
    total = messages.agg(F.count(F.lit(1)).alias("n_parsed"))
    both = total.withColumn("k", F.lit(1)).join(counts.withColumn("k", F.lit(1)), "k")
    return both.select("n_parsed", (F.col("n_parsed") - F.col("n_distinct")).alias("n_dupe"), "n_bulk", (F.col("n_distinct") - F.col("n_bulk")).alias("n_kept"))


def recurring_blasts(messages: DataFrame, threshold: int = BLAST_THRESHOLD) -> DataFrame:
    """(sender, subject_norm, n) pairs that recur at least ``threshold`` times."""
    pairs = messages.where(F.coalesce("subject_norm", F.lit("")) != "").groupBy("sender", "subject_norm")
    return pairs.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def drop_blasts(messages: DataFrame, threshold: int = BLAST_THRESHOLD) -> DataFrame:
    return messages.join(recurring_blasts(messages, threshold).drop("n"), ["sender", "subject_norm"], "left_anti").select(*messages.columns)


def merge_messages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """UNION ALL; thread ids are dropped, as threads are assigned anew."""
    return existing.drop("thread_id").unionByName(new.drop("thread_id"), allowMissingColumns=True)


def new_bulk_rows(raw: DataFrame, seen: DataFrame) -> DataFrame:
    """Count-only rows of bulk messages not seen before."""
    fresh = raw.join(seen.select("dedup_key").distinct(), "dedup_key", "left_anti")
    return fresh.where(is_bulk()).groupBy("dedup_key").agg(F.min("date_utc").alias("date_utc"), F.min("sender").alias("sender"))


def late_materialise(light: DataFrame, bodies: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Wide rows of the keys that survived work on light columns."""
    return bodies.join(light.select(key).distinct(), key, "left_semi")


def corpus_end(messages: DataFrame, share: float = 0.99, date: str = "date_utc") -> DataFrame:
    """The date at index ``min(int(n * share), n - 1)`` of the ascending dates: an anchor
    that a few garbage dates do not move. Counted per day, so only days are sorted."""
    days = messages.where(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))
    upto = days.withColumn("upto", F.sum("n").over(whole.orderBy("day"))).withColumn("total", F.sum("n").over(whole))
    index = F.least(F.floor(F.col("total") * F.lit(share)), F.col("total") - 1)
    return upto.where(F.col("upto") > index).agg(F.min("day").alias("corpus_end"))
