"""Stratified sampling of whole threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Size classes and the years that strata tell apart.
SIZE_CLASSES = ((1, "singleton"), (5, "small"), (20, "medium"))
FIRST_YEAR, LAST_YEAR = 1998, 2003


def thread_strata(messages: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """thread_id, n, stratum (year of the first dated message, size class)."""
    threads = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.year("date_utc")).alias("y"))
    size = F.lit("large")
    for most, name in reversed(SIZE_CLASSES):
        size = F.when(F.col("n") <= most, name).otherwise(size)
    year = F.when(F.col("y").isNotNull(), F.least(F.greatest(F.col("y"), F.lit(first_year)), F.lit(last_year))).otherwise(0)
    return threads.select("thread_id", "n", F.concat_ws(":", year.cast("string"), size).alias("stratum"))


def sample_threads(messages: DataFrame, target: int, seed: str, **years) -> DataFrame:
    """thread_id of the threads taken, about ``target`` messages in all.

    Threads of a stratum come in the order of a seeded hash and are taken while what
    was taken before is below the stratum's share; the gap that shares leave is
    filled from the rest in the same order. Both engines can compute md5, so the
    order is md5's.
    """
    lot = F.md5(F.concat(F.lit(seed), F.col("thread_id").cast("string")))
    strata = thread_strata(messages, **years).withColumn("lot", lot)
    whole = Window.partitionBy(F.lit(1))
    by_stratum = strata.groupBy("stratum").agg(F.sum("n").alias("s"))
    quota = by_stratum.withColumn("total", F.sum("s").over(whole)).select("stratum", "total", (F.lit(target) * F.col("s") / F.col("total")).alias("quota"))
    inside = Window.partitionBy("stratum").orderBy("lot", "thread_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = strata.join(F.broadcast(quota), "stratum").withColumn("taken", F.coalesce(F.sum("n").over(inside), F.lit(0)) < F.col("quota"))
    first = placed.where("taken OR total <= %d" % target)
    got = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("got"))
    # at most ``target`` further messages are needed, so only that many threads are ranked
    rest = placed.where("NOT taken AND total > %d" % target).orderBy("lot", "thread_id").limit(target)
    upto = Window.partitionBy(F.lit(1)).orderBy("lot", "thread_id").rowsBetween(Window.unboundedPreceding, -1)
    more = rest.withColumn("__before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("__k", F.lit(1)).join(got.withColumn("__k", F.lit(1)), "__k")
    more = more.where(F.col("got") + F.col("__before") < target)
    return first.select("thread_id", "n", "stratum").unionByName(more.select("thread_id", "n", "stratum"))
