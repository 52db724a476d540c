"""Sketches kept per day and group, merged over any window of days.

Distinct counts are HyperLogLog sketches, percentiles KLL sketches; both are plain binary
columns of a table, made once when a day is complete. A window reads the sketches of its
days only. With ``LG_K`` = 12 the standard error of a distinct count is 1.6 %; with ``K`` = 200
a quantile's rank is off by about 1.3 % of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 200


def daily(rows: DataFrame, ts: str, by: list[str], counted: str, measured: str) -> DataFrame:
    """A row for each day and group: how many rows, who (a sketch), and how much (a sketch)."""
    day = F.to_date(ts).alias("day")
    return rows.where(F.col(ts).isNotNull()).groupBy(day, *by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(counted, F.lit(LG_K)).alias("who"), F.kll_sketch_agg_double(F.col(measured).cast("double"), F.lit(K)).alias("how_much"),
    )


def merged(sketches: DataFrame, window: Column, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Per ``window`` (an expression of day) and group: n, distinct, and one column a quantile."""
    whole = sketches.groupBy(window.alias("window"), *by).agg(F.sum("n").alias("n"), F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("how_much").alias("how_much"))
    at = [F.kll_sketch_get_quantile_double("how_much", F.lit(float(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    return whole.select("window", *by, "n", F.hll_sketch_estimate("who").alias("distinct"), *at)


def rank_errors(found: DataFrame, rows: DataFrame, window: Column, by: list[str], measured: str, quantile: float) -> DataFrame:
    """For each window and group: how far the rank of its estimated quantile is from the one
    asked for, as a share of the rows; ties count as far as they reach."""
    name = f"q{round(quantile * 100)}"
    exact = rows.select(window.alias("window"), *by, F.col(measured).cast("double").alias("x")).where("x IS NOT NULL")
    both = exact.join(found.select("window", *by, name), ["window", *by])
    sums = both.groupBy("window", *by).agg(F.avg((F.col("x") < F.col(name)).cast("int")).alias("below"), F.avg((F.col("x") <= F.col(name)).cast("int")).alias("upto"))
    return sums.select("window", *by, F.greatest(F.lit(0.0), F.col("below") - quantile, quantile - F.col("upto")).alias("rank_error"))
