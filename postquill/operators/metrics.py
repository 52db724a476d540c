"""Retrieval quality as aggregations. What is undefined is null, never zero or NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def nearest(values: Column, share: float) -> Column:
    """The value at index ``min(int(n * share), n - 1)`` of the ascending values."""
    v = F.sort_array(values)
    index = F.least(F.floor(F.size(v) * F.lit(share)), F.size(v) - 1).cast("int")
    return F.when(F.size(v) > 0, F.get(v, index))


def per_query(runs: DataFrame, queries: DataFrame, relevant: DataFrame, recalls: tuple[int, ...] = (5, 20), ndcg: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """One row per query (qid, query_class): found_at, n_relevant and its metrics.

    ``runs`` are ranked messages (qid, id, rank), ``relevant`` pairs (qid, id). Only
    hits leave the join; the ideal gain is an expression of the number relevant. Where
    ``counts`` has that number (qid, n_relevant), the pairs need only name what runs hold.
    """
    rel = relevant.select("qid", "id").distinct()
    n = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant")) if counts is None else counts.select("qid", "n_relevant").where("n_relevant > 0")
    hits = runs.select("qid", "id", "rank").join(rel, ["qid", "id"])
    gain = F.when(F.col("rank") <= ndcg, 1 / F.log2(F.col("rank") + 1))
    aggs = [F.min("rank").alias("found_at"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"), *[F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in recalls]]
    got = hits.groupBy("qid").agg(*aggs)
    rows = queries.select("qid", "query_class").join(n, "qid", "left").join(got, "qid", "left")
    many = F.coalesce("n_relevant", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(many, F.lit(ndcg)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    has = many > 0
    return rows.select(
        "qid", "query_class", many.alias("n_relevant"), "found_at",
        *[F.when(has, F.coalesce(F.col(f"hit_{k}"), F.lit(0)) / many).alias(f"recall_{k}") for k in recalls],
        F.when(has, F.coalesce(1 / F.col("found_at"), F.lit(0.0))).alias("rr"),
        F.when(has, F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def summary(per: DataFrame, recalls: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Means over answerable queries, overall and per class in one grouping pass."""
    means = [F.round(F.avg(c), DIGITS).alias(c) for c in (*[f"recall_{k}" for k in recalls], "rr", "ndcg")]
    rolled = per.rollup("query_class").agg(F.grouping("query_class").alias("g"), F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("n_relevant") > 0).alias("n_answerable"), *means)
    return rolled.withColumn("query_class", F.when(F.col("g") == 1, "all").otherwise(F.col("query_class"))).drop("g")


def latency(rows: DataFrame, by: list[str], ms: str = "latency_ms") -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(ms).alias("v")).select(*by, nearest(F.col("v"), 0.5).alias("p50"), nearest(F.col("v"), 0.95).alias("p95"))


def chunk_ranks(runs: DataFrame, relevant: DataFrame, key: Column, most: int = 8) -> DataFrame:
    """Positions of the relevant messages' chunks before collapsing, the first ``most``."""
    hits = runs.withColumn("key", key).join(relevant.select("qid", F.col("id").alias("key")).distinct(), ["qid", "key"])
    return hits.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "id"))), 1, most).alias("chunks"))


def gain_over(rows: DataFrame, arm: Column, baseline: str, metrics: list[str]) -> DataFrame:
    """Each metric less that of the baseline arm; null without one."""
    base = rows.where(arm == baseline).select(F.lit(1).alias("__k"), *[F.col(m).alias(f"__{m}") for m in metrics]).limit(1)
    both = rows.withColumn("__k", F.lit(1)).join(base, "__k", "left")
    return both.select(*rows.columns, *[F.round(F.col(m) - F.col(f"__{m}"), DIGITS).alias(f"{m}_gain") for m in metrics])


def best_row(rows: DataFrame, metric: str, key: str) -> DataFrame:
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct(metric, key)).alias("r")).select("r.*")


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks for ties; 0 without variance. Ranks come from
    counts per value, so equal values are aggregated before anything is ordered."""
    def ranks(c: str) -> DataFrame:
        n = pairs.groupBy(F.col(c).alias(f"__{c}")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(f"__{c}"))
        return n.select(f"__{c}", (upto - (F.col("n") - 1) / 2).alias(f"r_{c}"))

    both = pairs.join(ranks(a), F.col(a) == F.col(f"__{a}")).join(ranks(b), F.col(b) == F.col(f"__{b}"))
    x, y = F.col(f"r_{a}"), F.col(f"r_{b}")
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    cov, vx, vy = (F.col("n") * F.col(p) - F.col(q) * F.col(r) for p, q, r in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")))
    return sums.select("n", F.when((vx > 0) & (vy > 0), F.round(cov / F.sqrt(vx) / F.sqrt(vy), DIGITS)).otherwise(0.0).alias("rho"))


def cohens_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(observed - expected) / (1 - expected) agreement; null if chance explains all."""
    table = pairs.groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    label = F.explode(F.array(F.struct(F.col("x").alias("l"), F.col("n").alias("nx"), F.lit(0).cast("long").alias("ny"), F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0).alias("same")), F.struct(F.col("y").alias("l"), F.lit(0).cast("long").alias("nx"), F.col("n").alias("ny"), F.lit(0).cast("long").alias("same"))))
    by = table.select(label.alias("s")).groupBy("s.l").agg(F.sum("s.nx").alias("nx"), F.sum("s.ny").alias("ny"), F.sum("s.same").alias("same"))
    tot = by.agg(F.sum("nx").alias("n"), F.sum("same").alias("same"), F.sum(F.col("nx").cast("double") * F.col("ny")).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / F.col("n") / F.col("n")
    return tot.select("n", F.round(po, DIGITS).alias("observed"), F.round(pe, DIGITS).alias("expected"), F.when(pe < 1, F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), DIGITS)).alias("kappa"))


def date_scores(pairs: DataFrame) -> DataFrame:
    """Accuracy of predicted against gold dates (columns gold, predicted, ambiguous,
    alternative). A gold date without prediction is missing and counts in n; a
    prediction without gold is spurious and does not."""
    g, p = F.col("gold"), F.col("predicted")
    n = F.count_if(g.isNotNull())
    exact = F.count_if(g == p)
    return pairs.agg(
        n.alias("n"), exact.alias("exact"), F.count_if(F.abs(F.datediff(g, p)) <= 1).alias("within_1d"),
        F.count_if((g == p) | (g == F.col("alternative"))).alias("either_reading"), F.count_if(g.isNotNull() & p.isNotNull() & F.col("ambiguous")).alias("ambiguous"),
        F.count_if(g.isNotNull() & p.isNull()).alias("missing"), F.count_if(g.isNull() & p.isNotNull()).alias("spurious"),
        F.round(exact / F.nullif(n, F.lit(0)), DIGITS).alias("exact_rate"),
    )


def route_scores(decisions: DataFrame) -> DataFrame:
    """Per class (null: overall) of rows (query_class, route): ``both`` is right but
    over-routed; unanswerable questions are left out."""
    want = F.when(F.col("query_class") == "temporal", "sql").otherwise("hybrid")
    rows = decisions.where(F.col("query_class") != "unanswerable").withColumn("ok", (F.col("route") == want) | (F.col("route") == "both"))
    rolled = rows.rollup("query_class").agg(F.grouping("query_class").alias("g"), F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct"), F.count_if(F.col("route") == "both").alias("over_routed"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("query_class")).alias("query_class"), "n", "correct", "over_routed", F.round(F.col("correct") / F.col("n"), DIGITS).alias("accuracy"))
