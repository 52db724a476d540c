"""Exact and approximate vector search over a table of (id, embedding)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .lexical import ranked

#: Queries that a task holds.
QUERY_BATCH = 4096
#: Vectors that a task reads.
BLOCK_ROWS = 131072
#: Length of the stand-in embedding.
DIM = 64


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, inside code generation."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int = 100, query_batch: int = QUERY_BATCH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k of every query (qid, vector) among the vectors (id, embedding).

    Vectors are dealt into parts of at most about ``block_rows``, queries into groups of
    about ``query_batch``; each pair of both is scored by matrix products in one task, which
    holds its queries and some scores and passes on ``k`` a query. Nothing is collected.
    Vectors and queries that are null, empty or hold a null or non-finite component take no
    part, and a vector of another length than the query is no candidate of it. Where all are
    floats they travel as floats.
    """
    single = all(rows.schema[c].dataType.simpleString() == "array<float>" for rows, c in ((vectors, "embedding"), (queries, "vector")))

    def whole(rows: DataFrame, id_: str, vector: str) -> DataFrame:
        wide = rows.select(F.col(id_), F.col(vector).cast("array<float>" if single else "array<double>").alias("values"))
        fine = wide.where(F.col("values").isNotNull() & (F.size("values") > 0) & F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        return fine.select(id_, F.size("values").alias("size"), F.lit(None).cast("string").alias("words"), "values")

    found = tiles.search(whole(vectors, "id", "embedding"), vectors.count(), whole(queries, "qid", "vector"), queries.count(), k, tiles.products, block_rows, query_batch)
    return ranked(found, k, "dense")


def search(vectors: DataFrame, query: DataFrame, k: int = 100) -> DataFrame:
    """Exact top-k of one or a few queries: the same plan."""
    return search_batch(vectors, query, k)


def dimension_problems(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has another length than the index."""
    return vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dim))


def norm_problems(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Rows whose vector is not of unit length; inner product is cosine only without any."""
    return vectors.withColumn("norm", F.sqrt(dot("embedding", "embedding"))).where(F.abs(F.col("norm") - 1) > tolerance)


def ivf_build(vectors: DataFrame, cells: int = 16, seed: int = 7, sample: int = 10_000) -> tuple[DataFrame, list[list[float]]]:
    """An inverted file: every vector with the cell of its nearest centre. Centres come
    from k-means on at most ``sample`` vectors, all vectors are placed."""
    few = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow().column(0).to_pylist()
    x = np.array(few, np.float64)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(15):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
                centres[c] /= max(np.linalg.norm(centres[c]), 1e-12)
    scores = F.array(*[dot("embedding", F.array(*[F.lit(float(v)) for v in c])) for c in centres])
    placed = vectors.withColumn("cell", F.array_position(scores, F.array_max(scores)).cast("int") - 1)
    return placed, centres.tolist()


def ivf_search(placed: DataFrame, centres: list[list[float]], queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Top-k within the ``probes`` nearest cells of each query; the join on the cell
    prunes partitions where the table is stored by cell."""
    near = F.array(*[F.struct((-dot("vector", F.array(*[F.lit(float(v)) for v in c]))).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centres)])
    asked = queries.select("qid", "vector", F.explode(F.slice(F.sort_array(near), 1, probes)).alias("p")).select("qid", "vector", "p.cell")
    pairs = placed.join(asked, "cell")
    return ranked(pairs.select("qid", "id", dot("embedding", "vector").alias("score")), k, "ivf")


def ann_recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """mean and worst overlap with the exact run, and how often the first agrees."""
    gold = exact.groupBy("qid").agg(F.collect_set("id").alias("g"), F.min_by("id", "rank").alias("g1"))
    mine = approx.groupBy("qid").agg(F.collect_set("id").alias("a"), F.min_by("id", "rank").alias("a1"))
    per = gold.join(mine, "qid", "left").select((F.coalesce(F.size(F.array_intersect("g", "a")), F.lit(0)) / F.size("g")).alias("recall"), F.coalesce(F.col("g1") == F.col("a1"), F.lit(False)).alias("first"))
    return per.agg(F.avg("recall").alias("mean_recall"), F.min("recall").alias("worst_recall"), F.avg(F.col("first").cast("int")).alias("top1_agreement"))


def unit(vector: Column | str) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def hashed_embedding(rows: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """(key, embedding) of rows with words: a deterministic stand-in for an encoder, the
    signed counts of hashed words at unit length. Counts are summed before any shuffle."""
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\w\w+"), F.lit(0)))
    hashed = rows.select(key, word.alias("w")).select(key, F.md5("w").alias("h"))
    digit = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("int")
    sums = hashed.groupBy(key, (digit(1, 4) % dim).alias("d")).agg(F.sum(F.when(digit(5, 1) % 2 == 0, 1.0).otherwise(-1.0)).alias("v"))
    entries = F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m")  # at most ``dim``
    by_key = sums.groupBy(key).agg(entries, F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    norm = F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))
    return by_key.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / norm).alias("embedding"))


def top_k_window(scores: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank of the best ``k`` rows a query."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
