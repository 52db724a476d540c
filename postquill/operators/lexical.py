"""BM25 over a chunk table: document frequencies by a join, then chunks scored whole in tiles.

A chunk's score needs its own words only, so pairs of a question and a chunk cross no shuffle:
a task holds the weights of some questions, adds up those of its chunks' words and passes on
the best. Chunks whose id is there twice are scored as one, by joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import tiles

# Fixed values of the common default configuration.
K1, B = 1.5, 0.75
TOKEN = r"\w\w+"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
DIGITS = 6
#: Questions that a task holds, chunks that it reads.
QUERY_GROUP, PART_ROWS = 256, 65536
#: Between a chunk's tokens on their way to a task; no token holds it.
_SEP = "\x1f"


def terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def ranked(scores: DataFrame, k: int, run: str, id_: str = "id") -> DataFrame:
    """qid, run, id, score, rank with ties to the smaller id; score rounded first."""
    rounded = scores.withColumn("score", F.round("score", DIGITS))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), id_)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", F.lit(run).alias("run"), F.col(id_).alias("id"), "score", "rank")


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 100, keep_zero: bool = True, k1: float = K1, b: float = B, tokens: Callable[[Column], Column] = terms) -> DataFrame:
    """The ``k`` best chunks (id, text) of every query (qid, query).

    Tokens are taken once and kept; document frequencies are counted for the terms that
    some query has. A query's repeated term counts each time. With ``keep_zero`` a run has
    ``min(k, N)`` rows, padded with score 0 by id.
    """
    asked = asked_terms(queries, tokens)
    docs = materialise(chunks.select("id", tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t")), "tokens")
    n, avgdl = docs.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    once, twice = _by_id(docs.where("dl > 0"))
    postings = twice.select("id", "dl", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    held = once.select(F.explode(F.array_distinct("t")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = held.unionByName(postings.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = materialise(df, "frequencies")
    weight = asked.join(df, "term").select("qid", "term", (F.col("qtf") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    weight = weight.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("s"))  # a question's words
    norm = F.array(k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    found = _in_tiles(once.withColumn("values", norm), weight.select("qid", F.col("s.term").alias("t"), F.col("s.w").alias("values")), n, k, _weighed)
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    best = ranked(found.unionByName(scored(postings, df, stats, asked, k1, b)), k, "bm25")
    return padded(best, docs, queries, k, "bm25") if keep_zero else best


def _by_id(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is there once, and the others."""
    many = materialise(docs.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id"), "ids-twice")
    if many.isEmpty():
        return docs, docs.where(F.lit(False))
    same = F.col("id").eqNullSafe(F.col("__id"))
    return docs.join(many, same, "left_anti"), docs.join(many, same, "left_semi")


def _in_tiles(docs: DataFrame, asked: DataFrame, n: int, k: int, make: tiles.Maker) -> DataFrame:
    """(qid, id, score) of docs (id, t, values) for questions (qid, t, values)."""
    asked = materialise(asked, "asked")
    shape = lambda rows, key: rows.select(key, F.lit(0).alias("size"), F.array_join("t", _SEP).alias("words"), "values")
    return tiles.search(shape(docs, "id"), n, shape(asked, "qid"), asked.count(), k, make, PART_ROWS, QUERY_GROUP, floor=0.0)


def _sums(words: pa.Array, weights: np.ndarray | float, part: Callable[[np.ndarray, np.ndarray, pa.Array], np.ndarray], scale: np.ndarray | float = 1.0) -> Callable[[pa.Array, pa.Array], tiles.Scores]:
    """Scores of rows by the weights that questions give to words, times ``part`` of the words'
    numbers in their rows, those rows and all values, over the question's ``scale``."""
    lists = pc.split_pattern(words, _SEP)
    asked = len(lists)
    known = pc.unique(lists.flatten())
    matrix = np.zeros((len(known), len(lists)))
    matrix[pc.index_in(lists.flatten(), value_set=known).to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())] = weights

    def scores(words: pa.Array, values: pa.Array) -> tiles.Scores:
        lists = pc.split_pattern(words, _SEP)
        col = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        cell, tf = np.unique(row[col >= 0] * len(known) + col[col >= 0], return_counts=True)
        row, col = np.divmod(cell, max(len(known), 1))
        share = part(tf, row, values)
        numbers, first = np.unique(row, return_index=True)
        first, step = np.r_[first, len(row)], max(1, tiles.HELD // asked)
        a = 0
        while a < len(numbers):
            b = max(a + 1, int(np.searchsorted(first, first[a] + step, "right")) - 1)
            these = slice(first[a], first[b])
            yield numbers[a:b], np.add.reduceat(matrix[col[these]] * share[these, None], first[a:b] - first[a]) / scale
            a = b

    return scores


def _weighed(words: pa.Array, values: pa.Array) -> Callable[[pa.Array, pa.Array], tiles.Scores]:
    return _sums(words, values.flatten().to_numpy(), lambda tf, row, values: tf / (tf + values.flatten().to_numpy()[row]))


def _shares(words: pa.Array, values: pa.Array) -> Callable[[pa.Array, pa.Array], tiles.Scores]:
    return _sums(words, 1.0, lambda tf, row, _: np.ones(len(tf)), values.flatten().to_numpy())


def asked_terms(queries: DataFrame, tokens: Callable[[Column], Column] = terms) -> DataFrame:
    """qid, term and how often the query has it."""
    return queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scored(postings: DataFrame, df: DataFrame, stats: DataFrame, asked: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, score from postings (term, id, dl, tf), document frequencies (term, df)
    and one row of statistics (n, avgdl)."""
    one = F.lit(1).alias("__k")
    weights = df.select("*", one).join(stats.select("*", one), "__k").select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(weights, "term").join(asked, "term").groupBy("qid", "id").agg(F.sum(part).alias("score"))


def padded(best: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, run: str) -> DataFrame:
    """Fills every query's run up to ``min(k, N)`` rows with score 0, smaller ids first.
    The first ``2 k`` ids are enough, as at most ``k`` of them can be in the run."""
    first = chunks.select("id").distinct().orderBy("id").limit(2 * k)
    ids = first.agg(F.collect_list("id").alias("__ids"))  # at most 2 k values
    got = best.groupBy("qid").agg(F.collect_list("id").alias("__got"), F.max("rank").alias("__n"))
    short = queries.select("qid").distinct().join(got, "qid", "left").select("qid", F.coalesce("__got", F.array().cast(got.schema["__got"].dataType)).alias("__got"), F.coalesce("__n", F.lit(0)).alias("__n")).where(F.col("__n") < k)
    one = F.lit(1).alias("__k")
    fill = short.select("*", one).join(ids.select("*", one), "__k")
    free = F.slice(F.filter(F.sort_array("__ids"), lambda x: ~F.array_contains(F.col("__got"), x)), F.lit(1), F.lit(k) - F.col("__n"))
    more = fill.select("qid", "__n", F.posexplode(free).alias("__p", "id")).select("qid", F.lit(run).alias("run"), "id", F.lit(0.0).alias("score"), (F.col("__n") + F.col("__p") + 1).alias("rank"))
    return best.unionByName(more)


def overlap_run(chunks: DataFrame, queries: DataFrame, k: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """Chunks ranked by the share of the query's distinct terms that they hold."""
    docs = materialise(chunks.select("id", F.array_distinct(tokens(F.col("text"))).alias("t"), F.array(F.lit(0.0)).alias("values")), "terms")
    asked = queries.select("qid", F.array_distinct(tokens(F.col("query"))).alias("t")).where(F.size("t") > 0)
    once, twice = _by_id(docs.where(F.size("t") > 0))
    found = _in_tiles(once, asked.withColumn("values", F.array(F.size("t").cast("double"))), docs.count(), k, _shares)
    hits = twice.select("id", F.explode("t").alias("term")).join(asked.select("qid", F.size("t").alias("__n"), F.explode("t").alias("term")), "term").groupBy("qid", "id", "__n").agg(F.count(F.lit(1)).alias("__hit"))
    return ranked(found.unionByName(hits.select("qid", "id", (F.col("__hit") / F.col("__n")).alias("score"))), k, "overlap")
