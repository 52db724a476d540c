"""Indexes that are kept: postings and vectors as tables, built once and searched often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.tables import read_if_there
from . import lexical
from .chunking import id_differences
from .dense import hashed_embedding
from .retrievers import Embed

#: Up to this many asked terms are pushed to the scan as a filter, more are joined.
PUSHED_TERMS = 1000


def text_key(text: Column | str) -> Column:
    """Tells whether a text has changed since it was indexed; a null text is empty."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def build_lexical(chunks: DataFrame, root: str, tokens: Callable[[Column], Column] = lexical.terms) -> str:
    """Writes the BM25 index of chunks (id, text) as a new version and returns its folder.

    Postings are dealt by ranges of (term, id): a search reads the files of its terms
    only, and a very common term is split over several.
    """
    spark, version = chunks.sparkSession, versions.new_version()
    at = f"{root}/{version}"
    docs = chunks.select("id", text_key("text").alias("of"), tokens(F.col("text")).alias("__t")).withColumn("dl", F.size("__t"))
    docs.select("id", "of", "dl").write.option("compression", "zstd").parquet(f"{at}/docs")
    counted = docs.select("id", "dl", F.explode("__t").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    counted.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("compression", "zstd").parquet(f"{at}/postings")
    held = spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    held.repartitionByRange("term").sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{at}/terms")
    versions.publish(spark, root, version)
    return at


def stale(chunks: DataFrame, root: str) -> bool:
    """Whether the index is missing, or its chunks or their texts are not these."""
    found = versions.current(chunks.sparkSession, root)
    if found is None:
        return True
    mine = chunks.select(F.concat_ws(":", F.col("id").cast("string"), text_key("text")).alias("key"))
    kept = chunks.sparkSession.read.parquet(f"{found}/docs").select(F.concat_ws(":", F.col("id").cast("string"), "of").alias("key"))
    return not id_differences(mine, kept, "key").isEmpty()


def load_or_build(chunks: DataFrame, root: str, tokens: Callable[[Column], Column] = lexical.terms) -> str:
    """Folder of an index that holds exactly these chunks, built only if the kept one does not."""
    if stale(chunks, root):
        return build_lexical(chunks, root, tokens)
    return versions.current(chunks.sparkSession, root)


def search_lexical(spark: SparkSession, root: str, queries: DataFrame, k: int = 100, k1: float = lexical.K1, b: float = lexical.B, tokens: Callable[[Column], Column] = lexical.terms) -> DataFrame:
    """The run that ``lexical.bm25(..., keep_zero=False)`` gives over the indexed chunks."""
    found = versions.current(spark, root)
    if found is None:
        raise FileNotFoundError(f"no index at {root}")
    postings, df, docs = (spark.read.parquet(f"{found}/{t}") for t in ("postings", "terms", "docs"))
    asked = lexical.asked_terms(queries, tokens)
    some = [r["term"] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(some) <= PUSHED_TERMS:
        postings, df = postings.where(F.col("term").isin(some)), df.where(F.col("term").isin(some))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return lexical.ranked(lexical.scored(postings, df, stats, asked, k1, b), k, "bm25")


def store_vectors(chunks: DataFrame, root: str, embed: Embed = hashed_embedding, shards: int = 1) -> None:
    """Adds the vectors of chunks (id, text) that the table at ``root`` has none of.

    Every shard is one commit: a run that was stopped goes on with the shards that are
    missing, and a run over a grown corpus encodes the new and changed texts only.
    Texts for which the encoder gives no vector are tried again each time.
    """
    spark, id_ = chunks.sparkSession, chunks.schema["id"].dataType.simpleString()
    keyed = chunks.select("id", "text", text_key("text").alias("of")).dropDuplicates(["id"])
    for shard in range(shards):
        have = read_if_there(spark, root, f"id {id_}, of string, embedding array<double>").select("id", "of")
        todo = keyed.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == shard).join(have, ["id", "of"], "left_anti")
        new = embed(todo, "id", "text").join(todo.select("id", "of"), "id").select("id", "of", F.col("embedding").cast("array<double>").alias("embedding"))
        new.write.mode("append").option("compression", "zstd").parquet(root)


def load_vectors(chunks: DataFrame, root: str) -> DataFrame:
    """(id, embedding) of the chunks as they are now; vectors of gone or changed texts stay behind."""
    id_ = chunks.schema["id"].dataType.simpleString()
    kept = read_if_there(chunks.sparkSession, root, f"id {id_}, of string, embedding array<double>").dropDuplicates(["id", "of"])
    return kept.join(chunks.select("id", text_key("text").alias("of")).distinct(), ["id", "of"], "left_semi").select("id", "embedding")
