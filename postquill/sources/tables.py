"""Line and column files as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COMMITMENTS, EVAL_QUERIES


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, blank lines and # comments skipped. A line that is no JSON or lacks a
    required field has ``problem`` set instead of failing the read."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parsed = lines.select("value", F.from_json("value", EVAL_QUERIES + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("q"))
    lost = F.filter(F.array(*[F.when(F.col(f"q.{c}").isNull(), c) for c in ("query_id", "query", "query_class")]), lambda x: x.isNotNull())
    problem = F.when(F.col("q._bad").isNotNull(), "bad JSON").when(F.size(lost) > 0, F.concat(F.lit("missing field "), F.array_join(lost, ", ")))
    return parsed.select(
        "q.query_id", "q.query", "q.query_class", F.coalesce("q.relevant_message_ids", F.array().cast("array<string>")).alias("relevant_message_ids"), F.coalesce("q.notes", F.lit("")).alias("notes"),
        F.coalesce("q.verified", F.lit(False)).alias("verified"), F.coalesce("q.source_thread_id", F.lit("")).alias("source_thread_id"), F.coalesce("q.as_of", F.lit("")).alias("as_of"), problem.alias("problem"),
    )


def read_commitments(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.schema(COMMITMENTS).json(glob)


def read_messages(spark: SparkSession, path: str, columns: list[str], key: str | None = None) -> DataFrame:
    """Only the columns asked for leave the scan; a key becomes a pushed filter."""
    rows = spark.read.parquet(path)
    rows = rows if key is None else rows.where(F.col("dedup_key") == key)
    return rows.select(*columns)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet: empty then."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Compressed columns; _SUCCESS marks a complete table."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def read_text_cache(spark: SparkSession, path: str) -> DataFrame:
    """Chunk texts kept as (compressed) JSON lines; the last line of an id wins."""
    rows = spark.read.schema("chunk_id string, text string, line long").json(path)
    return rows.groupBy("chunk_id").agg(F.max_by("text", F.coalesce("line", F.lit(0))).alias("text"))
