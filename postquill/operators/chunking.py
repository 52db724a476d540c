"""Chunking strategies: messages or threads to passages of at most ``size`` tokens.

The tokenizer is any expression from text to an array of tokens; the default splits
on white space. Whole and fixed chunks are flat maps; packing a thread is a fold over
its messages in Catalyst, one row per thread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, key_of_chunk

MAX_TOKENS, OVERLAP = 512, 64


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        chunk_id("dedup_key", "ordinal").alias("chunk_id"), "dedup_key", F.coalesce("thread_id", F.col("dedup_key")).alias("thread_id"),
        "ordinal", F.array_join("__tok", " ").alias("text"), F.size("__tok").alias("n_tokens"),
    )


def _threaded(messages: DataFrame) -> DataFrame:
    return messages if "thread_id" in messages.columns else messages.withColumn("thread_id", F.col("dedup_key"))


def fixed(messages: DataFrame, text: Column, size: int = MAX_TOKENS, overlap: int = 0, tokens: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """Windows of ``size`` tokens that overlap; the last is the first to reach the end."""
    stride = size - overlap
    rows = _threaded(messages).select("dedup_key", "thread_id", tokens(text).alias("__all"))
    n = F.size("__all")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(stride)) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(F.col("__all"), i * stride + 1, F.lit(size)))
    return _shape(rows.where(n > 0).select("dedup_key", "thread_id", F.posexplode(cut).alias("ordinal", "__tok")))


def whole(messages: DataFrame, text: Column, size: int = MAX_TOKENS, tokens: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """One chunk per message, cut at ``size`` tokens."""
    rows = _threaded(messages).select("dedup_key", "thread_id", F.lit(0).alias("ordinal"), F.slice(tokens(text), 1, size).alias("__tok"))
    return _shape(rows.where(F.size("__tok") > 0))


def thread_aware(messages: DataFrame, text: Column, order: list[str], size: int = MAX_TOKENS, tokens: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """Whole messages of a thread packed greedily in order. A chunk belongs to its first
    message; its number counts the packed chunks of the thread. A message over ``size``
    closes the open chunk and is split on its own, numbered from 0."""
    rows = messages.select("thread_id", "dedup_key", *[c for c in order if c not in ("thread_id", "dedup_key")], tokens(text).alias("__tok")).where(F.size("__tok") > 0)
    key = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)).alias(f"o{i}") for i, c in enumerate(order)], "dedup_key")
    item = F.struct(key.alias("key"), F.size("__tok").alias("n"), "dedup_key", "__tok")
    threads = rows.groupBy("thread_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    # fold over lengths: the number of the packed chunk each message falls in, -1 for an oversize one
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        big = x["n"] > size
        closed = F.when(acc["used"] > 0, acc["no"] + 1).otherwise(acc["no"])
        full = acc["used"] + x["n"] > size
        no = F.when(big | full, closed).otherwise(acc["no"])
        used = F.when(big, 0).when(full, x["n"]).otherwise(acc["used"] + x["n"])
        return F.struct(used.cast("int").alias("used"), no.cast("int").alias("no"), F.concat(acc["at"], F.array(F.when(big, -1).otherwise(no).cast("int"))).alias("at"))

    folded = threads.withColumn("at", F.aggregate("items", start, step)["at"])
    flat = folded.select("thread_id", F.posexplode(F.arrays_zip("items", "at")).alias("pos", "x")).select("thread_id", "pos", "x.items.dedup_key", "x.items.__tok", F.col("x.at").alias("no"))
    packed = flat.where("no >= 0").groupBy("thread_id", "no").agg(F.min_by("dedup_key", "pos").alias("dedup_key"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "__tok"))), lambda p: p["__tok"])).alias("__tok"))
    packed = _shape(packed.withColumnRenamed("no", "ordinal"))
    large = flat.where("no < 0")
    n = F.size("__tok")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / F.lit(size)).cast("int") - 1), lambda i: F.slice(F.col("__tok"), i * size + 1, F.lit(size)))
    return packed.unionByName(_shape(large.select("dedup_key", "thread_id", F.posexplode(cut).alias("ordinal", "__tok"))))


#: By name, as functions of messages, their text and the order of a thread.
STRATEGIES = {
    "fixed_512": lambda messages, text, order, **how: fixed(messages, text, **how),
    "fixed_512_ov64": lambda messages, text, order, **how: fixed(messages, text, overlap=OVERLAP, **how),
    "whole_message": lambda messages, text, order, **how: whole(messages, text, **how),
    "thread_aware": lambda messages, text, order, **how: thread_aware(messages, text, order, **how),
}


def chunked(strategy: str, messages: DataFrame, text: Column, order: list[str], **how) -> DataFrame:
    """The whole corpus in chunks by a named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; have {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](messages, text, order, **how)


def rebuilt_threads(strategy: str, messages: DataFrame, wanted: DataFrame, text: Column, order: list[str], **how) -> DataFrame:
    """Chunks of the whole threads that hold the messages of the ``wanted`` chunk ids: a
    thread is packed as one, so part of it would give other chunks."""
    keys = wanted.select(key_of_chunk("chunk_id").alias("dedup_key")).distinct()
    threads = messages.join(keys, "dedup_key", "left_semi").select("thread_id").distinct()
    return chunked(strategy, messages.join(threads, "thread_id", "left_semi").select(*messages.columns), text, order, **how)


def rebuild(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted chunks of a rebuilt corpus; an id that cannot be rebuilt fails the job."""
    found = wanted.select("chunk_id").join(chunks, "chunk_id", "left")
    return found.withColumn("text", F.when(F.col("dedup_key").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("cannot rebuild chunk "), F.col("chunk_id")))))


def chunk_changes(messages: DataFrame, before: DataFrame, after: DataFrame, strategy: str, text: Column, order: list[str], **how) -> DataFrame:
    """(id, text, gone): what changes among the chunks of the threads that ``after`` names.
    ``before`` and ``after`` (dedup_key, thread_id) are whole threads before and after a change."""
    light = messages.drop("thread_id")
    old = chunked(strategy, light.join(before.join(after.select("dedup_key"), "dedup_key", "left_semi"), "dedup_key"), text, order, **how).select(F.col("chunk_id").alias("id"), F.col("text").alias("old"))
    new = chunked(strategy, light.join(after, "dedup_key"), text, order, **how).select(F.col("chunk_id").alias("id"), "text")
    both = old.join(new, "id", "full_outer").where(~F.col("old").eqNullSafe(F.col("text")))
    return both.select("id", "text", F.col("text").isNull().alias("gone"))


def id_differences(local: DataFrame, other: DataFrame, column: str = "chunk_id") -> DataFrame:
    """Ids on one side only (column side), duplicates counted: empty means parity."""
    a, b = local.select(column), other.select(column)
    return a.exceptAll(b).withColumn("side", F.lit("local")).unionByName(b.exceptAll(a).withColumn("side", F.lit("other")))
