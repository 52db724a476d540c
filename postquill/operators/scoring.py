"""Passages scored by a loaded scorer, in batches of like lengths, with the time of each batch.

A scorer takes questions and passages, pair by pair, and gives one or two logits a pair; a
loader makes it. A loader that is an importable function is called once per Python worker,
any other once per task.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .chunking import whitespace_tokens
from .lexical import TOKEN

#: Fixed value: pairs a call of the scorer.
BATCH = 16

Scorer = Callable[[list[str], list[str]], list[list[float]]]
Loader = Callable[[], Scorer]


@lru_cache(maxsize=2)
def _loaded(load: Loader) -> Scorer:
    return load()


def _score(load: Loader, size: int, key_types: list[pa.DataType]):
    names = ["qid", "id", "logits", "batch", "batch_rows", "batch_ms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, number = _loaded(load), 0
        for rows in batches:
            for at in range(0, len(rows), size):
                part = rows.slice(at, size)
                began = time.perf_counter()
                logits = scorer(part.column(2).to_pylist(), part.column(3).to_pylist())
                ms = (time.perf_counter() - began) * 1000
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(key_types[0]), part.column(1).cast(key_types[1]), pa.array(logits, pa.list_(pa.float64())), pa.array([number] * n, pa.int32()), pa.array([n] * n, pa.int32()), pa.array([ms] * n)],
                    names=names,
                )
                number += 1

    return run


def score_pairs(pairs: DataFrame, load: Loader, batch: int = BATCH, max_tokens: int | None = None) -> DataFrame:
    """(qid, id, logits, task, batch, batch_rows, batch_ms) of pairs (qid, id, query, text).

    Pairs are dealt to tasks by their keys and ordered by length within each, so that a batch
    holds passages of like length. ``max_tokens`` is how much of a passage the scorer reads;
    without it passages go whole. Pairs without a text or a question are not scored."""
    text = F.col("text") if max_tokens is None else F.array_join(F.slice(whitespace_tokens(F.col("text")), 1, max_tokens), " ")
    whole = pairs.where(F.col("query").isNotNull() & F.col("text").isNotNull()).select("qid", "id", "query", text.alias("text"))
    dealt = whole.repartition("qid", "id").sortWithinPartitions(F.length("text") + F.length("query"), "qid", "id")
    kinds = [pairs.schema[c].dataType for c in ("qid", "id")]
    schema = f"qid {kinds[0].simpleString()}, id {kinds[1].simpleString()}, logits array<double>, batch int, batch_rows int, batch_ms double"
    found = dealt.mapInArrow(_score(load, batch, [to_arrow_type(k) for k in kinds]), schema)
    return found.select("qid", "id", "logits", F.spark_partition_id().alias("task"), "batch", "batch_rows", "batch_ms")


def times(scored: DataFrame) -> DataFrame:
    """(qid, passages, ms) of rows from ``score_pairs``: each pair bears its share of its batch's time."""
    return scored.groupBy("qid").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.col("batch_ms") / F.col("batch_rows")).alias("ms"))


def _marks(words: list[str]) -> np.ndarray:
    """Which bytes each word has."""
    out = np.zeros((len(words), 256))
    for row, word in zip(out, words):
        row[np.frombuffer(word.encode(), np.uint8)] = 1
    return out


def token_similarity() -> Scorer:
    """Late interaction: every word of a question with the passage's word most like it, by the
    share of bytes that two words have in common, averaged in whole millionths, so that no
    order of adding changes a score. 0 where either has no words."""
    token = re.compile(TOKEN, re.ASCII)

    def one(query: str, passage: str) -> float:
        asked, found = token.findall(query.lower()), sorted(set(token.findall(passage.lower())))
        if not asked or not found:
            return 0.0
        a, b = _marks(asked), _marks(found)
        both = a @ b.T
        best = (both / (a.sum(1)[:, None] + b.sum(1) - both)).max(axis=1)
        return int(np.floor(best * 1_000_000).astype(np.int64).sum()) // len(asked) / 1_000_000

    return lambda queries, passages: [[one(q, p)] for q, p in zip(queries, passages)]
