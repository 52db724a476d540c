"""Document fingerprints by order MinHash.

A text's k-mers of code points are numbered by occurrence, so each is unique. For
each of ``SIZE`` hash functions the ``TUPLE`` k-mers with the smallest hashes are
taken in the order in which they stand in the text and hashed together. The share
of equal entries of two fingerprints estimates a likeness that, unlike that of
plain MinHash, falls when parts are moved: it is sensitive to edit distance.

Neighbours in descending id order are found without a global sort in one task:
rows go to buckets between approximate quantiles of the id, and the first row of
each bucket is also sent to the bucket before it.

Defined results: a null text is empty; a text shorter than a k-mer is one k-mer;
two empty texts have likeness 1; null ids come last, ties go by the hash of the text,
then by the text, and a single row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bytekit import POWERS, U64, mix64

K = 10
TUPLE = 2
SIZE = 40
BUCKET_ROWS = 2048
#: Most buckets of rows with ids, and of rows without; beyond it buckets grow. A bucket is
#: sorted by one task, which spills, and read as a stream.
MOST_BUCKETS = 20_000
_CHUNK = 4096
_MAX = U64(0xFFFFFFFFFFFFFFFF)
_FACTORS = mix64(np.arange(1, SIZE + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers of a text, in order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)
    n = len(points)
    up, down = POWERS.to(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((points + U64(1)) * up[:n], out=sums[1:])
    if n <= K:
        return mix64(sums[n:]) if n else np.zeros(0, U64)
    return mix64((sums[K:] - sums[:-K]) * down[: n - K + 1])


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, number of its earlier occurrences)."""
    ordered = np.sort(hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return mix64(hashes)
    again = again[np.r_[True, again[1:] != again[:-1]]]  # the k-mers that occur more than once
    at = np.minimum(np.searchsorted(again, hashes), len(again) - 1)
    place = np.flatnonzero(again[at] == hashes)
    order = np.argsort(at[place], kind="stable")
    key = at[place][order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    occurrence = np.zeros(len(hashes), U64)
    occurrence[place[order]] = nth
    return mix64(hashes + occurrence * U64(0xD1342543DE82EF95))


def smallest(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hash function the ``TUPLE`` smallest hashes, their places and values."""
    best_h = np.full((SIZE, TUPLE), _MAX)
    best_at = np.full((SIZE, TUPLE), np.iinfo(np.int64).max)
    best_v = np.zeros((SIZE, TUPLE), U64)
    rows = np.arange(SIZE)
    for at in range(0, len(values), _CHUNK):
        part = values[at : at + _CHUNK]
        h = part[None, :] * _FACTORS[:, None]
        found_h, found_at, found_v = [best_h], [best_at], [best_v]
        for _ in range(min(TUPLE, len(part))):
            i = h.argmin(axis=1)
            found_h.append(h[rows, i][:, None].copy())
            found_at.append((i + at + base)[:, None])
            found_v.append(part[i][:, None])
            h[rows, i] = _MAX
        best_h, best_at, best_v = _merge(found_h, found_at, found_v)
    return best_h, best_at, best_v


def _merge(h: list[np.ndarray], at: list[np.ndarray], v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h_, at_, v_ = np.concatenate(h, axis=1), np.concatenate(at, axis=1), np.concatenate(v, axis=1)
    order = np.argsort(h_, axis=1, kind="stable")[:, :TUPLE]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (h_, at_, v_))


def joined(*parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The fingerprint of a text from the smallest k-mers of its parts: 16 bits an entry."""
    _, at, v = _merge(*map(list, zip(*parts)))
    order = np.argsort(at, axis=1, kind="stable")
    v = np.take_along_axis(v, order, axis=1)
    out = np.zeros(SIZE, U64)
    for i in range(TUPLE):
        out = mix64(out * U64(0xBF58476D1CE4E5B9) + v[:, i] + U64(i + 1))
    return (out >> U64(48)).astype(">u2")


def fingerprint(text: str) -> np.ndarray:
    return joined(smallest(numbered(kmers(text)), 0))


def with_edited(text: str, edited: str, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text and of another that begins with the same ``shared``
    code points; k-mers of the common part are hashed once."""
    own, other = numbered(kmers(text)), numbered(kmers(edited))
    common = max(0, shared - K + 1) if min(len(text), len(edited)) > K else 0
    common = min(common, len(own), len(other))
    head = smallest(own[:common], 0)
    return joined(head, smallest(own[common:], common)), joined(head, smallest(other[common:], common))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple | None = None  # bucket, doc_id, text, still to be compared

    def row(doc_id, text: str, following: str) -> tuple:
        n = len(text)
        cut = n // 3
        edited = text[: n - cut] + following[:cut]
        mine, theirs = with_edited(text, edited, n - cut)
        return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), mine, theirs

    waiting: tuple | None = None
    for batch in batches:
        out: list[tuple] = []
        for bucket, foreign, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            if last is not None and last[0] == bucket:
                made = row(last[1], last[2], text)
                if waiting is not None:
                    out.append((*waiting, likeness(waiting[3], made[3])))
                    waiting = None
                if foreign:
                    out.append((*made, likeness(made[3], fingerprint(text))))
                else:
                    waiting = made
            last = None if foreign else (bucket, doc_id, text)
        if out:
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out]),
                pa.array([r[3].tobytes().hex() for r in out]), pa.array([r[4].tobytes().hex() for r in out]),
                pa.array([likeness(r[3], r[4]) for r in out]), pa.array([r[5] for r in out]),
            ], names=NAMES)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucket(splits: list[int], nameless: int):
    """The number of splits up to an id, by binary search; rows without an id go to
    ``nameless`` buckets below zero, by the hash of their text."""
    edges = np.array(splits, np.int64)

    @F.pandas_udf("long")
    def below(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right"))

    by_hash = F.least(F.floor((F.col("lot") / float(1 << 64) + 0.5) * nameless), F.lit(nameless - 1))
    return F.when(F.col("doc_id").isNull(), -1 - by_hash).otherwise(below(F.coalesce("doc_id", F.lit(0)))).cast("long")


def fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, most: int = MOST_BUCKETS) -> DataFrame:
    """Fingerprints of every document and of its edited text; see the module."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lot"))
    n, named = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not n:
        return rows.limit(0).select(F.lit(0).cast("long"), F.lit(0), "doc_id", "text").mapInArrow(_pairs, RESULT)
    size = max(bucket_rows, -(-n // most))
    many = max(1, named // size)
    quantiles = rows.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)] or [0.5], 100_000)).first()[0]
    placed = rows.withColumn("bucket", _bucket(sorted(set(quantiles or [])), max(1, (n - named) // size)))
    # the first row of each bucket, of which there are at most 2 * most
    heads = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", (-1 - F.col("lot")).alias("inverse"))).alias("head")).collect()
    order = sorted(heads, key=lambda r: -r["bucket"])
    known = [(r["bucket"], r["head"]["doc_id"], -1 - r["head"]["inverse"], order[i - 1]["bucket"]) for i, r in enumerate(order)]  # before the first comes the last
    known = placed.sparkSession.createDataFrame(known, "b long, head long, head_lot long, before long")
    placed = placed.join(F.broadcast(known), F.col("bucket") == F.col("b"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("foreign"))
    also = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("foreign"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("lot") == F.col("head_lot"))
    dealt = placed.withColumn("to", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own)))).select("to.bucket", "to.foreign", "doc_id", "text", "lot")
    parts = max(len(order) // 3, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "foreign", F.col("doc_id").desc_nulls_last(), "lot", F.coalesce("text", F.lit("")))
    return sorted_.drop("lot").mapInArrow(_pairs, RESULT)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
