"""Exact top-k inner-product search over an impact-ordered index.

Components are quantised to integers; an entry's impact is its absolute value.
A block of vectors keeps its postings (row, dimension, value) in segments of
descending impact. Queries are taken in batches, score at a time: segments are
processed from the highest impact down, each adding its exact contributions to the
accumulators of the rows that are still possible. What is left unprocessed of a
vector is bounded by the product of two norms, so processing stops once every
vector outside the current best is proven out; the possible members are rescored
exactly. Nothing is approximated: without proof all segments are processed.

Defined results: vectors that are null or hold a null or non-finite component
take no part; vectors of another length than the query score over the shorter
length; repeated rows are candidates of their own; ties go to the smaller id; a
component beyond the range of a long stays at its end, and so does a score (sums
that a double cannot hold exactly are worked out in whole numbers); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

K = 20
SCALE = 64
EVERY = 20
BLOCK_ROWS = 8192
QUERY_ROWS = 512
#: Share of the squared impact that each round of segments adds.
ROUNDS = (0.5, 0.8, 0.93, 1.0)


class ImpactBlock:
    """Postings of a block of vectors in segments of descending impact.

    ``segments`` holds (lowest impact, rows, dims, values): postings with impacts from
    the lowest up to the segment before it. ``rest`` holds the norm of what a row
    has left after each segment.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        wide = self.values.astype(np.float64)
        impact = np.abs(wide)
        self.norm = np.sqrt((wide * wide).sum(axis=1))
        self.segments, self.rest = [], []
        upper = np.inf
        for cut in self._cuts(impact):
            rows, dims = np.nonzero((impact >= cut) & (impact < upper))
            self.segments.append((cut, rows, dims, wide[rows, dims]))
            left = np.where(impact < cut, wide, 0)
            self.rest.append(np.sqrt((left * left).sum(axis=1)))
            upper = cut

    @staticmethod
    def _cuts(impact: np.ndarray) -> list[float]:
        """Lowest impacts of the segments, so that each adds its share of squared impact."""
        flat = np.sort(impact.ravel())[::-1]
        reached = np.cumsum(flat * flat)
        if not len(flat) or not reached[-1]:
            return [0.0]
        return sorted({float(flat[np.searchsorted(reached, share * reached[-1])]) for share in ROUNDS[:-1]} | {0.0}, reverse=True)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vector number, exact score) of every query's best ``k`` here."""
        width = min(queries.shape[1], self.values.shape[1])
        q = queries.astype(np.float64)
        length = np.sqrt((q * q).sum(axis=1))
        if length.max(initial=0) * self.norm.max(initial=0) >= 2.0**52:
            return self._in_whole_numbers(query_ids, queries, k)
        n = len(self.ids)
        score = np.zeros((len(q), n))
        own = self.ids[None, :] == query_ids[:, None]
        take = min(k + 1, n)  # the query's own row may be among them
        open_, alive = np.arange(len(q)), np.arange(n)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for (cut, rows, dims, values), rest in zip(self.segments, self.rest):
            place = np.full(n, -1)
            place[alive] = np.arange(len(alive))
            part = (place[rows] >= 0) & (dims < width)
            postings = np.zeros((len(alive), width))
            postings[place[rows[part]], dims[part]] = values[part]
            some = np.ix_(open_, alive)
            now = score[some] + q[open_, :width] @ postings.T
            score[some] = now
            slack = length[open_, None] * rest[None, alive] * (1 + 1e-9)
            mine = own[some]
            low = np.where(mine, -np.inf, now - slack)
            reach = min(take, len(alive))
            floor_ = np.partition(low, len(alive) - reach, axis=1)[:, len(alive) - reach]
            possible = (now + slack >= floor_[:, None]) & ~mine
            done = possible.sum(axis=1) <= 4 * k if cut else np.ones(len(open_), bool)
            where, row = np.nonzero(possible[done])
            out.append((open_[done][where], alive[row]))
            open_, alive = open_[~done], alive[possible[~done].any(axis=0)]
            if not len(open_) or not len(alive):
                break
        who, row = (np.concatenate(x) for x in zip(*out))
        exact = (queries[who][:, :width].astype(np.int64) * self.values[row][:, :width].astype(np.int64)).sum(axis=1)
        return self._best(who, row, exact, k)

    def _best(self, who: np.ndarray, row: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[row], ~exact, who))  # ~x falls as x rises, and does not overflow
        who, row, exact = who[order], row[order], exact[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who, side="left")
        best = nth < k
        return who[best], row[best], exact[best]

    def _in_whole_numbers(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs without rounding, for vectors whose scores a double may not hold."""
        width = min(queries.shape[1], self.values.shape[1])
        ends = np.iinfo(np.int64)
        found = []
        vectors = self.values[:, :width].astype(object)
        for i, query in enumerate(queries[:, :width].astype(object)):
            row = np.flatnonzero(self.ids != query_ids[i])
            exact = np.array([min(max(int(x), ends.min), ends.max) for x in vectors[row] @ query], np.int64)
            found.append(self._best(np.full(len(row), i), row, exact, k))
        return tuple(np.concatenate(x) for x in zip(*found))


def _blob(values: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them all."""
    most = np.abs(values.astype(np.float64)).max(initial=0)
    return values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * dim)}").reshape(rows, dim)


BLOCKS = "part long, dim int, ids binary, vals binary"


def _blocks(rows: int):
    """Vectors of a task, sorted by part, into blocks of at most ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}  # by length
        at = None

        def block(dim: int) -> pa.RecordBatch:
            ids, vecs = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([_blob(np.array(vecs))], pa.binary())], names=["part", "dim", "ids", "vals"])

        for batch in batches:
            for part, id_, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if part != at:
                    yield from map(block, list(held))
                    at = part
                v = np.asarray(vec.values.to_numpy(zero_copy_only=False), np.int64)
                ids, vecs = held.setdefault(len(v), ([], []))
                ids.append(id_)
                vecs.append(v)
                if len(ids) == rows:
                    yield block(len(v))
        yield from map(block, list(held))

    return run


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[bytes, ImpactBlock] | None = None
        for batch in batches:
            for qdim, qids, qvals, dim, ids, vals in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if kept is None or kept[0] != ids:
                    own = np.frombuffer(ids, "<i8")
                    kept = (ids, ImpactBlock(own, _matrix(vals, len(own), dim)))
                query_ids = np.frombuffer(qids, "<i8")
                who, row, score = kept[1].search(query_ids, _matrix(qvals, len(query_ids), qdim), k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(kept[1].ids[row]), pa.array(score)], names=names)

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components of the vectors that take part."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform(wide, lambda x: F.floor(x * scale).cast("long")).alias("q"))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` highest scores of every query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``. The index is dealt once, into
    parts of about ``block_rows``; batches of queries, a fraction of the rows, are sent
    to every part. Only ``k`` rows of each block and query go on to the final ranking.
    """
    whole = quantised(vectors)
    parts = max(1, -(-whole.count() // block_rows))
    queries = whole.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    batches = max(1, -(-queries.count() // query_rows))
    deal = lambda rows, n: rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("part"), "vec_id", "q").repartition(n, "part").sortWithinPartitions("part")
    asked = deal(queries, batches).mapInArrow(_blocks(query_rows), BLOCKS).select(F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("vals").alias("qvals"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    pairs = deal(whole, parts).mapInArrow(_blocks(block_rows), BLOCKS).join(asked, "part").select("qdim", "qids", "qvals", "dim", "ids", "vals")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
