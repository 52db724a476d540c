"""The best ``k`` rows of every query, found in tiles of some queries and some rows.

Rows are dealt into parts, queries into groups, and each pair of a part and a group is one
task. It holds its queries, reads its rows as they come, by ascending id, scores them a few
at a time and keeps what can still be among a query's best. So a task's memory has bounds
that no table moves, and ``k`` rows a query leave each tile.

A later row has the larger id, so it must score more than the ``k``-th best so far. As final
scores are rounded, rows closer than ``SLACK`` below that one stay too, unless ``k`` rows of
the same or a larger score and a smaller id are there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiles at least, where parts would still have ``SMALL`` rows.
LEAST, SMALL = 16, 1024
#: Scores that a task holds at a time.
HELD = 1_000_000
#: More than rounding to 6 digits can move two scores together.
SLACK = 1e-6

#: Makes from a group's words and values (one list a query) what turns rows' words and values
#: into scores: (numbers of rows, rows x queries), some rows at a time.
Scores = Iterator[tuple[np.ndarray, np.ndarray]]
Maker = Callable[[pa.Array, pa.Array], Callable[[pa.Array, pa.Array], Scores]]


class _Best:
    def __init__(self, queries: int, k: int, floor: float):
        self.k, self.floor, self.edge = k, floor, np.full(queries, floor)
        self.kept = [(np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64))]
        self.fresh = 0

    def add(self, numbers: np.ndarray, score: np.ndarray) -> None:
        rows, cols = np.nonzero(score > self.edge.astype(score.dtype))
        self.kept.append((cols.astype(np.int32), score[rows, cols].astype(np.float64), numbers[rows]))
        self.fresh += len(rows)
        if self.fresh >= HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, row = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((-score, query))  # stable: equal scores stay in order of their ids
        query, score, row = query[order], score[order], row[order]
        many = np.bincount(query, minlength=len(self.edge))
        start = np.cumsum(many) - many
        full = many >= self.k
        self.edge[full] = score[start[full] + self.k - 1]
        edge = np.where(full, self.edge, -np.inf)[query]
        crowd = np.bincount(query[(score > edge) & (score <= edge + SLACK)], minlength=len(many)) > 0
        stays = (np.arange(len(query)) - start[query] < self.k) | ((score < edge) & (score >= edge - SLACK)) | ((score == edge) & crowd[query])
        self.kept, self.fresh = [(query[stays], score[stays], row[stays])], 0
        return self.kept[0]


def _owned(values: pa.Array) -> pa.Array:
    """A copy: a slice would hold on to its whole batch."""
    return values.take(pa.array(np.arange(len(values))))


def _search(make: Maker, k: int, floor: float):
    names = ["qid", "id", "score"]

    def found(qids: list, ids: list, best: _Best) -> Iterator[pa.RecordBatch]:
        query, score, row = best.settle()
        qid, id_ = pa.concat_arrays(qids), pa.concat_arrays(ids)
        for a in range(0, len(query), 65536):
            b = slice(a, a + 65536)
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(query[b])), id_.take(pa.array(row[b])), pa.array(score[b])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, ids, best, scores = None, [], [], None, None
        for batch in batches:
            tile, size, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (size[1:] != size[:-1]) | (kind[1:] != kind[:-1])]) if len(batch) else np.zeros(0, int)
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(batch)]):
                part = batch.slice(lo, hi - lo)
                if key != (tile[lo], size[lo]):
                    if best:
                        yield from found([a[0] for a in asked], ids, best)
                    key, asked, ids, best, scores = (tile[lo], size[lo]), [], [], None, None
                if kind[lo] == 0:
                    asked.append([_owned(part.column(i)) for i in (3, 5, 6)])
                elif asked:
                    if best is None:
                        _, words, values = (pa.concat_arrays(x) for x in zip(*asked))
                        best, scores, seen = _Best(len(values), k, floor), make(words, values), 0
                    for numbers, score in scores(part.column(5), part.column(6)):
                        best.add(numbers + seen, score)
                    ids.append(_owned(part.column(4)))
                    seen += len(part)
        if best:
            yield from found([a[0] for a in asked], ids, best)

    return run


def search(rows: DataFrame, n_rows: int, asked: DataFrame, n_asked: int, k: int, make: Maker, part_rows: int, group: int, floor: float = -np.inf) -> DataFrame:
    """(qid, id, score) with the ``k`` best rows of every query above ``floor``, and at most a
    few times as many that are not. ``rows`` are (id, size, words, values), ``asked`` (qid,
    size, words, values); a query meets rows of its size."""
    kinds = [d.schema[c].dataType.simpleString() for c, d in (("qid", asked), ("id", rows))]
    return dealt(rows, n_rows, asked, n_asked, part_rows, group).mapInArrow(_search(make, k, floor), f"qid {kinds[0]}, id {kinds[1]}, score double")


def dealt(rows: DataFrame, n_rows: int, asked: DataFrame, n_asked: int, part_rows: int, group: int) -> DataFrame:
    """(tile, size, kind, qid, id, words, values): a partition for each tile, queries (kind 0)
    before rows, rows by id."""
    groups = max(1, -(-n_asked // group))
    parts = max(1, -(-n_rows // part_rows), min(-(-n_rows // min(SMALL, part_rows)), -(-LEAST // groups)))
    kinds = {c: d.schema[c].dataType for c, d in (("qid", asked), ("id", rows))}
    none = {c: F.lit(None).cast(t).alias(c) for c, t in kinds.items()}

    def number(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.sequence(F.lit(0), F.lit(n - 1))

    mine = rows.select(F.explode(F.transform(each(groups), lambda g: g * parts + number("id", parts))).alias("tile"), "size", F.lit(1).alias("kind"), none["qid"], "id", "words", "values")
    theirs = asked.select(F.explode(F.transform(each(parts), lambda p: number("qid", groups) * parts + p)).alias("tile"), "size", F.lit(0).alias("kind"), "qid", none["id"], "words", "values")
    return theirs.unionByName(mine).repartitionById(groups * parts, F.col("tile")).sortWithinPartitions("tile", "size", "kind", "id")


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def products(_: pa.Array, values: pa.Array) -> Callable[[pa.Array, pa.Array], Scores]:
    """Inner products of vectors, in double precision."""
    matrix = _flat(values).astype(np.float64).reshape(len(values), -1).T
    step = max(1, HELD // matrix.shape[1])

    def scores(_: pa.Array, values: pa.Array) -> Scores:
        vectors = _flat(values).astype(np.float64).reshape(len(values), -1)
        for a in range(0, len(vectors), step):
            yield np.arange(a, min(a + step, len(vectors))), vectors[a : a + step] @ matrix

    return scores
